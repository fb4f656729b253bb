from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
from brinewave.llm import op9_toxicity as op


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = op.new_parameters(rng, 0.2)
    x = rng.normal(size=(9, 2 + op.WORD_DIM + op.CHAR_DIM))
    ids = np.where(rng.random((5, op.WINDOW)) < 0.8, rng.integers(0, 9, (5, op.WINDOW)), -1)
    ids.sort(axis=1)
    ids = ids[:, ::-1]  # words first, then what lies beyond the end
    y = np.array([0.0, 1, 1, 0, 1])
    _, g, d_x = op.gradients(p, x, ids, y)
    for k, a in [*((k, p[k]) for k in g), ("x", x)]:
        grad = d_x if k == "x" else g[k]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in a.shape)
            was = a[at]
            a[at] = was + 1e-5
            up = op.gradients(p, x, ids, y)[0]
            a[at] = was - 1e-5
            down = op.gradients(p, x, ids, y)[0]
            a[at] = was
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6 + 1e-4 * abs(grad[at]), k


def naive(x, p):
    """The logit of one window, from the words' inputs, a number at a time."""
    h, n = op.HIDDEN, len(x)
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = [[0.0] * (2 * h) for _ in range(n)]
    for side, order, shift in (("f", range(n), 0), ("b", range(n - 1, -1, -1), h)):
        state = [0.0] * h
        for t in order:
            a = [sum(x[t][i] * p["x" + side][i, j] for i in range(len(x[t]))) + p["c" + side][j] for j in range(3 * h)]
            b = [sum(state[i] * p["u" + side][i, j] for i in range(h)) for j in range(3 * h)]
            r = [sig(a[j] + b[j]) for j in range(h)]
            z = [sig(a[h + j] + b[h + j]) for j in range(h)]
            new = [math.tanh(a[2 * h + j] + r[j] * b[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            states[t][shift : shift + h] = state
    weight = [math.exp(sum(math.tanh(sum(s[i] * p["wa"][i, j] for i in range(2 * h))) * p["va"][j] for j in range(op.ATTENTION))) for s in states]
    context = [sum(w * s[i] for w, s in zip(weight, states, strict=True)) / sum(weight) for i in range(2 * h)]
    return sum(c * w for c, w in zip(context, p["wo"], strict=True)) + p["bo"][0]


def test_forward_pass_equals_loops():
    rng = np.random.default_rng(7)
    p = op.new_parameters(rng, 0.2)
    p["cf"], p["cb"] = rng.normal(size=p["cf"].shape), rng.normal(size=p["cb"].shape)
    x = rng.normal(size=(40, op.ODDS + op.WORD_DIM + op.CHAR_DIM))
    for n in (1, 2, 9, op.WINDOW):
        words = rng.integers(0, 40, n)
        ids = np.append(words, np.full(op.WINDOW - n, -1))[None]
        assert abs(op.logits(op.projections(x, p), ids, p)[0] - naive(x[words].tolist(), p)) < 1e-9


def test_inputs_equal_loops():
    rng = np.random.default_rng(8)
    p = op.new_parameters(rng, 0.2)
    odds = op.Odds(rng.normal(size=1 << op.WORD_BITS), rng.normal(size=1 << op.RUN_BITS))
    words = [b"hello", b"", b"x", "Ähre".lower().encode(), b"hellohello"]
    at = op.word_bucket(words)
    x = op.inputs(odds.of(words, at), p, at, *op.trigrams(words))
    for i, w in enumerate(words):
        framed = b"^%b$" % w
        gram = lambda k, bits: [op.mix(np.array([int.from_bytes(framed[j : j + k], "big")], np.uint64))[0] >> np.uint64(64 - bits) for j in range(len(framed) - k + 1)]  # noqa: B023, E731
        chars = [p["char"][int(g)] for g in gram(3, op.CHAR_BITS)]
        run = max([0.0, *(odds.run[int(g)] for g in gram(op.RUN, op.RUN_BITS))])
        expect = [odds.word[at[i]], run, *p["word"][at[i]], *(np.mean(chars, 0) if chars else [0.0] * op.CHAR_DIM)]
        assert np.allclose(x[i], expect)


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.choice([5, 40, 200]))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["Vile,", "nasty", "foul."])
        out.append((" ".join(words).encode(), y))
    return out


def test_training_finds_toxic_words_anywhere_and_scorer_equals_one_by_one():
    model = op.train(corpus(400, 1))
    test = corpus(200, 2)
    scorer = op.Scorer(model)
    s = scorer([t for t, _ in test])
    assert np.mean((s >= 0.5) == [y for _, y in test]) > 0.95
    long = b" ".join([b"w1"] * 20_000 + [b"nasty", b"foul"])
    odd = [None, b"", b" ", b"... !!", long, b"nasty", "ÄÖ é".encode()]
    together = scorer(odd)
    assert np.allclose(together, [op.Scorer(model)([t])[0] for t in odd], atol=1e-5)
    # the score is that of the best window, each taken alone
    words = long.split()
    alone = [op.Scorer(model)([b" ".join(words[i : i + op.WINDOW])])[0] for i in range(19_904, 20_002, op.STRIDE)]
    assert abs(max(alone) - together[4]) < 1e-3 or together[4] > max(alone)
    assert together[4] > 0.5


def test_word_forms_of_a_toxic_stem_are_found():
    rng = random.Random(6)
    form = lambda: "grobl" + "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for t, y in corpus(500, 3):
        words = [w for w in t.decode().split() if w[0] == "w"] or ["w1"]
        if y:
            words[rng.randrange(len(words))] = form()
        rows.append((" ".join(words).encode(), y))
    s = op.Scorer(op.train(rows[:400]))([t for t, _ in rows[400:]])
    assert np.mean((s >= 0.5) == [y for _, y in rows[400:]]) > 0.95


def test_embeddings_find_toxic_words_without_log_odds():
    rows, test = corpus(600, 1), corpus(200, 2)
    y = np.array([y for _, y in test])
    blind = op.train(rows)
    blind.odds, blind.runs = np.zeros_like(blind.odds), np.zeros_like(blind.runs)
    s = op.Scorer(blind)([t for t, _ in test]) >= 0.5
    assert np.mean(s == y) > 0.93 and np.mean(s[y == 1]) > 0.8


def test_a_long_text_is_learned_from_wherever_it_is_toxic():
    """Windows are picked from all over a text, the toxic ones among them."""
    counts = op.Counts()
    for i, (t, y) in enumerate(corpus(300, 4)):
        counts.add(i & 1, y, t)
    long = [b"w1"] * 30_000 + [b"nasty"] + [b"w2"] * 30_000
    for seed in range(3):
        found = op.picked_windows(b" ".join(long), counts.odds([0, 1]), seed)
        assert len(found) == op.PICKED and sum(b"nasty" in w for w in found) == 2
    assert op.picked_windows(b"", counts.odds([0, 1]), 0) == [[]] and len(op.picked_windows(b"x " * 90, counts.odds([0]), 0)) == 5


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        rows = op.window_rows(n)
        assert set(rows[rows >= 0].tolist()) == set(range(n))


def test_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, None), (5, 0, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = op.fit(docs.withColumn("label", docs.lang).withColumn("h", docs.lang), labels, lambda k: k.isNotNull())
    rows = op.with_toxicity(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    clash = docs.withColumn("Score", docs.text).withColumn("predicted", docs.lang).withColumn("held_out", docs.doc_id)
    assert op.with_toxicity(clash, model).columns == ["doc_id", "lang", "source", "n_chars", "held_out", "score", "predicted"]
    assert np.allclose(sorted(r.score for r in op.with_toxicity(clash, model).collect()), sorted(r.score for r in rows), atol=1e-5)
    none = op.fit(docs, labels.limit(0), lambda k: k.isNotNull())
    assert {r.score for r in op.with_toxicity(docs.select("doc_id", "text"), none).collect()} == {0.0}
    assert op.with_toxicity(docs.limit(0).select("doc_id", "text"), model).count() == 0


def test_fit_on_executors_equals_training_in_one_place(spark):
    rows = [(i, t.decode(), y) for i, (t, y) in enumerate(corpus(200, 5))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model, again = (op.fit(docs.repartition(n), labels, lambda k: k.isNotNull()) for n in (2, 5))
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p) and np.array_equal(model.odds, again.odds)
    counts = op.Counts()
    for i, t, y in rows:
        counts.add(i & 1, y, t.encode())
    whole = counts.odds([0, 1])  # whatever the halves
    assert np.allclose(whole.word, model.odds) and np.allclose(whole.run, model.runs)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    if not Path(d).exists():
        pytest.skip("no tables")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in op.query(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in rows) >= 0.96 * len(rows)
    assert sum(r.predicted for r in rows if truth[r.doc_id]) >= 0.85 * sum(truth[r.doc_id] for r in rows)
