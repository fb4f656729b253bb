from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from brinewave.llm import op2_quality_classifier as op


def test_ftrl_equals_a_coordinatewise_loop():
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        at = sorted(rng.sample(range(16), 5))
        rows.append((np.array(at), np.array([rng.random() for _ in at]), int(3 in at)))
    model = op.ftrl(rows, bits=4, epochs=2)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        l1 = op.L1 if i < 16 else 0.0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((op.BETA + math.sqrt(n[i])) / op.ALPHA + op.L2)

    for _ in range(2):
        for at, x, y in rows:
            full = [*zip(at.tolist(), x.tolist(), strict=True), (16, 1.0)]
            w = {i: weight(i) for i, _ in full}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in full)))
            for i, v in full:
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / op.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(model.weights, [weight(i) for i in range(16)], atol=1e-6) and abs(model.bias - weight(16)) < 1e-9


def test_score_is_a_sparse_dot_product():
    rng = np.random.default_rng(1)
    model = op.Model(rng.normal(size=1 << 10).astype(np.float32), 0.3, 10)
    tokens = op.Tokens()
    for text in (b"", b"a", "Éa É, é!! ## 12 a a a".encode(), b" \t "):
        at, x = op.sparse(text, tokens, 10)
        expect = 1 / (1 + math.exp(-(0.3 + float(sum(model.weights[i].astype(float) * v for i, v in zip(at, x, strict=True))))))
        assert abs(op.score_texts([text], model, tokens)[0] - expect) < 1e-6
    index, n = op.features(b"a a b", tokens, 10)
    assert n == 3 and sum(Counter(index.tolist()).values()) == 9 + 6 + 1


def test_features_equal_a_plain_count():
    """Cores, affixes and shapes of the words, one by one and in twos, and doubled words."""
    text = "Hello, hello hello (World) 3rd -- x2! Éa".encode()
    words = text.split()
    tokens = op.Tokens()
    index, n = op.features(text, tokens, 19)
    assert n == len(words) == 8
    kinds = [tokens[w] for w in words]
    assert len({k[0] for k in kinds}) == 6  # hello is one core
    pairs = {(x, y) for k in range(3) for x, y in zip([t[k] for t in kinds], [t[k] for t in kinds][1:], strict=False)}
    doubled = sum(a[0] == b[0] for a, b in zip(kinds, kinds[1:], strict=False))
    assert len(index) == 3 * 8 + 3 * 7 + doubled and doubled == 2
    assert len(set(index.tolist())) == len({x for k in kinds for x in k}) + len(pairs) + 1


def test_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    wide = docs.withColumn("label", docs.lang).withColumn("of", docs.lang).withColumn("h", docs.lang)
    model = op.fit(wide, labels, lambda k: k.isNotNull())
    rows = op.with_quality(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    clash = docs.withColumn("Score", docs.text).withColumn("predicted", docs.lang).withColumn("held_out", docs.doc_id)
    assert op.with_quality(clash, model).columns == ["doc_id", "lang", "source", "n_chars", "held_out", "score", "predicted"]
    assert sorted(r.score for r in op.with_quality(clash, model).collect()) == sorted(r.score for r in rows)
    texts = lambda f: f.withColumn("doc_id", f.doc_id.cast("string"))
    named = op.fit(texts(wide), texts(labels), lambda k: k.isNotNull())
    assert {r.doc_id for r in op.with_quality(texts(clash), named).collect()} == {"0", "1", "2", "3", "4", "5", None}
    none = op.fit(docs, labels.limit(0), lambda k: k.isNotNull())
    assert {r.score for r in op.with_quality(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert op.with_quality(docs.limit(0).select("doc_id", "text"), none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no tables")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in op.query(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in rows) >= 0.9 * len(rows)
