from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from brinewave.llm import op7_minhash_dedup as op
from brinewave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """doc_id -> (n_shingles, component) by all pairs."""
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    u, w = sorted((find(a), find(b)))
                    parent[w] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


def same(spark, rows, exact=False):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op.label_documents(frame, exact=exact).collect()}
    expect = brute(rows)
    assert found == expect
    kept = {r.doc_id for r in op.drop_near_duplicates(frame).collect()}
    assert kept == {i for i, (_, c) in expect.items() if c == i}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_equals_all_pairs(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(60), []
    base, short = fresh(220), fresh(40)
    texts += [edited(rng, base, rng.randrange(0, 9)) for _ in range(60)]  # around the threshold
    texts += [passage + fresh(rng.choice([3, 6, 10, 20, 80])) for _ in range(60)]  # a common passage
    chain = fresh(120)
    for _ in range(25):  # neighbours alike, ends not
        texts.append(chain)
        chain = chain[4:] + fresh(4)
    texts += [edited(rng, short, rng.randrange(0, 3)) for _ in range(20)] + [short[:4], short[:4], short[:3], ["x"], [], ["X", "x"]]
    texts += [fresh(rng.randrange(1, 300)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, " ".join(t).title() if i % 2 else " ".join(t)) for i, t in enumerate(texts)] + [(0, None)]
    same(spark, rows)


def test_large_groups_of_sets_just_retained_whole(spark):
    """A text and many that add words of their own to it: 385 to 455 shingles."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (385, 400, 420, 450):
        core = fresh(345)
        texts += [core] + [core + fresh(n - 341) for _ in range(90)]
    rng.shuffle(texts)
    same(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])


@pytest.mark.parametrize("exact", [False, True])
def test_many_variants_on_both_sides_of_the_threshold(spark, exact, monkeypatch):
    """Hundreds of variants of a text of more shingles than the second sketch
    holds, many of them too far from each other: pairs asked stay few."""
    rng = random.Random(13)
    base = [f"b{rng.randrange(10**6)}" for _ in range(700)]
    texts = [" ".join(edited(rng, base, rng.randrange(70))) for _ in range(300)]
    asked = []
    links = op.links
    monkeypatch.setattr(op, "links", lambda pairs, *a: asked.append(pairs.count()) or links(pairs, *a))
    same(spark, list(enumerate(texts)), exact)
    assert sum(asked) < 2 * 30 * 300  # twice, as same() labels twice; all pairs would be 2 * 44,850


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    same(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()])


def test_edges(spark, docs):
    wide = docs.withColumn("key", docs.lang).withColumn("rep", docs.lang).withColumn("n", docs.lang).withColumn("of", docs.lang)
    rows = op.label_documents(wide).collect()
    assert len(rows) == 8 and sum(r.doc_id is None and r.component_id is None and r.kept for r in rows) == 1
    assert all(r.component_id == r.doc_id for r in rows)
    kept = op.drop_near_duplicates(wide)
    assert kept.columns == wide.columns and kept.count() == 8
    assert op.label_documents(docs.limit(0)).count() == 0 and op.drop_near_duplicates(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t"), (2, "a b c d e f"), (3, "p q r s t")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in op.label_documents(twice).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert found[start] == min(seen)
    assert set(found) == set(near)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_in_one_task_equal_many(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 - i, 1001 - i) for i in range(90)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    few, many = components(frame, count=len(edges)), components(frame)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert components(frame.limit(0), count=0).count() == 0
    # rounds of merges are put together without a join for each, which would
    # double the plan with every round
    chain, texts, found = [f"w{i}" for i in range(120)], [], []
    for i in range(30):
        texts.append((i, " ".join(chain)))
        chain = chain[4:] + [f"x{i}-{k}" for k in range(4)]
    real = op.representative_components
    monkeypatch.setattr(op, "representative_components", lambda *a: found.append(real(*a)) or found[-1])
    same(spark, texts)
    assert "Join" not in found[0]._jdf.queryExecution().logical().toString()
    monkeypatch.setattr("brinewave.llm.components.FEW_EDGES", 0)
    same(spark, texts)
