from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

from brinewave.llm import op3_mixing as op

sys.path.insert(0, str(Path(__file__).parent))
from oracle import duck  # noqa: E402


def reshare(sizes, weights, total, most):
    out, free, left = [None] * len(sizes), set(range(len(sizes))), total
    while free:
        over = {i for i in free if left * weights[i] / sum(weights[j] for j in free) > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / sum(weights[j] for j in free)
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def test_targets_equal_resharing(spark):
    rng = random.Random(5)
    for k in range(8):
        n = rng.randrange(1, 9) if k else 400
        sizes = [rng.choice([0, 1, 7, 100, 5000]) for _ in range(n)]
        weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(n)]
        names = sorted(f"{rng.randrange(10**6)}é" for _ in range(n - 1)) + [None]
        frame = spark.createDataFrame([(s, x) for s, m in zip(names, sizes, strict=True) for x in (m // 2, m - m // 2)], "source string, size long")
        for share in (1.5, 2.5):
            found = {r.of: (r.source_size, r.target) for r in op.source_targets(frame, share=share).collect()}
            for s, m, t in zip(names, sizes, reshare(sizes, weights, share * sum(sizes), 2.0), strict=True):
                assert found[s][0] == m and abs(found[s][1] - t) <= 1e-9 * max(1, t)


def test_rows_that_share_an_id(spark):
    """Equal ids with other texts, null ids, and equal rows: as many copies as decided."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, i]), f"t{rng.randrange(40)} " * rng.choice([3, 3, 8, 20]), rng.choice(["a", "b", None]), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    decided = Counter()
    for r in op.copies(op.sized(docs)).collect():
        decided[r.key, r.source, r["size"]] += r.copies
    out = op.sample_mix(docs)
    assert out.columns == [*docs.columns, "copy"]
    taken = Counter((r.doc_id, r.source, len(r.text.split())) for r in out.collect())
    assert taken == +decided
    clash = docs.withColumn("Copy", docs.row).withColumn("taken_key", docs.text).withColumn("taken_row", docs.text)
    again = op.sample_mix(clash)
    assert again.columns == [*docs.columns, "taken_key", "taken_row", "copy"] and again.count() > 0
    times, whole = Counter(rows), Counter(tuple(r)[:4] for r in out.collect())
    assert set(whole) <= set(times) and all(n <= 2 * times[r] for r, n in whole.items())


def test_mix_edges_and_oracle(spark, docs):
    for frame in (docs, docs.limit(0), docs.withColumn("size", docs.doc_id).withColumn("copies", docs.doc_id).withColumn("of", docs.source)):
        rows = op.mix(frame).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(duck(op.ORACLE_SQL, documents=frame.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})), key=str)
        assert all(r.taken <= 2 * r["size"] for r in rows)


def test_words_come_near_target(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 300), f"s{min(i % 11, 6)}" if i % 50 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op.mix(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, op.mix(docs.repartition(7)).collect()))
    by, source = defaultdict(list), {i: s for i, _, s in rows}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((i, t) for i, t, _ in rows[r.doc_id : r.doc_id + 1])[r.doc_id]))
        by[source[r.doc_id]].append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 0.01 * group[0].target + 300
    taken = sum(r["size"] for r in op.sample_mix(docs).withColumn("size", op.word_count(docs.text)).collect())
    assert taken == sum(r.taken for r in out)
