from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
import test_op1  # noqa: E402
import test_op6  # noqa: E402
import test_op7  # noqa: E402
from brinewave.llm import op1_quality_rules, op3_mixing  # noqa: E402
from oracle import duck  # noqa: E402


def test_stages_equal_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {}
    for i, r in rows.items():
        n, *_, repeated = test_op1.brute(r.text)
        if n >= 20 and 100 * repeated <= 30 * n:
            left[i] = r  # no host of this table is rejected
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, d).collect()} == set(left)
    assert all(r.kept != r.base_failed for r in op1_quality_rules.judge(docs).collect())
    groups = test_op7.brute([(i, r.text) for i, r in left.items()])
    left = {i: r for i, r in left.items() if groups[i][1] == i}
    leaked = {a for (a, _), _ in test_op6.brute([(i, r.text) for i, r in left.items()], items)}
    left = {i: r for i, r in left.items() if i not in leaked}
    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*docs.columns, "copy"]
    frame = docs.filter(docs.doc_id.isin(list(left))).select("doc_id", "text", "source").toPandas()
    expect = {x[0]: x[4] // x[1] for x in duck(op3_mixing.ORACLE_SQL, documents=frame) if x[4]}
    found = out.collect()
    assert Counter(r.doc_id for r in found) == Counter(expect)  # clean texts all have a language
    assert all(r.text == rows[r.doc_id].text for r in found)


def test_stages_on_odd_rows(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs.withColumn("key", docs.lang).withColumn("hash", docs.lang), docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns + ["copy"] * (k == 4)
            assert out.count() <= 2 * frame.count()
