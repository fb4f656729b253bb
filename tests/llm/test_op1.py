from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

from brinewave.llm import op1_quality_rules as op

sys.path.insert(0, str(Path(__file__).parent))
from oracle import duck  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", "ä\x85ö\x1cü # é", "x " * 9]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "b", "éé", " ", " ", "\n", "\t", "#|", " a b a b a b a b a"]) for _ in range(rng.randrange(90))))
    found = op.measure([None if t is None else t.encode() for t in texts])
    assert [tuple(int(found[m][i]) for m in op.MEASURES) for i in range(len(texts))] == [brute(t) for t in texts]


def test_judge_edges(spark, docs):
    rows = {r.doc_id: r for r in op.judge(docs).collect()}
    assert len(op.judge(docs).collect()) == 8
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[3].n_words == 20_000 and not rows[3].base_failed
    assert rows[0].n_repeat_words == 30 and rows[0].base_failed
    assert rows[5].n_dup_lines == 1


def test_bad_host_is_rejected_and_clean_ones_stay(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 else "x", f"h{i % 7}") for i in range(700)] + [(1000 + i, "x" if i % 20 else good, "bad") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in op.apply_rules(docs).collect()}
    assert kept == {r.doc_id for r in op.judge(docs).filter("kept").collect()}
    assert kept == {i for i, t, h in rows if t == good and h != "bad"}


def test_host_is_judged_by_the_prior(spark):
    """Hosts with low rates, and one with a high one, that is still below the
    highest bound: the prior's tail tells it. Many small hosts with one failure
    of three are shrunk to the rest and stay."""
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 50 else "x", f"h{i % 20}") for i in range(4000)] + [(10_000 + i, "x" if i % 3 == 0 else good, "odd") for i in range(300)]
    rows += [(20_000 + 3 * i + k, good if k else "x", f"small{i}") for i in range(3) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r.doc_id: r for r in op.judge(docs).collect()}
    assert op.MIN_HOST_RATE < judged[10_000].host_rate < op.MAX_HOST_RATE
    assert {i for i, r in judged.items() if r.kept} == {i for i, t, h in rows if t == good and h != "odd"} == {r.doc_id for r in op.apply_rules(docs).collect()}
    table = docs.toPandas()
    assert sorted(map(tuple, judged.values())) == sorted(duck(op.ORACLE_SQL, documents=table))


def test_extra_columns_and_empty(spark, docs):
    wide = docs.withColumn("host", docs.source).withColumn("kept", docs.doc_id).withColumn("n_words", docs.doc_id)
    assert op.apply_rules(wide).columns == wide.columns
    assert {r.doc_id for r in op.apply_rules(wide).collect()} == {r.doc_id for r in op.judge(wide).collect() if r.kept}
    empty = docs.limit(0)
    assert op.judge(empty).count() == 0 and op.apply_rules(empty).count() == 0


def test_oracle(spark, docs):
    for frame in (docs, docs.limit(0)):
        table = frame.select("doc_id", "source", "text").toPandas().astype({"doc_id": "Int64"})
        assert sorted(map(tuple, op.judge(frame).collect()), key=str) == sorted(duck(op.ORACLE_SQL, documents=table), key=str)


def test_batches_that_are_cut(spark):
    """Texts that fill more than one slice of an Arrow batch."""
    docs = spark.range(9000).coalesce(1).selectExpr("id as doc_id", "if(id % 7 = 0, 'x', array_join(transform(sequence(1, 250), i -> concat('w', id, 'x', i)), ' ')) as text", "concat('h', id % 3) as source")
    kept = op.apply_rules(docs).collect()
    assert [r.doc_id for r in kept] == [i for i in range(9000) if i % 7]
    assert all(r.text.startswith(f"w{r.doc_id}x1 ") and r.source == f"h{r.doc_id % 3}" for r in kept)
