from __future__ import annotations

import sys
from collections import defaultdict
from pathlib import Path

import pytest
from brinewave.llm import op6_decontaminate as op

sys.path.insert(0, str(Path(__file__).parent))
from oracle import duck  # noqa: E402

ITEM = "Alice Weber bought 3 pounds of apples for 12 dollars. Yesterday Alice sold 3 pounds to Bob, so how many dollars did Alice spend on each of them?"


def canon(text, named_first=False):
    """Template token, raw slot and plain form, word by word."""
    out, start = [], not named_first
    for word in (text or "").encode().split():
        core = word.strip(op.PUNCT)
        low = core.lower()
        if op.NUMBER.match(low) or low in op.NUMBER_WORDS:
            kind = "<num>"
        elif low in op.UNITS:
            kind = "<unit>"
        elif not start and core[:1] != low[:1] and core[1:] == low[1:]:
            kind = "<name>"
        else:
            kind = None
        out.append((kind or low, core.decode() if kind else None, low))
        start = word[-1:] in b".!?:"
    return out


def window(w):
    """What is compared, and the slots."""
    if sum(s is None for _, s, _ in w) < op.MIN_LITERAL:
        return ("exactly", *(low for *_, low in w)), ()
    return tuple(t for t, *_ in w), tuple(s for _, s, _ in w if s)


def brute(docs, items):
    """(doc row's id and text, item id) of the leaks, document by document."""
    index, total = defaultdict(set), defaultdict(set)
    for i, text in set(items):
        for first in (False, True):
            c = canon(text, first)
            n = min(op.WIDTH, len(c))
            if n >= op.MIN_TOKENS:
                for p in range(1 if first else len(c) - n + 1):
                    key, slots = window(c[p : p + n])
                    index[key].add(((i, text), p, slots))
                    total[i, text].add(p)
    rich = {i: {p for key, rows in index.items() if key[0] != "exactly" for j, p, _ in rows if j == i} for i in total}
    out = set()
    for d, text in set(docs):
        c = canon(text)
        met = defaultdict(lambda: (set(), set(), set()))
        for n in range(op.MIN_TOKENS, op.WIDTH + 1):
            for p in range(len(c) - n + 1):
                key, own = window(c[p : p + n])
                for i, q, slots in index.get(key, ()):
                    if len(own) == len(slots):
                        at, pairs, templates = met[i, p - q]
                        at.add(q)
                        templates |= {q} if key[0] != "exactly" else set()
                        pairs.update(zip(slots, own, strict=True))
        covered, typed = defaultdict(set), defaultdict(set)
        for (i, _), (at, pairs, templates) in met.items():
            if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
                covered[i] |= at
                typed[i] |= templates
        for i, at in covered.items():
            if max(len(at) / len(total[i]), len(typed[i]) / max(len(rich[i]), 1)) >= op.MIN_COVERAGE or len(at) >= op.MIN_WINDOWS:
                out.add(((d, text), i[0]))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


def test_reparameterised_questions(spark):
    other = ITEM.replace("Alice", "Carol").replace("Weber", "Stone").replace(" 3 ", " 45 ").replace("12", "7.5").replace("Bob", "Dan").replace("pounds", "kg")
    broken = other.replace("Carol sold", "Erin sold")  # a name that changes on the way
    docs = [(1, "Some text before it. " + ITEM + " And after."), (2, "x y z. " + other), (3, "x y z. " + broken), (4, "Nothing of that kind is here, only words about apples and how many there are."), (5, None), (6, ""), (6, ITEM), (None, ITEM)]
    items = [(10, ITEM), (10, ITEM), (11, None), (12, "Short one"), (13, "")]
    a, b = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
    for most in (op.MAX_BROADCAST_WINDOWS, 3):
        rows = {(r.doc_id, r.item_id): r for r in op.leaks(a, b, max_broadcast=most).collect()}
        assert set(rows) == {(d, i) for (d, _), i in brute(docs, items)} == {(1, 10), (2, 10), (6, 10), (None, 10)}
        assert rows[1, 10].exact and not rows[2, 10].exact
        tables = {"documents": a.toPandas().astype({"doc_id": "Int64"}), "benchmark": b.toPandas()}
        assert sorted(map(tuple, rows.values()), key=str) == sorted(duck(op.ORACLE_SQL, **tables), key=str)
    kept = op.drop_contaminated(a.withColumn("hash", a.text).withColumn("pos", a.text), b)
    assert kept.columns == ["doc_id", "text", "hash", "pos"] and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert op.leaks(a.limit(0), b).count() == 0 and op.leaks(a, b.limit(0)).count() == 0


def test_long_text_and_short_items(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, long + " alpha beta gamma delta epsilon " + long), (2, "alpha beta gamma delta")]
    items = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta"), (3, long[-400:])]
    assert {(r.doc_id, r.item_id) for r in op.leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()} == {(d, i) for (d, _), i in brute(docs, items)} == {(1, 1), (1, 3)}


def test_rows_that_share_an_id_are_told_apart(spark):
    """The same item at the same offset with other values, under one id or none."""
    others = [ITEM.replace("Alice", a).replace(" 3 ", f" {n} ").replace("12", f"{n}1") for a, n in (("Carol", 45), ("Dora", 7))]
    clean = "Nothing of that kind is here, only words about apples and how many there are."
    for key in (5, None):
        docs = [(key, x) for x in (*others, others[0], clean, None, "")]
        items = [(10, ITEM), (10, "Another question of the same id, which nobody has copied into any text that we know of."), (None, ITEM)]
        a, b = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
        for most in (op.MAX_BROADCAST_WINDOWS, 3):
            rows = op.leaks(a, b, max_broadcast=most).collect()
            assert sorted((r.item_id or 0) for r in rows) == [0, 0, 10, 10] and len(brute(docs, items)) == 4
            assert all(r.doc_id == key and r.coverage > 0.9 and not r.exact for r in rows), rows
        tables = {"documents": a.toPandas().astype({"doc_id": "Int64"}), "benchmark": b.toPandas().astype({"item_id": "Int64"})}
        assert sorted(map(tuple, rows), key=str) == sorted(duck(op.ORACLE_SQL, **tables), key=str)
        assert sorted(r.text or "" for r in op.drop_contaminated(a, b).collect()) == ["", "", clean]


def test_first_word_few_plain_words_and_excerpts(spark):
    long = "Where " + " ".join(f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)) + " end"
    items = [(1, "Paris lies on which great river?"), (2, "Meyer Schulz Weber 14 27 Braun Vogel Otto 33 12"), (3, long)]
    docs = [(1, "so then Paris lies on which great river? and more"), (2, "xx Meyer Schulz Weber 14 27 Braun Vogel Otto 33 12 yy"), (3, "xx Meyer Schulz Weber 15 27 Braun Vogel Otto 34 12 yy"), (4, "zz " + " ".join(long.split()[30:55]) + " zz"), (5, "zz " + " ".join(long.split()[30:54]) + " zz")]
    a, b = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
    rows = op.leaks(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for (d, _), i in brute(docs, items)} == {(1, 1), (2, 2), (4, 3)}
    assert sorted(map(tuple, rows)) == sorted(duck(op.ORACLE_SQL, documents=a.toPandas(), benchmark=b.toPandas()))


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in op.query(spark, d).collect()}
    assert found == {(d, i) for (d, _), i in brute(docs, items)} and len(found) > 3
    plain = {(i, k) for i, t in docs for k, x in items if t and x in t}
    assert plain <= found
