from __future__ import annotations

import math
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from brinewave.llm import op10_license_scan as op

sys.path.insert(0, str(Path(__file__).parent))
from oracle import duck  # noqa: E402


def brute(rows):
    """(key, path, text) rows -> results, by dictionaries."""
    tokens = lambda t: re.findall(op.TERM, (t or "").lower())
    n, df = len(rows), Counter()
    for _, _, text in rows:
        df.update(set(tokens(text)) & set(op.VOCABULARY))
    idf = lambda t: math.log((n + 1) / ((df[t] if t in op.VOCABULARY else 1) + 1)) + 1
    vec = lambda t: {w: c * idf(w) for w, c in Counter(tokens(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best, dirs = [], {}
    for _, path, text in rows:
        text = text or ""
        named = path is not None and bool(re.match(op.LICENCE_NAME, path.rsplit("/", 1)[-1]))
        cued = lambda parts: [x for x in parts if re.search(op.CUE, x)]
        blocks = [x for x in re.split(op.BREAK, text) if named or re.search(op.CUE, x)]
        near = []
        for block in blocks:
            at = block.split("\n")
            starts = [max(i - op.BEFORE, 0) for i, x in enumerate(at) if re.search(op.CUE, x)]
            near += ["\n".join(at[i : i + op.SPAN]) for i in starts] if len(at) > op.SPAN else [block]
        found, singles, most = [], 0, 0
        for part in dict.fromkeys(cued(text.split("\n")) + near + [text] * named):
            v = vec(part)
            number = lambda t, p: re.sub(r"\.0$", "", (re.search(p, t.lower()) or [0, ""])[1])
            said, tag = number(part, op.VERSION), re.sub(r"(-only|-or-later|\+)$", "", (re.search(op.TAG, part.lower()) or [0, ""])[1])
            fits = lambda t: said in ("", n) or n == "" if (n := number(t, r"-([0-9]+(?:\.[0-9]+)*)$")) is not None else False  # noqa: B023, E731
            scores = [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), 9), name) for name, forms in op.TEMPLATES.items() if fits(name) and tag in ("", name.lower()) for u in map(vec, forms) if v]
            if scores and -min(scores)[0] >= op.MIN_COSINE:
                found.append(min(scores))
                singles, most = singles + len(part.split()) * ("\n" not in part), max(most, len(part.split()))
        best.append(min(found, key=lambda x: (x[1] == "Proprietary", x), default=None))
        if found and path is not None and (named or max(singles, most) >= op.FILE_SHARE * len(text.split())):
            d = path.rsplit("/", 1)[0] if "/" in path else ""
            dirs[d] = min(dirs.get(d, (1, "")), best[-1])
    out = []
    for (key, path, _), own in zip(rows, best, strict=True):
        if own:
            out.append((key, own[1], -own[0], "own", None))
            continue
        parts = [] if path is None else path.split("/")[:-1]
        above = [] if path is None else [*("/".join(parts[:k]) for k in range(len(parts), 0, -1)), ""]
        near = next((d for d in above if d in dirs), None)
        out.append((key, None, None, None, None) if near is None else (key, dirs[near][1], -dirs[near][0], "inherited", near))
    return out


MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
BODY = " ".join(f"code{i}" for i in range(60))
ROWS = [
    (1, "a/LICENSE", MIT), (2, "a/b/x.py", BODY), (3, "a/b/c/y.py", BODY + "\n# " + APACHE), (4, "a/b/c/z.py", "x"), (5, "a/b/COPYING.txt", GPL + "\n" + GPL), (6, "a/b/c/d/e.py", None),
    (7, None, BODY), (8, None, MIT), (9, "top.py", ""), (10, "z/q.py", BODY + "\nThe licence of words is no licence of any kind here, say twenty people."), (10, "z/q.py", BODY), (10, "z/q.py", BODY),
    (11, "z/w/short.txt", "hi\n" + APACHE), (12, "z/w/v/u.py", " ".join(f"w{i}" for i in range(20_000))), (None, "a/n.py", "text"), (13, "a/b/NOTICE", "Nothing that is known"), (14, "/abs/LICENSE.md", MIT), (15, "/abs/k/f.c", "f"),
]


def test_equals_dictionaries(spark):
    files = spark.createDataFrame(ROWS, "k long, p string, text string").withColumn("id", op.F.lit(1)).withColumn("path", op.F.col("text")).withColumn("dir", op.F.lit(2))
    found = sorted(map(tuple, op.scan(files, "k", "p").collect()), key=str)
    assert found == sorted(brute(ROWS), key=str)
    assert op.scan(files.limit(0), "k", "p").count() == 0


def test_root_licence(spark):
    rows = [(1, "LICENSE", MIT), (2, "a/b.py", "x"), (3, "c.py", None)]
    files = spark.createDataFrame(rows, "k long, p string, text string")
    assert sorted(map(tuple, op.scan(files, "k", "p").collect()), key=str) == sorted(brute(rows), key=str)


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_real_licence_texts(spark):
    """A directory with a real text is licensed, and of no wrong version."""
    d = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "Artistic": None}
    texts = {"MIT": (MIT_TEXT, "MIT")} | {k: ((d / k).read_text(), v) for k, v in want.items() if (d / k).exists()}
    rows = [(f"{k}/LICENSE", t) for k, (t, _) in texts.items()] + [(f"{k}/src/a.py", "x = 1") for k in texts] + [(f"other/{i}.py", f"the words of a file {i} in this form") for i in range(500)]
    files = spark.createDataFrame(rows, "p string, text string")
    found = {r.p: (r.license, r.license_from) for r in op.scan(files, "p", "p").collect()}
    assert set(want) - {"Artistic"} <= {*texts, "MPL-2.0"} or not d.exists()
    for k, (_, name) in texts.items():
        assert found[f"{k}/LICENSE"] == (name, name and "own"), k
        assert found[f"{k}/src/a.py"] == (name, name and "inherited"), k


def test_headers_over_lines_and_tags(spark):
    header = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
x = 1
"""
    rows = [(f"s{v}.py", header.format(v)) for v in (2, 3)] + [("mit.c", "// SPDX-License-Identifier: MIT\nint x;"), ("gpl.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */"), ("odd.c", "// SPDX-License-Identifier: Nobody-1.0\nint x;")]
    rows += [("long.py", "\n".join(f"line {i} of text" for i in range(90)) + "\n" + header.format(2).split("#\n")[0] + "\n".join(f"x{i} = {i}" for i in range(90)))]
    rows += [("apache.py", "\n".join("# " + x for x in op.TEMPLATES["Apache-2.0"][3].split("\n")) + "\n\nimport os"), ("free.txt", op.TEMPLATES["BSD-2-Clause"][2]), ("free3.txt", op.TEMPLATES["BSD-3-Clause"][4])]
    want = {"long.py": "GPL-2.0", "s2.py": "GPL-2.0", "s3.py": "GPL-3.0", "mit.c": "MIT", "gpl.c": "GPL-3.0", "odd.c": None, "apache.py": "Apache-2.0", "free.txt": "BSD-2-Clause", "free3.txt": "BSD-3-Clause"}
    rows += [(f"other/{i}.py", f"the words of a file {i} in this form, and a version of it") for i in range(200)]
    found = op.scan(spark.createDataFrame(rows, "p string, text string"), "p", "p").collect()
    assert {r.p: r.license for r in found if r.p in want and r.license_from != "inherited"} | {r.p: None for r in found if r.license_from == "inherited" and r.p == "odd.c"} == want
    assert sorted(map(tuple, found), key=str) == sorted(brute([(p, p, t) for p, t in rows]), key=str)


def test_no_python_in_the_plan(spark, docs):
    plan = op.scan(docs, "doc_id", "source")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    for d in (d, d.replace("0.001", "0.01")):
        frame = spark.read.parquet(f"{d}/documents.parquet").toPandas()
        rows = op.query(spark, d).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(duck(op.ORACLE_SQL, documents=frame), key=str)
    # licences reach files in directories below
    below = [r for r in rows if r.license_dir and r.license_dir.count("/") < 2 and r.doc_id // 20 % 10 > 1]
    assert len(below) > 10
