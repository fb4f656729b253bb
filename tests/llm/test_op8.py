from __future__ import annotations

import base64
import hashlib
import sys
from pathlib import Path

import pytest
import zstandard
from brinewave.llm import op8_warc as op
from brinewave.llm.common import new_folder

sys.path.insert(0, str(Path(__file__).parent))
from oracle import duck  # noqa: E402


def expect(rows, least=0):
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == b and p is not None]
        first = max(same, default=None)
        revisit = page is not None and len(b) >= least and page < first
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a\r\n/4", "<p>x</p>"), (5, "", "é" * 60_000), (4, "http://a/4", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, None, None), (9, "u", "\r\n\r\nWARC/1.1\r\n")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("sha", op.F.lit(1)).withColumn("size", op.F.lit(1))
    for least in (0, 5, 10**6):
        index = op.write_archives(pages, new_folder(spark, "test"), least, frame_bytes=100, bundle_bytes=300)
        rows = op.read_archives(index, payload=True).collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == expect(ROWS, least)
        assert sorted(bytes(r.payload) for r in rows if r.record_type == "response" and r.page_id == 5) == [("é" * 60_000).encode()]
        one = op.read_archives(index.filter("page_id = 9"), payload=True).collect()
        assert [bytes(r.payload) for r in one] == [b"\r\n\r\nWARC/1.1\r\n"]
        # every record, of null ids as well, is found by its identifier
        ids = [r.record_id for r in index.collect()]
        assert len(set(ids)) == 8 and op.record_id(9) in ids  # one id is there twice
        nameless = index.filter("page_id is null")
        assert sorted(op.read_archives(index.filter(index.record_id.isin([r.record_id for r in nameless.collect()]))).collect()) == sorted(op.read_archives(nameless).collect())
    empty = op.write_archives(pages.limit(0), new_folder(spark, "test"))
    assert empty.count() == 0 and op.read_archives(empty).count() == 0


def test_bundle_is_plain_zstandard(tmp_path):
    bundle = op.Bundle(f"file://{tmp_path}")
    assert [bundle.add([b"one", b"two"]), bundle.add([b"three" * 1000])] == [0, 1]
    bundle.close()
    data = Path(bundle.uri.removeprefix("file://")).read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"onetwo" + b"three" * 1000
    reader = op.Reader(bundle.uri)
    assert reader.frame(1) == b"three" * 1000 and reader.frame(0) == b"onetwo"


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    pages = spark.read.parquet(f"{d}/pages.parquet")
    assert sorted(map(tuple, op.query(spark, d).collect())) == sorted(duck(op.ORACLE_SQL, pages=pages.toPandas()))
