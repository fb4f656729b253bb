"""WARC archives as seekable Zstandard bundles.

Writing: rows are grouped into independent Zstandard frames; a bundle ends with
a seek table in a skippable frame (the public seekable format: magic
0x184D2A5E, an entry of compressed and decompressed size for each frame, and a
footer of the number of frames, a descriptor and 0x8F92EAB1). Each task writes
bundles of its own under unique names and returns an index row for each record:
its WARC-Record-ID, bundle, frame, offset within the frame, length. The index is a table that Spark
commits, so a bundle of a failed or repeated task is in no index and is never
read.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with
the largest id is a ``response`` and the others are ``revisit`` records that
name it; smaller ones are all responses.

Reading: a frame is found through its bundle's seek table and decompressed
alone; records are cut out at the offsets of the index. Bundles are opened
through the file systems of pyarrow, by URI (file, hdfs, s3, gs), below the
folder that executors share; the input is read by Spark.

Defined results: a null html is an empty payload, and empty payloads are equal
to each other; a null id is written without an id and never refers or is
referred to, and is found by its record identifier; other columns of the pages
are not read, so their names cannot clash; a very long payload is a frame of its
own; rows that repeat the largest id with its payload are each a
response; an empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, new_folder, small_batches, stash, table, text_bytes

#: A frame is closed at this size of records, a bundle at that of frames.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 128 << 20
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlparse(uri).path
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(_SPACE, f'page:{page}')}>"


def clean(uri: str | None) -> str:
    """A header value on one line."""
    return " ".join((uri or "").split()) or "urn:none"


def record(identifier: str, page: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone as its block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {identifier}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean(uri)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, object]:
    """Header fields of one record, its payload, and the payload's full length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields: dict[str, object] = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload_bytes"] = int(http.rsplit(b"Content-Length: ", 1)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != fields["payload_bytes"] or "sha1:" + digest(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError("payload does not match its digest")
    return fields


class Bundle:
    """Writes frames and, when closed, the seek table."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = file_system(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, records: list[bytes]) -> int:
        data = b"".join(records)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.size += len(packed)
        self.frames.append((len(packed), len(data)))
        return len(self.frames) - 1

    def close(self) -> None:
        table_ = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table_)) + table_)
        self.out.close()


class Reader:
    """Random access to the frames of a bundle."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = np.frombuffer(self.file.read_at(8 * n, end - 9 - 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts, self.sizes = np.concatenate(([0], np.cumsum(sizes[:, 0]))), sizes
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed = self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k]))
        return self.unpacker.decompress(packed, max_output_size=int(self.sizes[k, 1]))


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary), refers_to (null: response).

    Digests and lengths are taken by the JVM from narrow rows, and only rows of
    ids and digests meet on a payload's digest. What the bodies are joined to has
    a row for each revisit, by its own id, so no body goes where its copies go.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("len")).filter((F.col("len") >= min_bytes) & F.col("page_id").isNotNull())
    narrow = stash(narrow, "op8-digests")
    copied = narrow.groupBy("sha", "len").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = stash(narrow.join(copied, ["sha", "len"]).filter("page_id < first").select(F.col("page_id").alias("of"), F.col("sha").alias("same"), "first").distinct(), "op8-revisits")
    rows = pages.select("page_id", "url", body.alias("html"))
    if not revisits.limit(1).count():
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    met = (rows["page_id"] == revisits["of"]) & (F.sha1(rows["html"]) == revisits["same"])
    return rows.join(revisits, met, "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write page_id, url, html as bundles below ``folder``; the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle: Bundle | None = None
        records: list[bytes] = []
        ids: list[tuple[str, int | None]] = []
        size = 0

        def frame() -> pa.RecordBatch:
            nonlocal size
            k = bundle.add(records)
            lengths = np.array([len(r) for r in records])
            out = pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in ids], pa.string()), pa.array([p for _, p in ids], pa.int64()), pa.array([bundle.uri] * len(ids)), pa.array([k] * len(ids), pa.int32()), pa.array(np.cumsum(lengths) - lengths, pa.int64()), pa.array(lengths, pa.int64())],
                names=["record_id", "page_id", "bundle", "frame", "offset", "length"],
            )
            records.clear()
            ids.clear()
            size = 0
            return out

        for batch in small_batches(batches, "html"):
            for page, url, html, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                bundle = bundle or Bundle(folder)
                identifier = record_id(page)
                records.append(record(identifier, page, url, html, refers))
                ids.append((identifier, page))
                size += len(records[-1])
                if size >= frame_bytes:
                    yield frame()
                    if bundle.size >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if records:
            yield frame()
        if bundle:
            bundle.close()

    return stash(in_arrow(with_references(pages, min_bytes), run, INDEX), "op8-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records behind rows of the index, one for each: any subset can be
    looked up. Frames, not bundles, are dealt out to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: tuple[str, Reader] | None = None
        held: tuple[tuple[str, int], bytes] | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for bundle, k, offset, length in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if reader is None or reader[0] != bundle:
                        reader = (bundle, Reader(bundle))
                    if held is None or held[0] != (bundle, k):
                        held = ((bundle, k), reader[1].frame(k))
                    x = parse(held[1][offset : offset + length])
                    page, refers = x.get("X-Page-ID"), x.get("X-Refers-To-Page-ID")
                    rows.append((None if page is None else int(page), x["payload_bytes"], x["WARC-Payload-Digest"].removeprefix("sha1:"), x["WARC-Type"], None if refers is None else int(refers), x["payload"]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: 5 + payload]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payload])

    located = index.select("bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return in_arrow(located, run, READ + (", payload binary" if payload else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "op8-archives")))


#: base32 of a SHA-1 is its 160 bits in groups of five.
ORACLE_SQL = """
WITH body AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), hashed AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM body
), firsts AS (
  SELECT h, n, max(page_id) AS first FROM hashed GROUP BY h, n
)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (CAST('0x' || substr(h || '00', 1 + (5 * i) // 4, 4) AS BIGINT) >> (11 - (5 * i) % 4)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM hashed JOIN firsts USING (h, n)
"""
