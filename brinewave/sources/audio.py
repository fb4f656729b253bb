"""Recordings as DataFrames: WAV files, and tables that stand in for them.

A signals frame has recording_id, sample_rate and samples (array<double>, one
channel); ragged lengths stay ragged.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HEADER = "path string, sample_rate int, num_frames long, channels int, bits int, error string"


def base_name(path: Column) -> Column:
    """The part after the last slash of either kind."""
    return F.regexp_extract(path, r"([^\\/]+)$", 1)


def recorded_at(name: Column) -> Column:
    """Time of ``<device>.<yyMMddHHmmss>.wav``; null for other names."""
    return F.try_to_timestamp(F.regexp_extract(name, r"^[^.]+\.(\d{12})\.wav$", 1), F.lit("yyMMddHHmmss"))


def device_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^([^.]+)\.\d{12}\.wav$", 1)


def wav_files(spark: SparkSession, root: str, name: str = "*.wav") -> DataFrame:
    """path, length, content of every WAV file below ``root``, or of the one called
    ``name``, as no other file is read then; order by path for an order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path", "length", "content")


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """A mono file of 16 bits; samples beyond [-1, 1) are clipped."""
    scaled = np.asarray(x, float) * 32768
    pcm = np.clip(np.trunc(scaled + np.copysign(0.5, scaled)), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(pcm))
    return head + pcm


def as_files(signals: DataFrame) -> DataFrame:
    """path, length, content: signals as the WAV files they would be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [wav_bytes(x, rate) for rate, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in content], pa.int64()), pa.array(content, pa.binary())], names=["path", "length", "content"])

    rows = signals.select(F.concat(F.col("recording_id").cast("string"), F.lit(".wav")).alias("path"), "sample_rate", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))
    return rows.mapInArrow(run, "path string, length long, content binary")


def check_signals(signals: DataFrame) -> DataFrame:
    """The frame itself; an error where it isn't one of signals."""
    kinds = dict(signals.dtypes)
    wrong = [c for c, want in (("recording_id", None), ("sample_rate", "int"), ("samples", "array<double>")) if c not in kinds or want not in (None, kinds[c])]
    if wrong:
        raise ValueError(f"not a signals frame: {', '.join(wrong)} missing or of another type")
    return signals


def riff(content: bytes) -> tuple[int, int, int, int, int, int]:
    """rate, channels, bits, format (1 PCM, 3 float), start and length of the samples."""
    content = memoryview(content)
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, found = 12, None
    while at + 8 <= len(content):
        name, size = bytes(content[at : at + 4]), struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack_from("<H", content, at + 8 + 24)[0]
            found = (rate, channels, bits, kind)
        elif name == b"data":
            if found is None:
                raise ValueError("samples before their format")
            return (*found, at + 8, min(size, len(content) - at - 8))
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode(content: bytes, skip_secs: float = 0.0, max_secs: float | None = None, channel: int = 0) -> tuple[int, np.ndarray]:
    """Rate and one channel as doubles in [-1, 1); only the part that is asked for is converted."""
    rate, channels, bits, kind, start, size = riff(content)
    width = bits // 8 * channels
    first = int(skip_secs * rate)
    last = size // width if max_secs is None else min(size // width, first + int(max_secs * rate))
    raw = memoryview(content)[start + first * width : start + max(first, last) * width]
    if kind == 3:
        x = np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}") / float(1 << (bits - 1))
    return rate, x[channel::channels] if channels > 1 else x


def probe(files: DataFrame) -> DataFrame:
    """Header fields of each file; what is wrong with a broken one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rate, channels, bits, _, _, size = riff(content)
                    rows.append((path, rate, size // (bits // 8 * channels), channels, bits, None))
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "sample_rate", "num_frames", "channels", "bits", "error"])

    return files.select("path", "content").mapInArrow(run, HEADER)


def read_recordings(files: DataFrame, skip_secs: float = 0.0, max_secs: float | None = None, channel: int = 0) -> DataFrame:
    """Signals of the files, a file at a time, so that a task holds one recording.

    As with :func:`brinewave.operators.signals.crop_head`, a file no longer than
    the skipped head is one zero sample. Broken files are left out; see
    :func:`probe`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rate, x = decode(content.as_py(), skip_secs, max_secs, channel)
                except (ValueError, struct.error):
                    continue
                x = x if len(x) or not skip_secs else np.zeros(1)
                name = path.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.replace("\\", "/").rsplit("/", 1)[-1]]), pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.float64())), pa.array([name])],
                    names=["recording_id", "sample_rate", "samples", "path"],
                )

    return files.select("path", "content").mapInArrow(run, "recording_id string, sample_rate int, samples array<double>, path string")


def map_recordings(files: DataFrame, fn: Callable[[int, np.ndarray], dict[str, object]], schema: str, skip_secs: float = 0.0, max_secs: float | None = None, channel: int = 0) -> DataFrame:
    """recording_id and what ``fn`` makes of (rate, samples) of each file, in the
    stage that decodes it: samples never leave the Python worker. ``schema`` is
    that of the result's columns. Broken files are left out."""
    kinds = to_arrow_schema(StructType.fromDDL("recording_id string, " + schema))
    names = kinds.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = fn(*decode(content.as_buffer(), skip_secs, max_secs, channel))
                except (ValueError, struct.error):
                    continue
                rows.append({"recording_id": path.as_py().replace("\\", "/").rsplit("/", 1)[-1]} | {n: found[n] for n in names})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, "recording_id string, " + schema)


def signals_of_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rate: int = 64) -> DataFrame:
    return vectors.select(F.col(key).alias("recording_id"), F.lit(rate).alias("sample_rate"), F.col(vector).cast("array<double>").alias("samples"))


def samples_of_events(events: DataFrame) -> DataFrame:
    """recording_id (the user), position keys and amplitude, long form, not centred."""
    return events.select(F.col("user_id").alias("recording_id"), "ts", "event_id", F.col("value").cast("double").alias("amplitude"))
