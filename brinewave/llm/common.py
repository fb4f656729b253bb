"""Helpers shared by the operators: whole-text word hashing, durable
intermediates, and hashing that gives the same values on every executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests, notebooks) a temporary folder is
    made and set as the checkpoint folder; executors elsewhere could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brinewave-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/brinewave/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage without relying on executor-local copies: losing an
    executor later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return _reread(spark, path, df)


def stash_counted(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """As :func:`stash`, with the number of rows and an order-free checksum of
    them, which are observed as they are written."""
    spark = df.sparkSession
    path, seen = new_folder(spark, label), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.shiftright(F.xxhash64(*df.columns), 24)), F.lit(0)).alias("s")).write.parquet(path)
    return _reread(spark, path, df), int(seen.get["n"]), int(seen.get["s"])


def _reread(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    found = spark.read.schema(df.schema).parquet(path)
    found.stash_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Remove what :func:`stash` wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "stash_path", None):
            drop_folder(df.sparkSession, path)


# ------------------------------------------------------------------ columns


def other_columns(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for those with one of ``names``, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def word_count(text: Column) -> Column:
    """Words of the whole text (null: 0), JVM-side.

    Every word starts at a word character that follows the start or a
    separator; collapsing separators and counting the gaps is cheaper than
    extracting the words.
    """
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.coalesce(F.when(F.length(flat) == 0, F.lit(0)).otherwise(F.size(F.split(flat, " +"))), F.lit(0)).cast("long")


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo ``modulus``; null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


# ------------------------------------------------------------- word hashing


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; x is uint64."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x = x ^ (x >> _U(33))
    x = x * _M2
    return x ^ (x >> _U(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One stable 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: Multipliers without arithmetic structure: steps of a line would make
#: windows with permuted words collide.
_ODD = list(mix(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; order-sensitive."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] * _ODD[0]
    for j in range(1, width):
        out += words[j : j + n] * _ODD[j]
    return mix(out)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


#: Rows of a batch that goes to Python, at most: with texts of some kilobytes a
#: batch is of some megabytes, on either side.
ARROW_ROWS = 1000


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of rows that carry texts; a session's smaller
    bound holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, ARROW_ROWS)
    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with at most about ``limit`` bytes in ``column`` (one row at least),
    so that what a worker holds besides the batch stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col.cast(pa.large_binary())), 0))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


# ---------------------------------------------------------------- training rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, bound: int, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """h, label, text of about ``bound`` labelled rows, chosen by hash of the key.

    The labels are thinned before they meet the texts, so the side that is
    broadcast has a size bound (``bound`` plus six deviations) whatever the
    size of either table, and the texts are not shuffled. ``usable`` maps the
    key's column to the condition under which a row may be learned from.
    """
    rows = labels.select(F.col(key).alias("of"), F.col(label).cast("int").alias("label")).filter(usable(F.col("of")) & F.col("label").isin(0, 1) & F.col("of").isNotNull())
    n = rows.count()
    share = min(1.0, (bound - 3 * bound**0.5) / max(n, 1))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("of"), F.lit(seed)), 33)
    thin = rows.withColumn("h", hashed).filter(F.col("h") < int(share * (1 << 31)) + 1)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.join(F.broadcast(thin), F.col("key") == F.col("of")).select("h", "key", "label", F.coalesce("text", F.lit("")).alias("text"))
