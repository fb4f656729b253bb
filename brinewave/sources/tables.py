"""CSV tables and manifests that go with recordings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import base_name

RUNTIMES = "function string, max_points string, n_obs int, batch_size double, n_cores double, runtime_sec double"
CANDIDATES = "file_path string, peak_ampl double, ampl_frac double"
STATS = "filename string, duration_sec double, peak_abs double, mean_abs double, rms double, zcr_hz double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``, which ``df`` may itself read: written beside
    it first, and moved when it is whole."""
    _swap(df.sparkSession, path, lambda beside: df.write.csv(beside, header=True))


def write_features(df: DataFrame, path: str) -> None:
    """Replace the feature table at ``path`` (Parquet) in the same way."""
    _swap(df.sparkSession, path, df.write.parquet)


def _swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    write(beside)
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path} could not be replaced; the new table is at {beside}")


def clean_points(df: DataFrame, column: str = "max_points") -> DataFrame:
    """Numbers written as ``10,000``, ``100`` or ``inf``, as doubles."""
    plain = F.regexp_replace(column, ",", "")
    return df.withColumn(column, F.when(F.lower(plain) == "inf", F.lit(float("inf"))).otherwise(plain.try_cast("double")))


def corruption_manifest(spark: SparkSession, path: str) -> DataFrame:
    """reason, path and file name of the lines ``<reason> : <path>``."""
    line = r"^(.+?) : (.+)$"
    found = spark.read.text(path).filter(F.col("value").rlike(line))
    return found.select(F.regexp_extract("value", line, 1).alias("reason"), F.regexp_extract("value", line, 2).alias("file_path")).withColumn("filename", base_name(F.col("file_path")))


def append_rows(df: DataFrame, entry: DataFrame) -> DataFrame:
    """Rows put together by column name; missing columns are null."""
    return df.unionByName(entry, allowMissingColumns=True)
