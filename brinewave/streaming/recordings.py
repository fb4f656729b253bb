"""Recordings as a stream: new WAV files below a folder become feature rows.

A batch reads the files that arrived since the last one; a file's features
depend on that file alone, so no state is kept and a restarted query goes on
from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import FeatureConfig
from ..operators.spectral import feature_vectors
from ..sources.audio import read_recordings

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def wav_stream(spark: SparkSession, root: str, files_per_batch: int = 64) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav")
    return reader.option("maxFilesPerTrigger", files_per_batch).load(root).select("path", "length", "content")


def stream_features(spark: SparkSession, root: str, out: str, checkpoint: str, config: FeatureConfig, skip_secs: float = 0.0) -> StreamingQuery:
    """Write recording_id and features as Parquet until what is there is read."""
    found = feature_vectors(read_recordings(wav_stream(spark, root), skip_secs), config)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
