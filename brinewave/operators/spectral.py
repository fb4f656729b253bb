"""Spectra and features of packed signals.

One Arrow stage each, a recording at a time: the window and the filters are
built once on the driver and travel with the function, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import dsp
from ..sources import audio


def mel_filterbank(spark: SparkSession, c: FeatureConfig) -> DataFrame:
    """mel, bin, weight: every filter and bin, zeros included."""
    w = dsp.mel_filters(c.n_fft, c.n_mels, c.rate, c.f_min, c.top, c.slaney_norm)
    return spark.createDataFrame([(m, b, float(w[m, b])) for m in range(w.shape[0]) for b in range(w.shape[1])], "mel int, bin int, weight double")


def filter_centers(filterbank: DataFrame, c: FeatureConfig) -> DataFrame:
    """The frequency of each filter's heaviest bin (null for an empty filter)."""
    best = filterbank.groupBy("mel").agg(F.max_by("bin", F.struct("weight", -F.col("bin"))).alias("bin"), F.max("weight").alias("weight"))
    return best.select("mel", F.when(F.col("weight") > 0, F.col("bin") * F.lit(c.rate / c.n_fft)).alias("center_freq"))


def map_signals(signals: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """recording_id, frame, bin, value of a function from samples to a matrix
    [bins, frames]: the hook for transforms of one's own."""
    key = signals.schema["recording_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column(1)[i].values
                m = fn(x.to_numpy(zero_copy_only=False)) if x is not None and len(x) else np.empty((0, 0))
                bins, n = m.shape
                if not m.size:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * (bins * n), batch.column(0).type), pa.array(np.tile(np.arange(n, dtype=np.int32), bins)), pa.array(np.repeat(np.arange(bins, dtype=np.int32), n)), pa.array(m.astype(float).ravel())],
                    names=["recording_id", "frame", "bin", "value"],
                )

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType().add("recording_id", key).add("frame", IntegerType()).add("bin", IntegerType()).add("value", DoubleType())
    return signals.select("recording_id", "samples").mapInArrow(run, schema)


def power_spectrogram(signals: DataFrame, c: FeatureConfig) -> DataFrame:
    return map_signals(signals, lambda x: dsp.spectrogram(x, c))


def decibels(signals: DataFrame, c: FeatureConfig) -> DataFrame:
    """Log-mel, or linear decibels where the configuration has no mel filters."""
    w = None if c.n_mels is None else dsp.mel_filters(c.n_fft, c.n_mels, c.rate, c.f_min, c.top, c.slaney_norm)
    return map_signals(signals, lambda x: dsp.features(x, c, w))


def top_decibels(signals: DataFrame, c: FeatureConfig, top_db: float = 80.0) -> DataFrame:
    w = None if c.n_mels is None else dsp.mel_filters(c.n_fft, c.n_mels, c.rate, c.f_min, c.top, c.slaney_norm)
    return map_signals(signals, lambda x: dsp.clamp_top(dsp.features(x, c, w), top_db))


def magnitude_spectrum(signals: DataFrame, n_fft: int, hop: int) -> DataFrame:
    return map_signals(signals, lambda x: dsp.magnitude_db(x, n_fft, hop))


def resampled(signals: DataFrame, new_rate: int, rate: int) -> DataFrame:
    if new_rate == rate:
        return signals

    @F.pandas_udf("array<double>")
    def convert(x):
        return x.map(lambda v: dsp.resample(np.asarray(v, float), rate, new_rate))

    return signals.withColumn("samples", convert("samples")).withColumn("sample_rate", F.lit(new_rate))


def between_seconds(frames: DataFrame, c: FeatureConfig, start: float, stop: float) -> DataFrame:
    """The frames (of any operator here) whose time lies in [start, stop)."""
    t = F.col("frame") * F.lit(c.hop_length / c.rate)
    return frames.filter((t >= start) & (t < stop))


def feature_vectors(signals: DataFrame, c: FeatureConfig) -> DataFrame:
    """recording_id, features: mean, then sample deviation of each band over time.

    The deviation of a single frame is null, as are features of an empty signal.
    """
    w = None if c.n_mels is None else dsp.mel_filters(c.n_fft, c.n_mels, c.rate, c.f_min, c.top, c.slaney_norm)
    width = 2 * (c.n_mels or c.n_fft // 2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, width), np.nan)
            for i in range(batch.num_rows):
                x = batch.column(1)[i].values
                if x is not None and len(x):
                    out[i] = dsp.pooled(dsp.features(x.to_numpy(zero_copy_only=False), c, w))
            flat = pa.array(out.ravel(), from_pandas=True)  # NaN is null
            ends = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["recording_id", "features"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType().add("recording_id", signals.schema["recording_id"].dataType).add("features", ArrayType(DoubleType()))
    return signals.select("recording_id", "samples").mapInArrow(run, schema)


def file_features(files: DataFrame, c: FeatureConfig, skip_secs: float = 0.0, max_secs: float | None = None) -> DataFrame:
    """:func:`feature_vectors` of WAV files, in the stage that decodes them."""
    w = None if c.n_mels is None else dsp.mel_filters(c.n_fft, c.n_mels, c.rate, c.f_min, c.top, c.slaney_norm)
    width = 2 * (c.n_mels or c.n_fft // 2 + 1)

    def fn(rate: int, x: np.ndarray) -> dict[str, object]:
        x = x if len(x) or not skip_secs else np.zeros(1)
        found = dsp.pooled(dsp.features(x, c, w)) if len(x) else np.full(width, np.nan)
        return {"features": [None if v != v else v for v in found.tolist()]}

    return audio.map_recordings(files, fn, "features array<double>", skip_secs, max_secs)
