"""Tables behind plots: bounded rows to draw, without the drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import dsp
from . import signals as sig
from . import spectral


def waveform(signals: DataFrame) -> DataFrame:
    long = sig.to_long(signals)
    return long.select("recording_id", (F.col("frame_idx") / F.col("sample_rate").cast("double")).alias("t"), "amplitude")


def waveform_fast(signals: DataFrame, skip_secs: float = 0.0, max_pts: int = 30_000) -> DataFrame:
    return sig.decimate_stride(signals, max_pts, skip_secs)


def first_waveforms(signals: DataFrame, rows: int, cols: int, max_pts: int = 30_000) -> DataFrame:
    """Of the first rows * cols recordings by id."""
    return waveform_fast(signals.orderBy("recording_id").limit(rows * cols), 0.0, max_pts)


def specgram(signals: DataFrame, c: FeatureConfig) -> DataFrame:
    found = spectral.magnitude_spectrum(signals, c.n_fft, c.hop_length)
    return found.withColumn("t", (F.col("frame") * c.hop_length + c.n_fft / 2) / F.lit(float(c.sample_rate))).withColumn("freq", F.col("bin") * F.lit(c.sample_rate / c.n_fft))


def first_specgrams(signals: DataFrame, rows: int, cols: int, c: FeatureConfig) -> DataFrame:
    return specgram(signals.orderBy("recording_id").limit(rows * cols), c)


def feature_map(signals: DataFrame, c: FeatureConfig, unit: str = "bins") -> DataFrame:
    """recording_id, frame, t, bin, db, and the bands' centres for ``freqs``."""
    if unit not in ("bins", "freqs"):
        raise ValueError("unit is bins or freqs")
    out = spectral.decibels(signals, c).withColumn("t", F.col("frame") * F.lit(c.hop_length / c.rate)).withColumnRenamed("value", "db")
    if unit == "freqs":
        centers = dsp.mel_centers(c.n_mels, c.rate, c.f_min, c.top) if c.n_mels else [b * c.rate / c.n_fft for b in range(c.n_fft // 2 + 1)]
        out = out.withColumn("center_freq", F.array(*(F.lit(float(f)) for f in centers))[F.col("bin")])
    return out


def ticks(n: int, count: int = 6) -> list[int]:
    """Evenly spaced positions from the first to the last of n."""
    return [int(i * (n - 1) / (count - 1)) for i in range(count)]


def kilohertz(freq: float) -> str:
    return f"{freq / 1000:.1f}"


def kilohertz_of(freq: Column) -> Column:
    """The same label as a column."""
    return F.format_string("%.1f", freq / 1000)


def scatter(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """pc1, pc2, cluster and kind, of points and centroids together."""
    side = lambda df, kind: df.select("pc1", "pc2", "cluster", F.lit(kind).alias("kind"))
    return side(points, "point").unionByName(side(centroids, "centroid"))
