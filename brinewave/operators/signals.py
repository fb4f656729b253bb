"""Shaping of packed signals, inside the JVM and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def x() -> Column:
    return F.col("samples")


def rate() -> Column:
    return F.col("sample_rate")


def n_samples() -> Column:
    return F.size("samples")


def at_second(secs: float) -> Column:
    """Whole samples before a time, cut toward zero."""
    return (F.lit(float(secs)) * rate()).cast("int")


def crop_head(signals: DataFrame, secs: float) -> DataFrame:
    """Without the head; a signal that is no longer than it becomes one zero."""
    s = at_second(secs)
    return signals.withColumn("samples", F.when(n_samples() > s, F.slice(x(), s + 1, F.greatest(n_samples() - s, F.lit(0)))).otherwise(F.array(F.lit(0.0))))


def mute_head(signals: DataFrame, secs: float) -> DataFrame:
    s = at_second(secs)
    return signals.withColumn("samples", F.transform(x(), lambda x, i: F.when(i < s, 0.0).otherwise(x)))


def duration_cap(signals: DataFrame, secs: float | None) -> DataFrame:
    return signals if secs is None else signals.withColumn("samples", F.slice(x(), F.lit(1), at_second(secs)))


def time_window(signals: DataFrame, start: float, stop: float) -> DataFrame:
    return signals.withColumn("samples", F.slice(x(), at_second(start) + 1, F.greatest(at_second(stop) - at_second(start), F.lit(0))))


def pad_right(signals: DataFrame, length: int) -> DataFrame:
    return signals.withColumn("samples", F.concat(x(), F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - n_samples(), F.lit(0)))))


def decimate_stride(signals: DataFrame, max_pts: int, skip_secs: float = 0.0) -> DataFrame:
    """recording_id, i, t, amplitude: every stride-th sample after the head;
    the stride is of the whole length, so a few more than ``max_pts`` may come.
    A signal without a sample after the head is one zero."""
    s, stride = at_second(skip_secs), F.greatest(F.lit(1), (n_samples() / max_pts).cast("int"))
    rest = F.slice(x(), F.least(s, n_samples()) + 1, F.greatest(n_samples() - s, F.lit(0)))
    rest = F.when(n_samples() > s, rest).otherwise(F.array(F.lit(0.0)))
    cut = signals.select("recording_id", "sample_rate", rest.alias("samples"), stride.alias("stride"))
    picked = F.transform(F.sequence(F.lit(0), n_samples() - 1, F.col("stride")), lambda k: F.element_at(x(), k + 1))
    return cut.select("recording_id", "sample_rate", "stride", F.posexplode(picked).alias("i", "amplitude")).select(
        "recording_id", "i", (F.col("i") * F.col("stride") / F.col("sample_rate").cast("double")).alias("t"), "amplitude"
    )


def decimate_exact(signals: DataFrame, max_pts: int, compat_float32: bool = False) -> DataFrame:
    """Exactly ``max_pts`` samples: gathered from longer signals, padded with
    zeros from shorter ones. compat_float32 computes the indices in single
    precision, whose products round beyond 2 ** 24."""
    n = n_samples()
    k = F.sequence(F.lit(0), F.lit(max_pts - 1))
    if compat_float32:
        step = (n / F.lit(float(max_pts))).cast("float")
        index = F.transform(k, lambda i: F.floor(i.cast("float") * step).cast("int"))
    else:
        whole = lambda i: i.cast("long") * n
        index = F.transform(k, lambda i: ((whole(i) - F.pmod(whole(i), F.lit(max_pts))) / max_pts).cast("int"))
    gathered = F.transform(index, lambda i: F.element_at(x(), F.least(i, n - 1) + 1))
    padded = F.concat(x(), F.array_repeat(F.lit(0.0), F.greatest(F.lit(max_pts) - n, F.lit(0))))
    return signals.withColumn("samples", F.when(n > max_pts, gathered).otherwise(padded))


def to_long(signals: DataFrame) -> DataFrame:
    return signals.select("recording_id", "sample_rate", F.posexplode("samples").alias("frame_idx", "amplitude"))


def ordinal_range(df: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """Rows [start, stop) in the order of a column."""
    return df.orderBy(order).offset(start).limit(stop - start)
