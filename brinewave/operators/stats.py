"""Descriptive statistics of signals and tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..sources import audio


def x() -> Column:
    return F.col("samples")


def rate() -> Column:
    return F.col("sample_rate")


STATS = ("duration_sec", "peak_abs", "mean_abs", "rms", "zcr_hz")


def folded(x: np.ndarray, ends: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """[5, signals]: the statistics of signals laid end to end."""
    starts = np.append(0, ends[:-1])
    n = ends - starts
    out = np.zeros((5, len(n)))
    some = np.flatnonzero(n)
    if len(some):
        at, size = starts[some], n[some]
        size_of = np.abs(x)
        out[1, some] = np.maximum.reduceat(size_of, at)
        out[2, some] = np.add.reduceat(size_of, at) / size
        out[3, some] = np.sqrt(np.add.reduceat(x * x, at) / size)
        crossed = np.zeros(len(x))
        crossed[1:] = (x[1:] < 0) != (x[:-1] < 0)
        crossed[at] = 0.0  # the first sample of a signal follows no other
        out[4, some] = np.add.reduceat(crossed, at) / np.maximum(size - 1, 1) * rate[some]
        out[0] = n / rate
    return out


def signal_stats(signals: DataFrame, skip_secs: float = 0.0) -> DataFrame:
    """duration_sec, peak_abs, mean_abs, rms, zcr_hz of packed signals.

    One pass over each array in numpy, in Arrow batches: no row per sample and no
    shuffle. Zero counts as positive in crossings. The head is left out; a signal
    without a sample after it has zeros throughout, the duration included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = np.asarray(batch.column(1)).astype(float)
            lists = batch.column(2)
            x = np.asarray(lists.flatten().cast(pa.float64()))
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, folded(x, np.cumsum(size), rate))], names=["recording_id", *STATS])

    head = F.greatest((F.lit(float(skip_secs)) * rate()).cast("int"), F.lit(0))
    rest = F.slice(x(), head + 1, F.greatest(F.size(x()) - head, F.lit(0))) if skip_secs else x()
    schema = StructType().add("recording_id", signals.schema["recording_id"].dataType)
    for name in STATS:
        schema = schema.add(name, DoubleType())
    return signals.select("recording_id", "sample_rate", rest.alias("samples")).mapInArrow(run, schema)


def file_stats(files: DataFrame, skip_secs: float = 0.0) -> DataFrame:
    """The same of WAV files, in the stage that decodes them."""

    def fn(rate: int, x: np.ndarray) -> dict[str, object]:
        return dict(zip(STATS, folded(x, np.array([len(x)]), np.array([float(rate)]))[:, 0].tolist(), strict=True))

    return audio.map_recordings(files, fn, ", ".join(f"{name} double" for name in STATS), skip_secs)


def long_stats(samples: DataFrame, order: list[str], hertz: float, center: bool = False) -> DataFrame:
    """The same from a row per sample (recording_id, amplitude, order columns);
    one exchange of the samples, by recording."""
    one = Window.partitionBy("recording_id")
    if center:
        samples = samples.withColumn("amplitude", F.col("amplitude") - F.avg("amplitude").over(one))
    a = F.col("amplitude")
    before = F.lag(a).over(one.orderBy(*order))
    rows = samples.withColumn("crossed", F.coalesce((a < 0) != (before < 0), F.lit(False)).cast("long"))
    n = F.count(F.lit(1))
    return rows.groupBy("recording_id").agg(
        (n / F.lit(float(hertz))).alias("duration_sec"),
        F.max(F.abs(a)).alias("peak_abs"),
        F.avg(F.abs(a)).alias("mean_abs"),
        F.sqrt(F.avg(a * a)).alias("rms"),
        F.coalesce(F.sum("crossed") / F.nullif(n - 1, F.lit(0)) * F.lit(float(hertz)), F.lit(0.0)).alias("zcr_hz"),
    )


def amplitude_fraction(threshold: float) -> Column:
    """Share of the samples at or above a level."""
    return F.size(F.filter(x(), lambda x: F.abs(x) >= threshold)) / F.nullif(F.size(x()), F.lit(0)).cast("double")


def peak() -> Column:
    return F.array_max(F.transform(x(), F.abs))


def high_amplitude(signals: DataFrame, level: float = 0.3, min_share: float = 5e-6) -> DataFrame:
    """Recordings whose peak and share of loud samples reach the bounds."""
    found = signals.select("recording_id", peak().alias("peak_ampl"), amplitude_fraction(level).alias("ampl_frac"))
    return found.filter((F.col("peak_ampl") >= level) & (F.col("ampl_frac") >= min_share))


#: Bins of a histogram, and values that may be left in a bin when it is sorted.
BINS, SORTED = 4096, 100_000


def order_statistics(tall: DataFrame, wanted: list[tuple[str, int, float, float]], bins: int = BINS, most: int = SORTED) -> dict[tuple[str, int], float]:
    """The rank-th smallest (from 0) x of a column, for (column, rank, lowest,
    highest) of ``wanted``; tall has column_name and x.

    Histograms narrow the range of each, a few columns of counts at a time, and
    only the values within the last bin are put in order: no task and no driver
    holds a column, and values that repeat count as one.
    """
    spark = tall.sparkSession
    open_ = {i: [c, rank, lo, hi] for i, (c, rank, lo, hi) in enumerate(wanted)}  # rank within lo..hi
    left = dict.fromkeys(open_, most + 1)

    def met() -> DataFrame:
        rows = spark.createDataFrame([(i, c, float(lo), float(hi)) for i, (c, _, lo, hi) in open_.items()], "i int, of string, lo double, hi double")
        return tall.join(F.broadcast(rows), F.col("column_name") == F.col("of")).filter("x >= lo and x <= hi")

    for _ in range(5):
        if all(n <= most for n in left.values()) or not open_:
            break
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).alias("bin")
        found = met().select("i", bin_, "x").groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for i, state in open_.items():
            for r in sorted((r for r in found if r["i"] == i), key=lambda r: r["bin"]):
                if state[1] < r["n"]:
                    state[2:], left[i] = [r["lo"], r["hi"]], r["n"]
                    break
                state[1] -= r["n"]
    counts = met().groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("x")))
    ranks = spark.createDataFrame([(i, int(rank)) for i, (_, rank, _, _) in open_.items()], "j int, rank long")
    hit = upto.join(F.broadcast(ranks), F.col("i") == F.col("j")).filter(F.col("upto") > F.col("rank")).groupBy("i").agg(F.min("x").alias("x"))
    return {wanted[r["i"]][:2]: r["x"] for r in hit.collect()}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, count, mean, std, min, p25, p50, p75, max; quartiles
    interpolate; nulls and NaN are left out."""
    tall = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for c in columns))).alias("r")).select("r.*")
    got = tall.groupBy("column_name").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).collect()
    share = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    at = {(r["column_name"], q): p * (r["count"] - 1) for r in got if r["count"] for q, p in share.items()}
    ends = {r["column_name"]: (r["min"], r["max"]) for r in got}
    wanted = sorted({(c, rank, *ends[c]) for (c, _), place in at.items() for rank in (int(place), -int(-place // 1))})
    values = order_statistics(tall.filter(F.col("x").isNotNull()), wanted) if wanted else {}
    rows = []
    for r in got:
        c, found = r["column_name"], {}
        for q in share:
            place = at.get((c, q))
            if place is not None:
                low = values[c, int(place)]
                found[q] = low if place == int(place) else low + (place - int(place)) * (values[c, int(place) + 1] - low)
        rows.append((c, r["count"], r["mean"], r["std"], r["min"], found.get("p25"), found.get("p50"), found.get("p75"), r["max"]))
    return df.sparkSession.createDataFrame(rows, "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def ranked(stats: DataFrame) -> DataFrame:
    """Loudest first, NaN last."""
    last = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).desc_nulls_last()
    return stats.orderBy(last("mean_abs"), last("peak_abs"), "recording_id")
