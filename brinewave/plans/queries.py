"""Named queries over the driver's tables, and the same in DuckDB's SQL.

``embeddings`` stands in for short mono signals (64 samples at 64 Hz) and for
feature vectors, ``events`` for signals of any length, one for each user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..operators import cluster, plotdata, signals as sig, spectral, stats
from ..sources import audio, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Small spectra that SQL can still express.
SMALL = FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=8)
LINEAR = FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=None)
RATE, CROP = 64, 5 / 64
LEVEL, SHARE = 0.3, 5e-6


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, and zero without a sign."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signals(spark: SparkSession, d: str) -> DataFrame:
    return audio.signals_of_vectors(read(spark, d, "embeddings"), rate=RATE)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return register


SIG = """sig AS (
  SELECT vec_id AS recording_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings
)"""


def samples_out(df: DataFrame) -> DataFrame:
    return df.select("recording_id", F.posexplode("samples").alias("i", "x")).select("recording_id", F.col("i").cast("long").alias("i"), r("x").alias("x"))


# ------------------------------------------------------------------ statistics

_STATS = """
SELECT recording_id, round(count(*) / {rate}::DOUBLE, 6) + 0.0 AS duration_sec, round(max(abs(x)), 6) + 0.0 AS peak_abs, round(avg(abs(x)), 6) + 0.0 AS mean_abs,
       round(sqrt(avg(x * x)), 6) + 0.0 AS rms, round(coalesce(sum(crossed) / nullif(count(*) - 1, 0)::DOUBLE * {rate}, 0), 6) + 0.0 AS zcr_hz
FROM (SELECT *, CAST(coalesce((x < 0) <> (lag(x) OVER (PARTITION BY recording_id ORDER BY {order}) < 0), false) AS INT) AS crossed FROM {source}) GROUP BY recording_id
"""


def stats_out(df: DataFrame) -> DataFrame:
    return df.select("recording_id", *(r(c).alias(c) for c in ("duration_sec", "peak_abs", "mean_abs", "rms", "zcr_hz")))


@query(f"WITH {SIG}, cut AS (SELECT recording_id, i, x FROM sig WHERE i >= 5)" + _STATS.format(rate=64, order="i", source="cut"))
def signal_stats(spark, d):
    """Head cropped, then duration, peak, mean, RMS and zero crossings; loudest first."""
    return stats_out(stats.ranked(stats.signal_stats(signals(spark, d), CROP)))


@query(
    "WITH ev AS (SELECT user_id AS recording_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events)"
    + _STATS.format(rate=1, order="ts, event_id", source="(SELECT recording_id, ts, event_id, CASE WHEN abs(x) < 1e-9 THEN 0 ELSE x END AS x FROM ev)")
)
def event_signal_stats(spark, d):
    """Statistics of ragged signals, a row per sample, centred."""
    return stats_out(stats.long_stats(audio.samples_of_events(read(spark, d, "events")), ["ts", "event_id"], 1.0, center=True))


@query(
    f"""WITH {SIG}, s AS (SELECT recording_id, max(abs(x)) AS peak, avg(CAST(abs(x) >= {LEVEL} AS INT)) AS share FROM
    (SELECT recording_id, CASE WHEN i < 5 THEN 0.0 ELSE x END AS x FROM sig) GROUP BY 1)
    SELECT recording_id, round(peak, 6) + 0.0 AS peak_ampl, round(share, 9) + 0.0 AS ampl_frac FROM s WHERE peak >= {LEVEL} AND share >= {SHARE}"""
)
def high_amplitude(spark, d):
    """Recordings with loud samples, the muted head left in the denominator."""
    found = stats.high_amplitude(sig.mute_head(signals(spark, d), CROP), LEVEL, SHARE)
    return found.select("recording_id", r("peak_ampl").alias("peak_ampl"), r("ampl_frac", 9).alias("ampl_frac"))


@query(f"WITH {SIG} SELECT recording_id, round(avg(CAST(abs(x) >= 0.2 AS INT)), 9) + 0.0 AS fraction FROM sig GROUP BY 1")
def amplitude_fraction(spark, d):
    return signals(spark, d).select("recording_id", r(stats.amplitude_fraction(0.2), 9).alias("fraction"))


@query(f"WITH {SIG}, s AS (SELECT recording_id, round(avg(abs(x)), 9) AS m, round(max(abs(x)), 9) AS p FROM sig GROUP BY 1) SELECT recording_id, m + 0.0 AS mean_abs, p + 0.0 AS peak_abs FROM s ORDER BY m DESC, p DESC, recording_id LIMIT 4")
def top_recordings(spark, d):
    """The four loudest."""
    found = stats.signal_stats(signals(spark, d)).withColumn("mean_abs", r("mean_abs", 9)).withColumn("peak_abs", r("peak_abs", 9))
    return stats.ranked(found).limit(4).select("recording_id", "mean_abs", "peak_abs")


def _describe(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count({column}) AS count, round(avg({column}), 4) + 0.0 AS mean, round(stddev_samp({column}), 4) + 0.0 AS std, round(min({column}), 4) + 0.0 AS min,
    round(quantile_cont({column}, 0.25), 4) + 0.0 AS p25, round(quantile_cont({column}, 0.5), 4) + 0.0 AS p50, round(quantile_cont({column}, 0.75), 4) + 0.0 AS p75, round(max({column}), 4) + 0.0 AS max FROM lineitem"""


@query(" UNION ALL ".join(_describe(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_stats(spark, d):
    found = stats.describe(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("column_name", "count", *(r(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


# ------------------------------------------------------------------- shaping

_SAMPLES = "SELECT recording_id, i, round(x, 6) + 0.0 AS x FROM ({})"


@query(f"WITH {SIG} " + _SAMPLES.format("SELECT recording_id, i - 5 AS i, x FROM sig WHERE i >= 5"))
def crop_head(spark, d):
    return samples_out(sig.crop_head(signals(spark, d), CROP))


@query("SELECT vec_id AS recording_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS x FROM embeddings")
def crop_head_too_short(spark, d):
    return samples_out(sig.crop_head(signals(spark, d), 2.0))


@query(f"WITH {SIG} " + _SAMPLES.format("SELECT recording_id, i, CASE WHEN i < 5 THEN 0.0 ELSE x END AS x FROM sig"))
def mute_head(spark, d):
    return samples_out(sig.mute_head(signals(spark, d), CROP))


@query(f"WITH {SIG} " + _SAMPLES.format("SELECT recording_id, i, x FROM sig WHERE i < 16"))
def duration_cap(spark, d):
    return samples_out(sig.duration_cap(signals(spark, d), 0.25))


@query(f"WITH {SIG} " + _SAMPLES.format("SELECT recording_id, i - 16 AS i, x FROM sig WHERE i >= 16 AND i < 48"))
def time_window(spark, d):
    return samples_out(sig.time_window(signals(spark, d), 0.25, 0.75))


@query(f"WITH {SIG} SELECT recording_id, (i - 5) // 6 AS i, round((i - 5) / 64.0::DOUBLE, 6) + 0.0 AS t, round(x, 6) + 0.0 AS x FROM sig WHERE i >= 5 AND (i - 5) % 6 = 0")
def decimate_stride(spark, d):
    """At most about ten points after the head; the stride is of the whole length."""
    found = sig.decimate_stride(signals(spark, d), 10, CROP)
    return found.select("recording_id", F.col("i").cast("long").alias("i"), r("t").alias("t"), r("amplitude").alias("x"))


@query(f"WITH {SIG} SELECT recording_id, k AS i, round(x, 6) + 0.0 AS x FROM range(10) t(k) JOIN sig ON sig.i = k * n // 10")
def decimate_exact(spark, d):
    return samples_out(sig.decimate_exact(signals(spark, d), 10))


@query(f"WITH {SIG} SELECT recording_id, k AS i, round(x, 6) + 0.0 AS x FROM range(10) t(k) JOIN sig ON sig.i = CAST(floor(CAST(k AS FLOAT) * CAST(n / 10.0 AS FLOAT)) AS BIGINT)")
def decimate_exact_float32(spark, d):
    return samples_out(sig.decimate_exact(signals(spark, d), 10, compat_float32=True))


@query(f"WITH {SIG} SELECT e.vec_id AS recording_id, k AS i, round(coalesce(x, 0), 6) + 0.0 AS x FROM embeddings e CROSS JOIN range(80) t(k) LEFT JOIN sig ON sig.recording_id = e.vec_id AND sig.i = k")
def pad_right(spark, d):
    return samples_out(sig.pad_right(signals(spark, d), 80))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 10 OFFSET 0")
def ordinal_subset(spark, d):
    return sig.ordinal_range(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 0, 10)


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 15 OFFSET 5")
def positional_rows(spark, d):
    return sig.ordinal_range(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 5, 20)


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 7")
def record_at(spark, d):
    """The eighth recording in order of its id."""
    return sig.ordinal_range(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 7, 8)


@query(f"WITH {SIG} SELECT recording_id, round(max(abs(x)), 6) + 0.0 AS peak_ampl FROM sig GROUP BY 1 HAVING max(abs(x)) >= 0.35 ORDER BY recording_id LIMIT 5")
def first_matching(spark, d):
    """The first five recordings, by id, with a loud sample."""
    found = signals(spark, d).select("recording_id", stats.peak().alias("peak")).filter("peak >= 0.35")
    return found.orderBy("recording_id").limit(5).select("recording_id", r("peak").alias("peak_ampl"))


@query("SELECT count(*) AS n_recordings FROM embeddings")
def dataset_size(spark, d):
    return read(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n_recordings"))


# ------------------------------------------------------- tables, joins and unions


@query("SELECT page_id, regexp_extract(url, '([^\\\\/]+)$', 1) AS base_name FROM pages")
def base_names(spark, d):
    return read(spark, d, "pages").select("page_id", audio.base_name(F.col("url")).alias("base_name"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) || '.' || strftime(ts, '%y%m%d%H%M%S') || '.wav' AS filename, CAST(user_id AS VARCHAR) AS device, date_trunc('second', ts) AS recorded_at FROM events")
def recording_times(spark, d):
    """Device and time of file names made of events, parsed back."""
    name = F.concat(F.col("user_id").cast("string"), F.lit("."), F.date_format("ts", "yyMMddHHmmss"), F.lit(".wav"))
    named = read(spark, d, "events").select("event_id", name.alias("filename"))
    return named.select("event_id", "filename", audio.device_of(F.col("filename")).alias("device"), audio.recorded_at(F.col("filename")).cast("timestamp_ntz").alias("recorded_at"))


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exclude_listed(spark, d):
    """Rows whose id is on a list (of broken files) are left out."""
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def keep_candidates(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(
    """SELECT * FROM (VALUES ('decimate', 10000.0::DOUBLE, 10, 4.0::DOUBLE, 12.0::DOUBLE, 18.0::DOUBLE), ('stats', 'inf'::DOUBLE, 100, 2.0::DOUBLE, 12.0::DOUBLE, 59.5::DOUBLE), ('fit', 200000.0::DOUBLE, 7, NULL, 12.0::DOUBLE, 102.0::DOUBLE))
    t(function, max_points, n_obs, batch_size, n_cores, runtime_sec)"""
)
def append_runtime(spark, d):
    """A log with written-out numbers, and an entry of another column order."""
    log = spark.createDataFrame([("decimate", "10,000", 10, 4.0, 12.0, 18.0), ("stats", "inf", 100, 2.0, 12.0, 59.5)], tables.RUNTIMES)
    entry = spark.createDataFrame([("fit", "200000", 7, 12.0, 102.0)], "function string, max_points string, n_obs int, n_cores double, runtime_sec double")
    return tables.clean_points(tables.append_rows(log, entry))


# ------------------------------------------------------------------- spectra


@query("SELECT k AS n, round(0.5 - 0.5 * cos(2 * pi() * k / 16), 9) + 0.0 AS weight FROM range(16) t(k)")
def hann_window(spark, d):
    n = F.col("n").cast("double")
    return spark.range(16).withColumnRenamed("id", "n").select("n", r(F.lit(0.5) - F.lit(0.5) * F.cos(2 * F.pi() * n / 16), 9).alias("weight"))


def _mel(rate: int, n_fft: int, n_mels: int, norm: str = "1") -> str:
    top = f"2595 * log10(1 + ({rate} / 2.0::DOUBLE) / 700)"
    return f"""edges AS (SELECT k, 700 * (pow(10, {top} * k / {n_mels + 1}.0::DOUBLE / 2595) - 1) AS f FROM range({n_mels + 2}) t(k)),
    fb AS (SELECT CAST(a.k AS INT) AS mel, CAST(b AS INT) AS bin,
      greatest(0, least((b * {rate}.0::DOUBLE / {n_fft} - a.f) / (m.f - a.f), (z.f - b * {rate}.0::DOUBLE / {n_fft}) / (z.f - m.f))) * {norm} AS w
      FROM edges a JOIN edges m ON m.k = a.k + 1 JOIN edges z ON z.k = a.k + 2 CROSS JOIN range({n_fft // 2 + 1}) t(b))"""


@query(f"WITH {_mel(64_000, 1024, 128)} SELECT mel, bin, round(w, 6) + 0.0 AS weight FROM fb")
def mel_filterbank(spark, d):
    return spectral.mel_filterbank(spark, FeatureConfig()).select("mel", "bin", r("weight").alias("weight"))


@query(f"WITH {_mel(16_000, 512, 40, '2 / (z.f - a.f)')} SELECT mel, bin, round(w, 8) + 0.0 AS weight FROM fb")
def mel_filterbank_slaney(spark, d):
    c = FeatureConfig(sample_rate=16_000, n_fft=512, win_length=512, n_mels=40, slaney_norm=True)
    return spectral.mel_filterbank(spark, c).select("mel", "bin", r("weight", 8).alias("weight"))


def _stft(center: bool = True) -> str:
    source = "CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END" if center else "p"
    shift, count = (8, "n // 8") if center else (0, "(n - 16) // 8")
    return f"""{SIG}, grid AS (SELECT DISTINCT recording_id, n FROM sig),
    placed AS (SELECT recording_id, n, frame, k, frame * 8 + k - {shift} AS p FROM grid, range(20) f(frame), range(16) t(k) WHERE frame <= {count}),
    framed AS (SELECT q.recording_id, frame, k, x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS v FROM (SELECT *, {source} AS at FROM placed) q JOIN sig ON sig.recording_id = q.recording_id AND sig.i = q.at),
    spec AS (SELECT recording_id, frame, b AS bin, pow(sum(v * cos(2 * pi() * b * k / 16)), 2) + pow(sum(v * sin(2 * pi() * b * k / 16)), 2) AS p FROM framed, range(9) t(b) GROUP BY ALL)"""


def spectrum_out(df: DataFrame, name: str, digits: int = 4) -> DataFrame:
    return df.select("recording_id", "frame", "bin", r("value", digits).alias(name))


@query(f"WITH {_stft()} SELECT recording_id, CAST(frame AS INT) AS frame, CAST(bin AS INT) AS bin, round(p, 6) + 0.0 AS power FROM spec")
def power_spectrogram(spark, d):
    return spectrum_out(spectral.power_spectrogram(signals(spark, d), SMALL), "power", 6)


@query(f"WITH {_stft()} SELECT recording_id, CAST(frame AS INT) AS frame, CAST(bin AS INT) AS bin, round(10 * log10(greatest(p / 1e-12, 1e-10)), 4) + 0.0 AS db FROM spec")
def linear_db(spark, d):
    """Decibels of the bins themselves, down to the floor."""
    return spectrum_out(spectral.decibels(signals(spark, d), LINEAR), "db")


_LOGMEL = f"""WITH {_stft()}, {_mel(64, 16, 8)}, mels AS (SELECT recording_id, CAST(frame AS INT) AS frame, mel AS bin, sum(p / {{ref}} * w) AS p FROM spec JOIN fb ON spec.bin = fb.bin GROUP BY ALL),
    db AS (SELECT recording_id, frame, bin, 10 * log10(greatest(p, 1e-10)) AS db FROM mels)"""


@query(_LOGMEL.format(ref="1e-12") + " SELECT recording_id, frame, bin, round(db, 4) + 0.0 AS db FROM db")
def log_mel(spark, d):
    return spectrum_out(spectral.decibels(signals(spark, d), SMALL), "db")


@query(_LOGMEL.format(ref="1e-12") + " SELECT recording_id, frame, round(db, 4) + 0.0 AS db FROM db WHERE bin = 0")
def single_band(spark, d):
    """The first band over time."""
    found = spectral.decibels(signals(spark, d), SMALL).filter("bin = 0")
    return found.select("recording_id", "frame", r("value", 4).alias("db"))


@query(_LOGMEL.format(ref="1.0::DOUBLE") + " SELECT recording_id, frame, bin, round(greatest(db, max(db) OVER (PARTITION BY recording_id) - 20), 4) + 0.0 AS db FROM db")
def mel_top_db(spark, d):
    """Mel power over no reference, clamped to 20 dB below its peak."""
    return spectrum_out(spectral.top_decibels(signals(spark, d), FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=8, reference=1.0), 20.0), "db")


@query(f"WITH {_stft(False)} SELECT recording_id, CAST(frame AS INT) AS frame, CAST(bin AS INT) AS bin, round(20 * log10(greatest(sqrt(p) / 8, 1e-10)), 4) + 0.0 AS db FROM spec")
def specgram_magnitude(spark, d):
    return spectrum_out(spectral.magnitude_spectrum(signals(spark, d), 16, 8), "db")


@query(_LOGMEL.format(ref="1e-12") + " SELECT recording_id, frame, bin, round(db, 4) + 0.0 AS db FROM db WHERE frame * 8 / 64.0::DOUBLE >= 0.25 AND frame * 8 / 64.0::DOUBLE < 0.75")
def frames_between(spark, d):
    """Log-mel frames by time."""
    return spectrum_out(spectral.between_seconds(spectral.decibels(signals(spark, d), SMALL), SMALL, 0.25, 0.75), "db")


@query(
    f"WITH {_stft()}, {_mel(64, 16, 8, '2 / (z.f - a.f)')} SELECT recording_id, CAST(frame AS INT) AS frame, mel AS bin, round(10 * log10(greatest(sum(p * w), 1e-10)), 4) + 0.0 AS db FROM spec JOIN fb ON spec.bin = fb.bin GROUP BY ALL"
)
def mel_slaney(spark, d):
    """Log-mel by filters of unit area, over no reference."""
    c = FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=8, reference=1.0, slaney_norm=True)
    return spectrum_out(spectral.decibels(signals(spark, d), c), "db")


_PCM = "greatest(least(round(x * 32768), 32767), -32768) / 32768"


@query(f"WITH {SIG} SELECT CAST(recording_id AS VARCHAR) || '.wav' AS recording_id, i, {_PCM} + 0.0 AS x FROM sig")
def wav_decode(spark, d):
    """Signals written as 16-bit files and read again."""
    found = audio.read_recordings(audio.as_files(audio.check_signals(signals(spark, d))))
    return found.select("recording_id", F.posexplode("samples").alias("i", "x")).select("recording_id", F.col("i").cast("long").alias("i"), (F.col("x") + F.lit(0.0)).alias("x"))


@query(f"WITH {SIG} SELECT CAST(recording_id AS VARCHAR) || '.wav' AS recording_id, i - 16 AS i, {_PCM} + 0.0 AS x FROM sig WHERE i >= 16 AND i < 48")
def wav_decode_part(spark, d):
    """The same without the head, and no longer than half a second."""
    found = audio.read_recordings(audio.as_files(signals(spark, d)), skip_secs=0.25, max_secs=0.5)
    return found.select("recording_id", F.posexplode("samples").alias("i", "x")).select("recording_id", F.col("i").cast("long").alias("i"), (F.col("x") + F.lit(0.0)).alias("x"))


@query("SELECT CAST(vec_id AS VARCHAR) || '.wav' AS path, 64 AS sample_rate, CAST(len(embedding) AS BIGINT) AS num_frames, 1 AS channels, 16 AS bits FROM embeddings")
def wav_probe(spark, d):
    return audio.probe(audio.as_files(signals(spark, d))).filter("error is null").drop("error")


@query(
    _LOGMEL.format(ref="1e-12")
    + """, f AS (SELECT recording_id, bin, avg(db) AS mu, stddev_samp(db) AS sd FROM db GROUP BY ALL)
    SELECT recording_id, bin AS k, round(mu, 4) + 0.0 AS value FROM f UNION ALL SELECT recording_id, bin + 8 AS k, round(sd, 4) + 0.0 AS value FROM f"""
)
def feature_vector(spark, d):
    """Means, then sample deviations of the log-mel bands over time."""
    found = spectral.feature_vectors(signals(spark, d), SMALL)
    return found.select("recording_id", F.posexplode("features").alias("k", "value")).select("recording_id", "k", r("value", 4).alias("value"))


@query()
def feature_vector_full(spark, d):
    """Default-size features of signals brought to exactly 1,000 samples."""
    return spectral.feature_vectors(sig.decimate_exact(signals(spark, d), 1000), FeatureConfig())


#: Half the rate: a Hann-windowed sinc of six zero crossings a side, cut off at 0.99.
_TAP = "greatest(least((i - 2 * j) / 2.0::DOUBLE * 0.99, 6), -6)"


@query(
    f"""WITH {SIG}, met AS (SELECT recording_id, j, x, {_TAP} AS a FROM sig JOIN range(40) t(j) ON 2 * j < n AND i - 2 * j BETWEEN -13 AND 14)
    SELECT recording_id, j AS i, round(sum(x * CASE WHEN a = 0 THEN 1 ELSE sin(pi() * a) / (pi() * a) END * pow(cos(pi() * a / 12), 2) * 0.99 / 2), 6) + 0.0 AS x FROM met GROUP BY ALL"""
)
def resample_half(spark, d):
    return samples_out(spectral.resampled(signals(spark, d), 32, 64))


@query(f"WITH {_mel(64_000, 1024, 128)} SELECT mel, CASE WHEN max(w) > 0 THEN CAST(first(bin ORDER BY w DESC, bin) * 62.5 AS DOUBLE) END AS center_freq FROM fb GROUP BY mel")
def filter_centers(spark, d):
    c = FeatureConfig()
    return spectral.filter_centers(spectral.mel_filterbank(spark, c), c).select("mel", r("center_freq", 4).alias("center_freq"))


# ------------------------------------------------------------------- vectors

VEC = "vec AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def vector_out(df: DataFrame, vector: str = "features") -> DataFrame:
    return df.select("vec_id", F.posexplode(vector).alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), r("x").alias("x"))


@query(f"WITH {VEC} SELECT vec_id, k, round(x / sum(abs(x)) OVER (PARTITION BY vec_id), 6) + 0.0 AS x FROM vec")
def l1_normalize(spark, d):
    return vector_out(cluster.normalize(vectors(spark, d), 1))


@query(f"WITH {VEC} SELECT vec_id, k, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS x FROM vec")
def l2_normalize(spark, d):
    return vector_out(cluster.normalize(vectors(spark, d), 2))


@query(f"WITH {VEC} SELECT vec_id, k, round((x - avg(x) OVER (PARTITION BY k)) / stddev_pop(x) OVER (PARTITION BY k), 6) + 0.0 AS x FROM vec")
def standardize(spark, d):
    return vector_out(cluster.standardize(vectors(spark, d)))


def first_vectors(spark: SparkSession, d: str, n: int = 8) -> list[list[float]]:
    return [list(row["features"]) for row in vectors(spark, d).orderBy("vec_id").limit(n).collect()]


def _assign(name: str, centers: str) -> str:
    return f"""{name} AS (SELECT vec_id, cluster, d2 FROM (SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d2 FROM vec v JOIN {centers} c USING (k) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) = 1)"""


_C0 = f"{VEC}, c0 AS (SELECT CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS INT) AS cluster, k, x FROM vec WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8))"


def _update(name: str, assigned: str) -> str:
    return f"{name} AS (SELECT cluster, k, avg(x) AS x FROM vec JOIN {assigned} USING (vec_id) GROUP BY ALL)"


@query(f"WITH {_C0}, {_assign('a0', 'c0')} SELECT vec_id, cluster, round(d2, 6) + 0.0 AS dist2 FROM a0")
def nearest_centroid(spark, d):
    return cluster.nearest(vectors(spark, d), first_vectors(spark, d)).select("vec_id", "cluster", r("dist2").alias("dist2"))


@query(f"WITH {_C0}, {_assign('a0', 'c0')} SELECT round(sum(d2), 4) + 0.0 AS inertia FROM a0")
def inertia(spark, d):
    return cluster.inertia(cluster.nearest(vectors(spark, d), first_vectors(spark, d))).select(r("inertia", 4).alias("inertia"))


@query(
    f"WITH {_C0}, {_assign('a0', 'c0')}, {_update('c1', 'a0')}, {_assign('a1', 'c1')}, {_update('c2', 'a1')}, {_assign('a2', 'c2')} SELECT cluster, count(*) AS n, round(sum(d2), 4) + 0.0 AS inertia FROM a2 GROUP BY cluster"
)
def kmeans_steps(spark, d):
    """Two Lloyd updates from the first eight vectors."""
    assigned, _ = cluster.lloyd(vectors(spark, d), first_vectors(spark, d), 2)
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.sum("dist2"), 4).alias("inertia"))


@query()
def kmeans(spark, d):
    """The best of ten starts on L1-normalised vectors."""
    assigned, _, _ = cluster.kmeans(cluster.normalize(vectors(spark, d), 1), k=8, restarts=10)
    return assigned.select("vec_id", "cluster", "dist2")


@query("SELECT count(*) AS n, 8 AS clusters, true AS settled, true AS closer FROM embeddings")
def kmeans_fit(spark, d):
    """What holds of any good fit: all clusters are used, another update gains
    less than a hundredth, and the centroids are closer than the overall mean."""
    rows = cluster.normalize(vectors(spark, d), 1)
    assigned, centers, _ = cluster.kmeans(rows, k=8, restarts=10)
    updated, _ = cluster.lloyd(rows, centers, 1)
    middle, _ = cluster.lloyd(rows, centers[:1], 1)
    total = lambda df, name: df.agg(F.sum("dist2").alias(name))
    sums = assigned.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").cast("int").alias("clusters"), F.sum("dist2").alias("now"))
    both = sums.join(total(updated, "then")).join(total(middle, "one"))
    return both.select("n", "clusters", (F.col("then") >= 0.99 * F.col("now")).alias("settled"), (F.col("now") < F.col("one")).alias("closer"))


@query("SELECT label AS cluster, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def cluster_members(spark, d):
    found = cluster.members(vectors(spark, d), "label", "vec_id")
    return found.select("cluster", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def cluster_count(spark, d):
    return vectors(spark, d).agg(F.countDistinct("label").alias("n_clusters"))


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) <= 10")
def cluster_sample(spark, d):
    """Ten of each cluster by an arithmetic hash that any SQL has."""
    h = F.pmod(F.col("vec_id") * F.lit(2654435761), F.lit(4294967296))
    return cluster.sample_members(vectors(spark, d), "label", "vec_id", 10, draw=h).select("label", "vec_id")


@query(
    "SELECT label, vec_id, regexp_extract(url, '([^\\\\/]+)$', 1) AS base_name FROM (SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) <= 10) JOIN pages ON page_id = vec_id"
)
def sample_names(spark, d):
    """Names of the sampled members."""
    sampled = cluster_sample(spark, d)
    return sampled.join(read(spark, d, "pages"), F.col("vec_id") == F.col("page_id")).select("label", "vec_id", audio.base_name(F.col("url")).alias("base_name"))


@query()
def cluster_sample_seeded(spark, d):
    return cluster.sample_members(vectors(spark, d), "label", "vec_id", 10).select("label", "vec_id")


@query("SELECT first(vec_id ORDER BY embedding[1], vec_id) AS lowest, first(vec_id ORDER BY embedding[1] DESC, vec_id) AS highest FROM embeddings")
def argmin_argmax(spark, d):
    return cluster.extremes(vectors(spark, d).select("vec_id", F.col("features")[0].alias("x")), "x", "vec_id")


_SILHOUETTE = """, per AS (SELECT p.i, p.li, p.lj, sum(p.d) AS total, count(*) AS n FROM (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, {d} AS d FROM unit a CROSS JOIN unit b WHERE a.vec_id <> b.vec_id) p GROUP BY ALL),
    ab AS (SELECT i, max(CASE WHEN li = lj THEN total / n END) AS a, min(CASE WHEN li <> lj THEN total / n END) AS b FROM per GROUP BY i)
    SELECT i AS vec_id, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM ab"""


@query("WITH unit AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)" + _SILHOUETTE.format(d="list_distance(a.v, b.v)"))
def silhouette_euclidean(spark, d):
    found = cluster.silhouette_euclidean(vectors(spark, d), "vec_id", "label")
    return found.select("vec_id", r("silhouette").alias("silhouette"))


@query("WITH unit AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)" + _SILHOUETTE.format(d="list_distance(a.v, b.v)").replace("SELECT i AS vec_id, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM ab", "SELECT (SELECT count(DISTINCT label) FROM embeddings) AS n_clusters, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0.0 AS silhouette FROM ab"))
def cluster_metrics(spark, d):
    """One row: the number of clusters and their mean silhouette."""
    rows = vectors(spark, d)
    mean = cluster.silhouette_euclidean(rows, "vec_id", "label").agg(r(F.avg("silhouette")).alias("silhouette"))
    return rows.agg(F.countDistinct("label").alias("n_clusters")).join(mean)


@query("WITH unit AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)" + _SILHOUETTE.format(d="1 - list_cosine_similarity(a.v, b.v)"))
def silhouette_cosine(spark, d):
    found = cluster.silhouette_cosine(vectors(spark, d), "vec_id", "label")
    return found.select("vec_id", r("silhouette").alias("silhouette"))


@query()
def recording_clusters(spark, d):
    """From signals to a picture of their clusters: exact decimation, log-mel
    features, L1 norm, the best of ten k-means starts, the silhouette of those
    labels, and two principal components."""
    features = spectral.feature_vectors(sig.decimate_exact(signals(spark, d), 48), SMALL)
    assigned, _, _ = cluster.kmeans(cluster.normalize(features, 1), k=4, restarts=10)
    out, _, _ = cluster.pca(assigned, 2)
    shape = cluster.silhouette_cosine(assigned, "recording_id", "cluster")
    return out.join(shape, "recording_id").select("recording_id", "cluster", "dist2", "silhouette", F.col("pcs")[0].alias("pc1"), F.col("pcs")[1].alias("pc2"))


@query(
    f"WITH {VEC}, unit AS (SELECT vec_id, k, x / sum(abs(x)) OVER (PARTITION BY vec_id) AS x FROM vec), mid AS (SELECT vec_id, k, x - avg(x) OVER (PARTITION BY k) AS x FROM unit) SELECT round(sum(x * x), 9) + 0.0 AS spread FROM mid"
)
def pca_spread(spark, d):
    """All principal components keep the squared distance from the mean."""
    out, _, _ = cluster.pca(cluster.normalize(vectors(spark, d), 1), 64)
    return out.agg(r(F.sum(F.aggregate("pcs", F.lit(0.0), lambda a, x: a + x * x)), 9).alias("spread"))


@query("SELECT count(*) AS n, true AS centred, true AS ordered, true AS uncorrelated FROM embeddings")
def pca_fit(spark, d):
    """What holds of any principal components: they are centred, of falling
    variance, and without correlation."""
    out, _, _ = cluster.pca(cluster.normalize(vectors(spark, d), 1), 2)
    x, y = F.col("pcs")[0], F.col("pcs")[1]
    found = out.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.corr(x, y).alias("r"))
    small = F.lit(1e-9)
    return found.select("n", ((F.abs("mx") < small) & (F.abs("my") < small)).alias("centred"), (F.col("vx") >= F.col("vy")).alias("ordered"), (F.abs("r") < 1e-6).alias("uncorrelated"))


@query()
def pca2(spark, d):
    out, _, _ = cluster.pca(cluster.normalize(vectors(spark, d), 1), 2)
    return out.select("vec_id", F.col("pcs")[0].alias("pc1"), F.col("pcs")[1].alias("pc2"))


@query()
def pca50(spark, d):
    out, _, _ = cluster.pca(cluster.standardize(cluster.normalize(vectors(spark, d), 2)), 50)
    return out.select("vec_id", "pcs")


@query()
def agglomerative(spark, d):
    return cluster.agglomerative(cluster.normalize(vectors(spark, d), 2), 8, "vec_id")


@query()
def tsne(spark, d):
    """On 50 principal components of standardised unit vectors."""
    out, _, _ = cluster.pca(cluster.standardize(cluster.normalize(vectors(spark, d), 2)), 50)
    return cluster.tsne(out.select("vec_id", F.col("pcs").alias("features")), "vec_id", iterations=2000)


# ------------------------------------------------------------------ plot data


@query(f"WITH {SIG} SELECT recording_id, round(i / 64.0::DOUBLE, 6) + 0.0 AS t, round(x, 6) + 0.0 AS amplitude FROM sig")
def waveform(spark, d):
    return plotdata.waveform(signals(spark, d)).select("recording_id", r("t").alias("t"), r("amplitude").alias("amplitude"))


@query(f"WITH {SIG} SELECT recording_id, round(i / 64.0::DOUBLE, 6) + 0.0 AS t, round(x, 6) + 0.0 AS amplitude FROM sig WHERE i % 3 = 0 AND recording_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 6)")
def waveform_grid(spark, d):
    return plotdata.first_waveforms(signals(spark, d), 2, 3, 20).select("recording_id", r("t").alias("t"), r("amplitude").alias("amplitude"))


@query(
    f"""WITH {_stft(False)} SELECT recording_id, CAST(frame AS INT) AS frame, CAST(bin AS INT) AS bin, round(20 * log10(greatest(sqrt(p) / 8, 1e-10)), 4) + 0.0 AS db, (frame * 8 + 8) / 64.0::DOUBLE AS t, bin * 4.0::DOUBLE AS freq
    FROM spec WHERE recording_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 6)"""
)
def specgram_grid(spark, d):
    found = plotdata.first_specgrams(signals(spark, d), 2, 3, SMALL)
    return found.select("recording_id", "frame", "bin", r("value", 4).alias("db"), "t", "freq")


@query(_LOGMEL.format(ref="1e-12") + " SELECT recording_id, frame, frame * 8 / 64.0::DOUBLE AS t, bin, round(db, 4) + 0.0 AS db, round(f, 6) + 0.0 AS center_freq FROM db JOIN edges ON k = bin + 1")
def feature_map(spark, d):
    found = plotdata.feature_map(signals(spark, d), SMALL, "freqs")
    return found.select("recording_id", "frame", "t", "bin", r("db", 4).alias("db"), r("center_freq").alias("center_freq"))


@query()
def cluster_scatter(spark, d):
    """Vectors and centroids on two principal components."""
    base = cluster.normalize(vectors(spark, d), 1)
    assigned, centers, _ = cluster.kmeans(base, k=8, restarts=10)
    out, extra, _ = cluster.pca(assigned, 2, extra=centers)
    points = out.select(F.col("pcs")[0].alias("pc1"), F.col("pcs")[1].alias("pc2"), "cluster")
    marks = spark.createDataFrame([(float(x), float(y), k) for k, (x, y) in enumerate(extra)], "pc1 double, pc2 double, cluster int")
    return plotdata.scatter(points, marks)
