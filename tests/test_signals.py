from __future__ import annotations

import math
import struct
import wave

import numpy as np
import pytest
from brinewave.config import FeatureConfig
from brinewave.functions import dsp
from brinewave.operators import cluster, plotdata, signals as sig, spectral, stats
from brinewave.sources import audio, tables
from pyspark.sql import functions as F


def frame(spark, rows, rate=10):
    return spark.createDataFrame([(k, rate, [float(v) for v in x]) for k, x in rows.items()], "recording_id string, sample_rate int, samples array<double>")


def collect(df, column="samples"):
    return {r.recording_id: r[column] for r in df.collect()}


def test_shaping(spark):
    f = frame(spark, {"a": range(12), "b": [5], "e": []})
    assert collect(sig.crop_head(f, 0.3)) == {"a": [float(i) for i in range(3, 12)], "b": [0.0], "e": [0.0]}
    assert collect(sig.mute_head(f, 0.3))["a"] == [0.0] * 3 + [float(i) for i in range(3, 12)]
    assert collect(sig.duration_cap(f, 0.2)) == {"a": [0.0, 1.0], "b": [5.0], "e": []}
    assert collect(sig.time_window(f, 0.2, 0.5))["a"] == [2.0, 3.0, 4.0]
    assert collect(sig.pad_right(f, 3)) == {"a": [float(i) for i in range(12)], "b": [5.0, 0.0, 0.0], "e": [0.0] * 3}
    assert collect(sig.decimate_exact(f, 5)) == {"a": [0.0, 2.0, 4.0, 7.0, 9.0], "b": [5.0] + [0.0] * 4, "e": [0.0] * 5}
    assert collect(sig.decimate_exact(f, 12))["a"] == [float(i) for i in range(12)]
    # the stride is of the whole length, so more points than asked for may come
    picked = [r.amplitude for r in sig.decimate_stride(f, 5, 0.1).filter("recording_id = 'a'").orderBy("i").collect()]
    assert picked == [1.0, 3.0, 5.0, 7.0, 9.0, 11.0]


def test_float32_indices_differ_only_beyond_2_to_24():
    n, most = 17_278_700, 1000
    assert [int(np.floor(np.float32(k) * np.float32(n / most))) for k in range(3)] == [k * n // most for k in range(3)]


def test_stats_in_closed_form(spark):
    t = np.arange(1000) / 1000
    sine = 0.5 * np.sin(2 * np.pi * 50 * t + 0.1)
    f = frame(spark, {"sine": sine, "square": [0.25, -0.25] * 500, "dc": [0.3] * 10, "silence": [0.0] * 10, "signs": [0.0, -0.0] * 5, "mix": [1, 0, -1, 0, 1], "one": [0.7], "none": []}, 1000)
    got = {r.recording_id: r for r in stats.signal_stats(f).collect()}
    assert abs(got["sine"].rms - 0.5 / math.sqrt(2)) < 1e-6 and abs(got["sine"].mean_abs - 1 / math.pi) < 1e-3 and abs(got["sine"].zcr_hz - 100) < 1.2
    assert got["square"].peak_abs == got["square"].mean_abs == got["square"].rms == 0.25 and got["square"].zcr_hz == 1000
    assert got["dc"].zcr_hz == 0 and abs(got["dc"].rms - 0.3) < 1e-12
    assert tuple(got["silence"])[2:] == (0.0, 0.0, 0.0, 0.0) and got["signs"].zcr_hz == 0
    assert got["mix"].zcr_hz == 2 / 4 * 1000 and got["one"].zcr_hz == 0 and tuple(got["none"])[1:] == (0.0,) * 5
    long = sig.to_long(f.filter("recording_id <> 'none'"))
    for r in stats.long_stats(long, ["frame_idx"], 1000).collect():
        assert np.allclose(tuple(r)[1:], tuple(got[r.recording_id])[1:])


def test_high_amplitude_keeps_muted_zeros_in_the_share(spark):
    f = frame(spark, {"loud": [0.9] * 5 + [0.0] * 4 + [0.3], "head": [0.9] * 5 + [0.0] * 5})
    rows = stats.high_amplitude(sig.mute_head(f, 0.5), 0.3, 0.1).collect()
    assert [(r.recording_id, r.ampl_frac) for r in rows] == [("loud", 0.1)]


def test_nan_ranks_last(spark):
    f = spark.createDataFrame([("a", float("nan"), 1.0), ("b", 0.1, 1.0), ("c", 0.5, None)], "recording_id string, mean_abs double, peak_abs double")
    assert [r.recording_id for r in stats.ranked(f).collect()] == ["c", "b", "a"]


def naive_spectrum(x, c):
    half = c.n_fft // 2
    padded = [x[abs(i) if i < len(x) else 2 * (len(x) - 1) - i] for i in range(-half, len(x) + half)]
    out = []
    for t in range(1 + len(x) // c.hop_length):
        v = [padded[t * c.hop_length + n] * (0.5 - 0.5 * math.cos(2 * math.pi * n / c.n_fft)) for n in range(c.n_fft)]
        out.append([abs(sum(v[n] * complex(math.cos(2 * math.pi * b * n / c.n_fft), -math.sin(2 * math.pi * b * n / c.n_fft)) for n in range(c.n_fft))) ** 2 for b in range(half + 1)])
    return np.array(out).T


def test_spectra():
    c = FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=8)
    x = np.random.default_rng(1).normal(size=50)
    assert np.allclose(dsp.spectrogram(x, c), naive_spectrum(x, c))
    t = np.arange(64_000) / 64_000
    full = FeatureConfig()
    power = dsp.spectrogram(np.sin(2 * np.pi * 5000 * t), full)
    assert abs(int(power.mean(1).argmax()) - 80) <= 1
    filters = dsp.mel_filters(1024, 128, 64_000)
    assert [m for m in range(128) if not filters[m].any()] == [0, 3, 8]
    features = dsp.pooled(dsp.features(np.random.default_rng(2).normal(size=5000), full))
    assert features.shape == (256,) and (features[[0, 3, 8]] == -100).all() and (features[[128, 131, 136]] == 0).all()
    assert (dsp.features(np.zeros(2000), full) == -100).all()
    assert dsp.features(np.zeros(1), full).shape == (128, 1)  # too short to be reflected
    assert np.isnan(dsp.pooled(dsp.features(np.ones(600), FeatureConfig(hop_length=1024)))[128:]).all()
    assert dsp.clamp_top(np.array([0.0, -200.0])).tolist() == [0.0, -80.0]
    slaney = dsp.mel_filters(1024, 128, 64_000, slaney_norm=True)
    assert abs(slaney[100].sum() * 62.5 - 1) < 0.01


def test_resample_keeps_a_tone():
    t = np.arange(4000) / 8000
    y = dsp.resample(np.sin(2 * np.pi * 300 * t), 8000, 4000)
    assert len(y) == 2000 and np.allclose(y[100:-100], np.sin(2 * np.pi * 300 * np.arange(2000) / 4000)[100:-100], atol=2e-3)
    assert len(dsp.resample(np.zeros(100), 3, 2)) == 67
    assert dsp.resample(np.arange(5.0), 7, 7).tolist() == list(range(5))


def test_features_frame(spark):
    f = frame(spark, {"a": np.random.default_rng(3).normal(size=60), "e": []}, 64)
    c = FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=8)
    got = collect(spectral.feature_vectors(f, c), "features")
    assert np.allclose(got["a"], dsp.pooled(dsp.features(np.array(collect(f)["a"]), c))) and got["e"] == [None] * 16
    own = spectral.map_signals(f, lambda x: np.abs(x)[None])  # a transform of one's own
    assert own.count() == 60
    assert spectral.resampled(f, 32, 64).filter("recording_id = 'a'").first().sample_rate == 32
    assert plotdata.feature_map(f, c, "freqs").filter("center_freq is null").count() == 0
    with pytest.raises(ValueError):
        plotdata.feature_map(f, c, "other")
    assert plotdata.ticks(128) == [0, 25, 50, 76, 101, 127] and plotdata.kilohertz(1250) == "1.2"


def wav(path, samples, rate=64_000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))


def test_wav(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    wav(tmp_path / "6229.220802160000.wav", [-32768, 0, 16384, 32767])
    wav(tmp_path / "deep/er/stereo.wav", [1, 100, 2, 200, 3, 300], 8000, 2)
    (tmp_path / "deep/broken.wav").write_bytes(b"RIFFxxxxnothing")
    (tmp_path / "other.txt").write_text("no")
    files = audio.wav_files(spark, str(tmp_path))
    head = {r.path.rsplit("/", 1)[-1]: r for r in audio.probe(files).collect()}
    assert (head["stereo.wav"].sample_rate, head["stereo.wav"].num_frames, head["stereo.wav"].channels, head["stereo.wav"].bits) == (8000, 3, 2, 16)
    assert head["broken.wav"].error and head["broken.wav"].sample_rate is None
    got = collect(audio.read_recordings(files))
    assert got["6229.220802160000.wav"] == [-1.0, 0.0, 0.5, 32767 / 32768] and got["stereo.wav"] == [1 / 32768, 2 / 32768, 3 / 32768]
    assert collect(audio.read_recordings(files, skip_secs=1.0))["stereo.wav"] == [0.0]
    assert collect(audio.read_recordings(files, skip_secs=1 / 8000, max_secs=1 / 8000, channel=1))["stereo.wav"] == [200 / 32768]
    when = files.select(audio.recorded_at(audio.base_name(F.col("path"))).cast("string").alias("t"), audio.device_of(audio.base_name(F.col("path"))).alias("d")).collect()
    assert ("2022-08-02 16:00:00", "6229") in {(r.t, r.d) for r in when} and len(when) == 3


def test_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("C:\\data\\x.zip\nbad data : x\\1.wav\nbad header : x/2.wav\n")
    rows = tables.corruption_manifest(spark, str(tmp_path / "m.txt")).collect()
    assert {(r.reason, r.filename) for r in rows} == {("bad data", "1.wav"), ("bad header", "2.wav")}
    (tmp_path / "r.csv").write_text('function,max_points,n_obs,batch_size,n_cores,runtime_sec\na,"10,000",10,4.0,12.0,18.0\nb,inf,1,,12.0,2.0\n')
    log = tables.clean_points(tables.read_csv(spark, str(tmp_path / "r.csv"), tables.RUNTIMES))
    assert [(r.max_points, r.batch_size) for r in log.orderBy("function").collect()] == [(10000.0, 4.0), (float("inf"), None)]
    tables.write_csv(log, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), tables.RUNTIMES).count() == 2


def test_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20, 5)) + 8 * k for k in range(3)] + [[[100.0] * 5], [[0.0] * 5]])
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 20) + int(i >= 40) + int(i == 60)) for i, v in enumerate(x)], "id long, features array<double>, label int")
    unit = {r.id: r.features for r in cluster.normalize(df, 1).collect()}
    assert unit[61] == [0.0] * 5 and abs(sum(map(abs, unit[0])) - 1) < 1e-12
    flat = df.withColumn("features", F.transform("features", lambda v, i: F.when(i == 0, 7.0).otherwise(v)))
    std = np.array([r.features for r in cluster.standardize(flat).orderBy("id").collect()])
    assert (std[:, 0] == 0).all() and np.allclose(std[:, 1:].std(0), 1)
    for metric, fn in (("e", cluster.silhouette_euclidean), ("c", cluster.silhouette_cosine)):
        lab = np.array([0] * 20 + [1] * 20 + [2] * 20 + [3, 2])
        if metric == "e":
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        else:
            u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
            d = 1 - u @ u.T
        expect = []
        for i in range(len(x)):
            own = (lab == lab[i]) & (np.arange(len(x)) != i)
            if not own.any():
                expect.append(0.0)
                continue
            a, b = d[i][own].mean(), min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
            expect.append((b - a) / max(a, b))
        relabelled = df.withColumn("label", F.when(F.col("id") == 61, 2).otherwise(F.col("label")))
        got = {r.id: r.silhouette for r in fn(relabelled, "id", "label").collect()}
        assert np.allclose([got[i] for i in range(60)], expect[:60]) and got[60] == 0.0
    with pytest.raises(ValueError):
        cluster.silhouette_euclidean(df, "id", "id")
    out, extra, axes = cluster.pca(df, 2, extra=[x.mean(0).tolist()])
    mid = x - x.mean(0)
    vt = np.linalg.svd(mid, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(axes), np.abs(vt), atol=1e-6) and np.allclose(extra[0], 0, atol=1e-9)
    assert np.allclose(np.array([r.pcs for r in out.orderBy("id").collect()]), mid @ axes.T)
    assigned, centers, cost = cluster.kmeans(df, k=4, restarts=3)
    assert abs(cluster.inertia(assigned).first().inertia - cost) < 1e-6 * cost and centers == sorted(centers)
    s = cluster.sample_members(df, "label", "id", 3)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, cluster.sample_members(df.repartition(3), "label", "id", 3).collect()))
    assert s.filter("label = 0").count() == 3 and s.filter("label = 3").count() == 1


def test_upgma_and_embedding(spark):
    rng = np.random.default_rng(5)
    d = rng.random((14, 14))
    d = d + d.T
    groups = [{i} for i in range(14)]
    while len(groups) > 4:
        pairs = [(np.mean([d[a, b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] |= groups.pop(j)
    of = cluster.upgma(d, 4)
    assert {frozenset(np.flatnonzero(of == c).tolist()) for c in set(of)} == set(map(frozenset, groups))
    x = np.concatenate([rng.normal(size=(25, 6)), rng.normal(size=(25, 6)) + 20])
    y = cluster.embed(x, perplexity=10, iterations=400)
    assert y.shape == (50, 2) and np.isfinite(y).all() and (y == cluster.embed(x, perplexity=10, iterations=400)).all()
    gap = np.linalg.norm(y[:25].mean(0) - y[25:].mean(0))
    assert gap > 2 * max(y[:25].std(), y[25:].std()) or gap > y[:25].std() + y[25:].std()
    with pytest.raises(ValueError):
        cluster.embed(x[:10], perplexity=30)


def test_average_linkage_of_many_points(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 5))
    x[100:120], x[149] = x[3], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    few = sorted(map(tuple, cluster.agglomerative(df, 6, "id").collect()))
    monkeypatch.setattr(cluster, "MAX_POINTS", 100)
    assert sorted(map(tuple, cluster.agglomerative(df, 6, "id").collect())) == few and len(few) == 150
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(length > 0, length, 1)
    for k in (1, 3, 40, 140):
        assert (cluster.upgma(1 - u @ u.T, k) == cluster.upgma_cosine(u, k)).all()


def test_embedding_of_many_points(spark, monkeypatch):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(300, 2)) * 9
    away = y[:, None] - y[None]
    q = 1 / (1 + (away**2).sum(2))
    np.fill_diagonal(q, 0)
    found, total = cluster.repulsion(y, {})
    exact = ((q * q)[:, :, None] * away).sum(1)
    assert np.abs(found - exact).max() < 0.05 * np.abs(exact).max() and abs(total / q.sum() - 1) < 0.01
    x = np.concatenate([rng.normal(size=(50, 6)) + 20 * i for i in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    monkeypatch.setattr(cluster, "MAX_POINTS", 100)
    rows = cluster.tsne(df, "id", perplexity=10, iterations=400).orderBy("id").collect()
    z = np.array([(r.x, r.y) for r in rows])
    assert z.shape == (150, 2) and np.isfinite(z).all()
    near = np.argsort(((z[:, None] - z[None]) ** 2).sum(2), axis=1)[:, 1:6]
    assert (near // 50 == (np.arange(150) // 50)[:, None]).mean() > 0.99


def test_signals_no_longer_than_the_head(spark):
    f = frame(spark, {"a": range(12), "b": [5, 6, 7], "e": []})
    rows = {(r.recording_id, r.i, r.t, r.amplitude) for r in sig.decimate_stride(f, 5, 1.0).collect()}
    assert rows == {("a", 0, 0.0, 10.0), ("b", 0, 0.0, 0.0), ("e", 0, 0.0, 0.0)}
    got = {r.recording_id: tuple(r)[1:] for r in stats.signal_stats(f, 1.0).collect()}
    assert got["b"] == got["e"] == (0.0,) * 5 and got["a"][:3] == (0.2, 11.0, 10.5)
    nulls = spark.createDataFrame([("n", 10, None), ("x", 10, [1.0, -1.0])], "recording_id string, sample_rate int, samples array<double>")
    assert {r.recording_id: r.peak_abs for r in stats.signal_stats(nulls).collect()} == {"n": 0.0, "x": 1.0}


def test_describe_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    columns = {"skewed": rng.lognormal(0, 3, 1000), "ties": rng.integers(0, 4, 1000).astype(float), "one": np.full(1000, 7.0), "far": np.append(rng.normal(size=999), 1e300)}
    rows = [tuple(float(v[i]) for v in columns.values()) for i in range(1000)] + [(None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, ]) ).withColumn("empty", F.lit(None).cast("double"))
    for bins, most in ((4096, 100_000), (4, 3)):  # the second narrows several times
        found = stats.order_statistics
        monkeypatch.setattr(stats, "order_statistics", lambda tall, wanted, b=bins, m=most: found(tall, wanted, b, m))
        got = {r.column_name: r for r in stats.describe(df, [*columns, "empty"]).collect()}
        monkeypatch.setattr(stats, "order_statistics", found)
        for c, v in columns.items():
            assert got[c]["count"] == 1000 and np.allclose([got[c].p25, got[c].p50, got[c].p75], np.quantile(v, [0.25, 0.5, 0.75])), (c, bins)
            assert got[c]["min"] == v.min() and got[c]["max"] == v.max()
        assert got["empty"]["count"] == 0 and got["empty"].p50 is None


def test_tables_are_replaced_while_they_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/stats.csv"
    tables.write_csv(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    tables.write_csv(tables.append_rows(tables.read_csv(spark, path, "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")), path)
    assert sorted(map(tuple, tables.read_csv(spark, path, "k string, v int").collect())) == [("a", 1), ("b", 2)]
    folder = f"file://{tmp_path}/features"
    for n in (1, 2):
        tables.write_features(spark.createDataFrame([(f"r{n}", [1.0 * n])], "recording_id string, features array<double>"), folder)
    assert [tuple(r) for r in spark.read.parquet(folder).collect()] == [("r2", [2.0])]


def test_one_file_and_the_schema_of_signals(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"dev{n}.wav").write_bytes(audio.wav_bytes(np.arange(4 * n) / 32768, 8000))
    one = audio.read_recordings(audio.wav_files(spark, str(tmp_path), "dev2.wav")).collect()
    assert [(r.recording_id, len(r.samples)) for r in one] == [("dev2.wav", 8)]
    f = frame(spark, {"a": [1, 2]})
    assert audio.check_signals(f) is f
    with pytest.raises(ValueError, match="samples"):
        audio.check_signals(f.withColumn("samples", F.lit(1)))
    assert f.select(plotdata.kilohertz_of(F.lit(1234.0)).alias("k")).first().k == plotdata.kilohertz(1234.0) == "1.2"


def test_files_in_one_stage_equal_signals(spark, tmp_path):
    rng = np.random.default_rng(3)
    for n in (0, 3, 400, 1000):
        (tmp_path / f"d{n}.wav").write_bytes(audio.wav_bytes(rng.normal(0, 0.2, n), 100))
    (tmp_path / "bad.wav").write_bytes(b"RIFF....WAVE")
    files = audio.wav_files(spark, str(tmp_path))
    c = FeatureConfig(sample_rate=100, n_fft=16, win_length=16, hop_length=8, n_mels=4)
    whole = audio.read_recordings(files)
    assert sorted(map(tuple, stats.file_stats(files, 1.0).collect())) == sorted(map(tuple, stats.signal_stats(whole, 1.0).collect()))
    got = {r.recording_id: r.features for r in spectral.file_features(files, c, 1.0).collect()}
    expect = {r.recording_id: r.features for r in spectral.feature_vectors(audio.read_recordings(files, 1.0), c).collect()}
    assert got == expect and len(got) == 4
