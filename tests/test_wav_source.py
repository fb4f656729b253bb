from __future__ import annotations

import numpy as np
from brinewave.sources import audio, wav_source
from pyspark.sql import functions as F


def files(folder):
    rng = np.random.default_rng(3)
    (folder / "deep").mkdir()
    for i in range(5):
        (folder / ("deep" if i % 2 else "") / f"r{i}.wav").write_bytes(audio.wav_bytes(rng.normal(0, 0.2, 40 + 20 * i), 100))
    (folder / "broken.wav").write_bytes(b"RIFF")
    (folder / "notes.txt").write_text("no sound")


def rows(df):
    return sorted((r.recording_id, r.sample_rate, tuple(r.samples)) for r in df.collect())


def test_equals_the_binary_scan(spark, tmp_path):
    files(tmp_path)
    wav_source.register(spark)
    for options, how in (({}, {}), ({"skipSecs": 0.5, "maxSecs": 0.25}, {"skip_secs": 0.5, "max_secs": 0.25})):
        got = spark.read.format("wav").options(**options, bytesPerTask=200).load(str(tmp_path))
        assert rows(got) == rows(audio.read_recordings(audio.wav_files(spark, str(tmp_path)), **how)) and len(rows(got)) == 5
    assert rows(spark.read.format("wav").load(f"file://{tmp_path}")) == rows(spark.read.format("wav").load(str(tmp_path)))


def test_named_files_alone_are_read(spark, tmp_path):
    files(tmp_path)
    wav_source.register(spark)
    every = spark.read.format("wav").option("bytesPerTask", 1).load(str(tmp_path))
    assert every.rdd.getNumPartitions() == 6
    some = every.filter(F.col("recording_id").isin("r1.wav", "r2.wav", "none.wav") & (F.size("samples") > 70))
    assert some.rdd.getNumPartitions() == 2 and [r[0] for r in rows(some)] == ["r2.wav"]
    one = every.filter(F.col("recording_id") == "r3.wav")
    assert one.rdd.getNumPartitions() == 1 and [r[0] for r in rows(one)] == ["r3.wav"]
    assert rows(every.filter((F.col("recording_id") == "r3.wav") & (F.col("recording_id") == "r1.wav"))) == []


def test_a_folder_without_recordings(spark, tmp_path):
    wav_source.register(spark)
    assert spark.read.format("wav").load(str(tmp_path)).count() == 0
