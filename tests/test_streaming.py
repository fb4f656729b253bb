from __future__ import annotations

import struct
import wave

from brinewave.config import FeatureConfig
from brinewave.operators.spectral import feature_vectors
from brinewave.sources.audio import read_recordings, wav_files
from brinewave.streaming.recordings import stream_features


def test_files_become_features_once(spark, tmp_path):
    c = FeatureConfig(sample_rate=64, n_fft=16, win_length=16, hop_length=8, n_mels=4)
    root = tmp_path / "in"
    root.mkdir()

    def put(name, n):
        with wave.open(str(root / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(64)
            w.writeframes(struct.pack(f"<{n}h", *(i * 37 % 999 for i in range(n))))

    put("a.wav", 50)
    for name in ("b.wav", "c.wav"):
        stream_features(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), c).awaitTermination(120)
        put(name, 70)
    stream_features(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), c).awaitTermination(120)
    rows = lambda df: sorted((r.recording_id, r.features) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(feature_vectors(read_recordings(wav_files(spark, str(root))), c))
