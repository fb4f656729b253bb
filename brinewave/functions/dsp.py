"""Signal processing on numpy arrays; what the Arrow stages call per recording."""

from __future__ import annotations

import math

import numpy as np

from ..config import FeatureConfig

FLOOR = 1e-10


def window(kind: str, length: int) -> np.ndarray:
    """Periodic windows."""
    turn = 2 * np.pi * np.arange(length) / length
    return {"hann": 0.5 - 0.5 * np.cos(turn), "hamming": 0.54 - 0.46 * np.cos(turn), "boxcar": np.ones(length)}[kind]


def hz_to_mel(f):
    return 2595.0 * np.log10(1.0 + np.asarray(f, float) / 700.0)


def mel_to_hz(m):
    return 700.0 * (10.0 ** (np.asarray(m, float) / 2595.0) - 1.0)


def mel_filters(n_fft: int, n_mels: int, rate: float, f_min: float = 0.0, f_max: float | None = None, slaney_norm: bool = False) -> np.ndarray:
    """[n_mels, n_fft // 2 + 1] triangles, equally spaced on the mel scale."""
    edges = mel_to_hz(np.linspace(hz_to_mel(f_min), hz_to_mel(rate / 2 if f_max is None else f_max), n_mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    out = np.maximum(0.0, np.minimum(up, down))
    return out * (2.0 / (edges[2:] - edges[:-2]))[:, None] if slaney_norm else out


def mel_centers(n_mels: int, rate: float, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    return mel_to_hz(np.linspace(hz_to_mel(f_min), hz_to_mel(rate / 2 if f_max is None else f_max), n_mels + 2))[1:-1]


def decibel(power: np.ndarray) -> np.ndarray:
    return 10.0 * np.log10(np.maximum(power, FLOOR))


def clamp_top(db: np.ndarray, top_db: float = 80.0) -> np.ndarray:
    return np.maximum(db, db.max() - top_db) if db.size else db


def frames(x: np.ndarray, n_fft: int, hop: int, center: bool) -> np.ndarray:
    """[frames, n_fft]; centred frames see the signal reflected at its ends.

    A signal too short to be reflected (at most n_fft // 2 samples) is padded
    with zeros instead.
    """
    if center:
        half = n_fft // 2
        x = np.pad(x, half, mode="reflect" if len(x) > half else "constant")
    if len(x) < n_fft:
        return np.empty((0, n_fft))
    return np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]


def spectrogram(x: np.ndarray, c: FeatureConfig) -> np.ndarray:
    """[bins, frames] of |rfft| ** power."""
    w = np.zeros(c.n_fft)
    start = (c.n_fft - c.win_length) // 2
    w[start : start + c.win_length] = window(c.window, c.win_length)
    found = frames(np.asarray(x, float), c.n_fft, c.hop_length, c.center)
    size = np.abs(np.fft.rfft(found * w, axis=1)).T
    return size * size if c.power == 2.0 else size**c.power


def features(x: np.ndarray, c: FeatureConfig, filters: np.ndarray | None = None) -> np.ndarray:
    """Decibels [mels (or bins), frames] over the reference level."""
    x = np.asarray(x, float)
    if c.resample_rate and c.resample_rate != c.sample_rate:
        x = resample(x, c.sample_rate, c.resample_rate)
    power = spectrogram(x, c) / (c.reference**2)
    if c.n_mels is not None:
        power = (mel_filters(c.n_fft, c.n_mels, c.rate, c.f_min, c.top, c.slaney_norm) if filters is None else filters) @ power
    return decibel(power)


def pooled(db: np.ndarray) -> np.ndarray:
    """Mean and sample deviation over time, one after the other; the deviation
    of a single frame is NaN."""
    if not db.shape[1]:
        return np.full(2 * db.shape[0], np.nan)
    std = db.std(axis=1, ddof=1) if db.shape[1] > 1 else np.full(db.shape[0], np.nan)
    return np.concatenate((db.mean(axis=1), std))


def magnitude_db(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """[bins, frames] of an unpadded magnitude spectrum over the window's sum, in dB."""
    w = window("hann", n_fft)
    size = np.abs(np.fft.rfft(frames(np.asarray(x, float), n_fft, hop, False) * w, axis=1)).T / w.sum()
    return 20.0 * np.log10(np.maximum(size, FLOOR))


def resample(x: np.ndarray, rate: int, new_rate: int, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Band-limited sinc interpolation with a Hann window."""
    common = math.gcd(rate, new_rate)
    old, new = rate // common, new_rate // common
    if old == new:
        return np.asarray(x, float)
    base = min(old, new) * rolloff
    reach = math.ceil(width * old / base)
    taps = np.arange(-reach, reach + old) / old
    at = np.clip((taps[None] - np.arange(new)[:, None] / new) * base, -width, width)
    kernel = np.sinc(at) * np.cos(np.pi * at / width / 2) ** 2 * base / old
    padded = np.pad(np.asarray(x, float), (reach, reach + old))
    view = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[1])[::old]
    return (view @ kernel.T).reshape(-1)[: math.ceil(new * len(x) / old)]
