"""Parameters of the spectral features."""

from __future__ import annotations

from dataclasses import dataclass, replace

__all__ = ["FeatureConfig", "replace"]


@dataclass(frozen=True)
class FeatureConfig:
    sample_rate: int = 64_000
    n_fft: int = 1024
    win_length: int = 1024
    hop_length: int = 512
    window: str = "hann"
    resample_rate: int | None = None
    n_mels: int | None = 128
    power: float = 2.0
    center: bool = True
    f_min: float = 0.0
    f_max: float | None = None
    reference: float = 1e-6
    slaney_norm: bool = False

    def __post_init__(self) -> None:
        if self.window not in ("hann", "boxcar", "hamming"):
            raise ValueError(f"unknown window {self.window!r}")
        if self.hop_length < 1 or self.n_fft < 2 or self.win_length > self.n_fft:
            raise ValueError("hop_length, n_fft and win_length do not fit")

    @property
    def rate(self) -> int:
        """The rate that spectra are taken at."""
        return self.resample_rate or self.sample_rate

    @property
    def top(self) -> float:
        return self.f_max if self.f_max is not None else self.rate / 2
