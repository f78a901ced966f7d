"""Parameters of operators, checked when a job is built, and the small tables made from them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Coefficients of the cosine-sum windows.
COSINES = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "flat_top": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class Window:
    """kind: a cosine-sum window, bartlett, rectangular, kaiser (beta), gaussian (std) or tukey (taper)."""

    kind: str = "hann"
    param: float | None = None

    def __post_init__(self):
        with_param = self.kind in ("kaiser", "gaussian", "tukey")
        check(with_param or self.kind in COSINES or self.kind in ("bartlett", "rectangular"), f"unknown window {self.kind}")
        check(with_param == (self.param is not None), f"window {self.kind} {'needs' if with_param else 'takes no'} parameter")

    def values(self, n: int, periodic: bool = True) -> np.ndarray:
        check(n >= 1, "a window has at least one value")
        if n == 1:
            return np.ones(1)
        m = n + 1 if periodic else n
        i, mid = np.arange(m), (m - 1) / 2
        if self.kind in COSINES:
            angle = (2 * i - (m - 1)) * np.pi / (m - 1)
            out = sum(a * np.cos(k * angle) for k, a in enumerate(COSINES[self.kind]))
        elif self.kind == "rectangular":
            out = np.ones(m)
        elif self.kind == "bartlett":
            out = 1 - np.abs(i - mid) / mid
        elif self.kind == "gaussian":
            out = np.exp(-((i - mid) ** 2) / (2 * self.param**2))
        elif self.kind == "kaiser":
            out = np.i0(self.param * np.sqrt(np.maximum(0, 1 - ((i - mid) / mid) ** 2))) / np.i0(self.param)
        else:
            width = int(np.floor(self.param * (m - 1) / 2))
            edge = np.minimum(i, m - 1 - i)
            out = np.where(edge < width, 0.5 * (1 + np.cos(np.pi * (2 * edge / (self.param * (m - 1)) - 1))) if self.param > 0 else 1.0, 1.0)
        return np.asarray(out)[:n]


@dataclass(frozen=True)
class StftConfig:
    fft: int = 2048
    hop: int = 512
    window: Window = field(default_factory=Window)
    win_length: int | None = None
    alignment: str = "centered"
    pad: str = "reflect"
    scale: str = "none"

    def __post_init__(self):
        check(self.fft >= 1 and self.hop >= 1, "fft and hop are positive")
        check(self.alignment in ("centered", "left", "right"), f"unknown alignment {self.alignment}")
        check(self.pad in ("reflect", "zero", "edge"), f"unknown padding {self.pad}")
        check(self.scale in ("none", "magnitude", "psd"), f"unknown scale {self.scale}")
        check(self.win_length is None or 1 <= self.win_length <= self.fft, "win_length is between 1 and fft")

    @property
    def left(self) -> int:
        return {"centered": self.fft // 2, "left": 0, "right": self.fft - 1}[self.alignment]

    @property
    def right(self) -> int:
        return self.fft // 2 if self.alignment == "centered" else 0

    @property
    def bins(self) -> int:
        return self.fft // 2 + 1

    def weights(self) -> np.ndarray:
        """The window in its place within the frame, scaled."""
        n = self.win_length or self.fft
        w, out = self.window.values(n), np.zeros(self.fft)
        w = w / (w.sum() if self.scale == "magnitude" else np.sqrt((w**2).sum()) if self.scale == "psd" else 1.0)
        start = (self.fft - n) // 2
        out[start : start + n] = w
        return out

    def frequencies(self, sample_rate: float) -> np.ndarray:
        return np.arange(self.bins) * sample_rate / self.fft


def hz_to_mel(f, scale: str = "slaney"):
    f = np.asarray(f, float)
    if scale == "htk":
        return 2595 * np.log10(1 + f / 700)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-300) / 1000) / (np.log(6.4) / 27))


def mel_to_hz(m, scale: str = "slaney"):
    m = np.asarray(m, float)
    if scale == "htk":
        return 700 * (10 ** (m / 2595) - 1)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * (np.log(6.4) / 27)))


@dataclass(frozen=True)
class MelConfig:
    sample_rate: float = 22050
    n_mels: int = 128
    f_min: float = 0.0
    f_max: float | None = None
    scale: str = "slaney"
    norm: bool = True

    def weights(self, fft: int) -> np.ndarray:
        """[n_mels, bins]: triangles between neighbours of evenly spaced mels, each of unit area if norm."""
        top = self.sample_rate / 2 if self.f_max is None else self.f_max
        check(0 <= self.f_min < top <= self.sample_rate / 2, "0 <= f_min < f_max <= half the sample rate")
        points = mel_to_hz(np.linspace(hz_to_mel(self.f_min, self.scale), hz_to_mel(top, self.scale), self.n_mels + 2), self.scale)
        check((np.diff(points) > 0).all(), "mel bands collapse")
        f = np.arange(fft // 2 + 1) * self.sample_rate / fft
        lower, centre, upper = points[:-2, None], points[1:-1, None], points[2:, None]
        out = np.maximum(0, np.minimum((f - lower) / (centre - lower), (upper - f) / (upper - centre)))
        check((out.max(axis=1) > 0).all(), "a mel band has no bin")
        return out * (2 / (upper - lower)) if self.norm else out


@dataclass(frozen=True)
class ChromaConfig:
    sample_rate: float = 22050
    n_chroma: int = 12
    tuning: float = 0.0
    centre_octave: float = 5.0
    octave_width: float | None = 2.0

    def weights(self, fft: int) -> np.ndarray:
        """[n_chroma, bins]: a Gaussian bump of each pitch class at each bin, from C up."""
        n = self.n_chroma
        position = np.zeros(fft)
        j = np.arange(1, fft)
        position[1:] = n * np.log2(j * self.sample_rate / fft / (440 * 2 ** (self.tuning / n) / 16))
        position[0] = position[1] - 1.5 * n
        width = np.concatenate([np.maximum(np.diff(position), 1), [1]])
        half = np.rint(n / 2)
        d = np.mod(position[None, :] - np.arange(n)[:, None] + half + 10 * n, n) - half
        out = np.exp(-0.5 * (2 * d / width) ** 2)
        out /= np.sqrt((out**2).sum(axis=0))
        if self.octave_width:
            out *= np.exp(-0.5 * ((position / n - self.centre_octave) / self.octave_width) ** 2)
        return np.roll(out, -3 * (n // 12), axis=0)[:, : fft // 2 + 1]


@dataclass(frozen=True)
class Octave:
    """Bins first to first + count, at the rate after `level` halvings: kernel is [count, fft / 2 + 1]."""

    first: int
    count: int
    level: int
    fft: int
    hop: int
    kernel: np.ndarray


@dataclass(frozen=True)
class CqtConfig:
    """Constant-Q bins upward from fmin; gamma (hertz, or 'erb') widens the low ones: the variable-Q transform."""

    n_bins: int = 84
    sample_rate: int = 22050
    fmin: float = 32.70319566257483
    bins_per_octave: int = 12
    gamma: float | str = 0.0
    tuning: float = 0.0
    filter_scale: float = 1.0
    norm: float = 1.0
    window: Window = field(default_factory=Window)
    scale: bool = True
    hop: int = 512
    pad: str = "zero"

    def __post_init__(self):
        check(min(self.n_bins, self.bins_per_octave, self.hop, self.sample_rate) >= 1, "n_bins, bins_per_octave, hop and sample_rate are positive")
        check(0 < self.fmin < np.inf and np.isfinite(self.tuning), "fmin is positive, tuning finite")
        check(0 < self.filter_scale < np.inf and 0 < self.norm < np.inf, "filter_scale and norm are positive")
        check(self.gamma == "erb" or (not isinstance(self.gamma, str) and 0 <= self.gamma < np.inf), "gamma is 'erb' or not negative")
        check(self.pad in ("reflect", "zero", "edge"), f"unknown padding {self.pad}")
        check(self.cutoff <= self.sample_rate / 2, f"a filter reaches {self.cutoff} Hz, above half the sample rate")

    def frequencies(self) -> np.ndarray:
        octave, step = np.divmod(np.arange(self.n_bins), self.bins_per_octave)
        return 2.0**octave * 2.0 ** (step / self.bins_per_octave) * self.fmin * 2.0 ** (self.tuning / self.bins_per_octave)

    def widths(self) -> tuple[np.ndarray, np.ndarray]:
        """The relative bandwidth and the added bandwidth of each bin."""
        log = np.log2(self.frequencies())
        gap = np.gradient(log) if self.n_bins > 1 else np.array([1 / self.bins_per_octave])
        r = 2.0 ** (2 * gap)
        alpha = (r - 1) / (r + 1)
        return alpha, alpha * 24.7 / 0.108 if self.gamma == "erb" else np.full(self.n_bins, float(self.gamma))

    def filter_lengths(self, rate: float | None = None) -> np.ndarray:
        """Samples that each filter spans, as fractions, at the given rate."""
        alpha, gamma = self.widths()
        return self.filter_scale / alpha * (self.sample_rate if rate is None else rate) / (self.frequencies() + gamma / alpha)

    @property
    def cutoff(self) -> float:
        w, (alpha, gamma) = self.window.values(1000), self.widths()
        noise = 1000 * (w**2).sum() / w.sum() ** 2
        return float((self.frequencies() * (1 + noise * alpha / (2 * self.filter_scale)) + gamma / 2).max())

    @property
    def early(self) -> int:
        """Halvings before the highest octave: as many as the filters and the hop allow."""
        octaves, twos = -(-self.n_bins // self.bins_per_octave), (self.hop & -self.hop).bit_length() - 1
        room = int(np.ceil(np.log2(self.sample_rate / 2 / self.cutoff))) - 2
        return min(max(0, room), max(0, twos - octaves + 1))

    def octaves(self) -> list[Octave]:
        """From the highest down; the rate halves between octaves while the hop is even."""
        out, level, top, f = [], self.early, self.n_bins, self.frequencies()
        while top > 0:
            first = max(0, top - self.bins_per_octave)
            rate, own = self.sample_rate / 2**level, slice(first, top)
            length = self.filter_lengths(rate)[own]
            check(length.max() >= 0.5, "an octave's filters span less than one sample")
            fft = 1 << max(0, int(np.ceil(np.log2(length.max()))))
            basis = np.zeros((top - first, fft), complex)
            for row, size, freq in zip(basis, length, f[own], strict=True):
                t = np.arange(np.floor(-size / 2), np.floor(size / 2))
                wave = np.exp(2j * np.pi * freq * t / rate) * self.window.values(len(t))
                mass = (np.abs(wave) ** self.norm).sum() ** (1 / self.norm)
                at = (fft - len(t)) // 2
                row[at : at + len(t)] = wave / (mass if mass > 2.2250738585072014e-308 else 1.0) * size / fft
            # both the halved signal and the shorter filters carry a factor of sqrt(2) a halving
            gain = 2.0 ** (level - self.early) * 2.0 ** (self.early * (0.5 if self.scale else 1.0))
            if self.scale:
                gain = gain / np.sqrt(self.filter_lengths(self.sample_rate / 2**self.early)[own])[:, None]
            out.append(Octave(first, top - first, level, fft, self.hop >> level, np.fft.fft(basis, axis=1)[:, : fft // 2 + 1] * gain))
            level, top = level + ((self.hop >> level) % 2 == 0), first
        return out

    def chroma_weights(self, n_chroma: int = 12) -> np.ndarray:
        """[n_chroma, n_bins]: ones where a bin belongs to a pitch class, from C up."""
        check(n_chroma >= 1 and self.bins_per_octave % n_chroma == 0, "n_chroma divides bins_per_octave")
        merge = self.bins_per_octave // n_chroma
        shift = int(np.rint((69 + 12 * np.log2(self.fmin / 440)) % 12 * n_chroma / 12))
        pitch = ((np.arange(self.n_bins) + merge // 2) % self.bins_per_octave // merge + shift) % n_chroma
        return (pitch == np.arange(n_chroma)[:, None]).astype(float)
