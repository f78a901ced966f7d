"""Kernels of streamed transforms: any chunking of a clip gives the rows of the whole clip.

A kernel's state is some counters and an array of doubles, which load() takes and
dump() gives; fresh() is the state before anything came.
"""

from __future__ import annotations

import numpy as np

from ..config import CqtConfig, MelConfig, StftConfig, check
from ..operators.constant_q import tiles_of
from ..operators.transforms import resample_filter, resampled


def _at(q: np.ndarray, n: int | None, pad: str) -> tuple[np.ndarray, np.ndarray]:
    """Source places of positions q and whether they count; n is None until the clip has ended."""
    if pad == "zero":
        return np.clip(q, 0, None if n is None else n - 1), (q >= 0) & (q < (q.max() + 1 if n is None else n))
    if pad == "edge":
        return np.clip(q, 0, None if n is None else n - 1), np.ones(q.shape, bool)
    if n is None:
        return np.abs(q), np.ones(q.shape, bool)
    period = max(1, 2 * (n - 1))
    r = np.mod(q, period)
    return np.where(n == 1, 0, np.where(r < n, r, period - r)), np.ones(q.shape, bool)


class FrameKernel:
    """Frames of samples: the state is the samples that later frames read."""

    def __init__(self, cfg: StftConfig, columns: str, of):
        self.cfg, self.columns, self.of = cfg, f"frame bigint, {columns}", of

    def fresh(self):
        return [0, 0, 0], np.zeros(0)

    def load(self, numbers, values):
        (self.base, self.received, self.frame), self.tail = numbers, values

    def dump(self):
        return [self.base, self.received, self.frame], self.tail

    def frames(self, ended: bool) -> np.ndarray:
        """The frames that can be made now, [n, fft]."""
        cfg, n = self.cfg, self.received
        if ended:
            padded = n + cfg.left + cfg.right
            stop = 0 if n == 0 or padded < cfg.fft else 1 + (padded - cfg.fft) // cfg.hop
        else:
            stop = 0 if n <= cfg.left else (n + cfg.left - cfg.fft) // cfg.hop + 1
        count = max(0, stop - self.frame)
        if not count:
            return np.zeros((0, cfg.fft))
        q = (self.frame + np.arange(count))[:, None] * cfg.hop - cfg.left + np.arange(cfg.fft)
        at, counts = _at(q, n if ended else None, cfg.pad)
        out = np.where(counts, self.tail[at - self.base], 0.0)
        self.frame += count
        keep = max(self.base, min(self.frame * cfg.hop - cfg.left, n - 1 - cfg.right))
        self.tail, self.base = self.tail[keep - self.base :], keep
        return out

    def take(self, x: np.ndarray) -> np.ndarray:
        self.tail, self.received = np.concatenate([self.tail, x]), self.received + len(x)
        return self.frames(False)

    def _rows(self, frames: np.ndarray) -> list[tuple]:
        first = self.frame - len(frames)
        return [(first + i, *row) for i, row in enumerate(zip(*map(list, self.of(frames)), strict=True))] if len(frames) else []

    def step(self, x: np.ndarray) -> list[tuple]:
        return self._rows(self.take(x))

    def flush(self) -> list[tuple]:
        return self._rows(self.frames(True))


class OnsetKernel:
    """Onset strength from samples: the state of frames, `lag` frames of mel decibels, and the fluxes that are not due yet.

    Decibels are not clamped, as their maximum is not known before the end.
    """

    columns = "frame bigint, onset double"

    def __init__(self, cfg: StftConfig, mel: MelConfig, lag: int = 1, power: float = 2.0, amin: float = 1e-10):
        check(lag >= 1, "lag is positive")
        self.inner, self.lag, self.power, self.amin = FrameKernel(cfg, "x array<double>", None), lag, power, amin
        self.window, self.mel = cfg.weights(), mel.weights(cfg.fft).T.copy()
        self.shift = cfg.fft // (2 * cfg.hop) if cfg.alignment == "centered" else 0

    def fresh(self):
        return self.inner.fresh()

    def load(self, numbers, values):
        base, received, frame = numbers
        tail, before = received - base, min(frame, self.lag) * self.mel.shape[1]
        self.inner.load(numbers, values[:tail])
        self.before, self.flux = values[tail : tail + before].reshape(-1, self.mel.shape[1]), values[tail + before :].tolist()

    def dump(self):
        numbers, tail = self.inner.dump()
        return numbers, np.concatenate([tail, self.before.ravel(), self.flux])

    def _rows(self, frames: np.ndarray) -> list[tuple]:
        first, out = self.inner.frame - len(frames), []
        if not len(frames):
            return out
        db = 10 * np.log10(np.maximum(self.amin, np.abs(np.fft.rfft(frames * self.window, axis=1)) ** self.power @ self.mel))
        every = np.concatenate([self.before, db])
        rise = np.maximum(0.0, every[self.lag :] - every[: -self.lag]).mean(axis=1) if len(every) > self.lag else np.zeros(0)
        self.flux += [0.0] * (len(db) - len(rise)) + rise.tolist()
        for frame in range(first, first + len(db)):
            out.append((frame, self.flux.pop(0) if frame >= self.shift else 0.0))
        self.before = every[-self.lag :]
        return out

    def step(self, x: np.ndarray) -> list[tuple]:
        return self._rows(self.inner.take(x))

    def flush(self) -> list[tuple]:
        return self._rows(self.inner.frames(True))


class InverseKernel:
    """Overlap-add of frames to samples: the state is the sums that later frames still add to.

    A chunk is frames, each the real and then the imaginary parts of its bins. The
    first `left` samples are trimmed, and at the end the last `right`; the result is
    the inverse of a clip with as many samples as its frames then cover.
    """

    columns = "start bigint, samples array<double>"

    def __init__(self, cfg: StftConfig):
        check(cfg.hop <= cfg.fft, "hop above fft can't be inverted")
        self.cfg, self.window = cfg, cfg.weights()

    def fresh(self):
        return [0], np.zeros(2 * self.cfg.fft)

    def load(self, numbers, values):
        self.frames, (self.sums, self.weights) = numbers[0], np.array(values).reshape(2, -1)

    def dump(self):
        return [self.frames], np.concatenate([self.sums, self.weights])

    def _out(self, at: int, sums: np.ndarray, weights: np.ndarray) -> list[tuple]:
        """Samples from padded place `at` on, less the head."""
        y = sums / np.where(weights == 0, 1.0, weights)
        cut = max(0, self.cfg.left - at)
        return [(max(0, at - self.cfg.left), y[cut:])] if len(y) > cut else []

    def step(self, x: np.ndarray) -> list[tuple]:
        cfg = self.cfg
        z = x.reshape(-1, 2, cfg.bins)
        y = np.fft.irfft(z[:, 0] + 1j * z[:, 1], cfg.fft, axis=1) * self.window
        first, square = self.frames * cfg.hop, self.window**2
        sums, weights = (np.concatenate([s, np.zeros(len(y) * cfg.hop)]) for s in (self.sums, self.weights))
        for i, frame in enumerate(y):
            sums[i * cfg.hop : i * cfg.hop + cfg.fft] += frame
            weights[i * cfg.hop : i * cfg.hop + cfg.fft] += square
        done = len(y) * cfg.hop
        self.frames, self.sums, self.weights = self.frames + len(y), sums[done:], weights[done:]
        return self._out(first, sums[:done], weights[:done])

    def flush(self) -> list[tuple]:
        """What the last frame reaches beyond the grid of hops, less the tail."""
        rest = self.cfg.fft - self.cfg.hop - self.cfg.right
        return self._out(self.frames * self.cfg.hop, self.sums[:rest], self.weights[:rest]) if self.frames and rest > 0 else []


class ResampleKernel:
    """Samples at another rate: the state is the source samples that the next outputs read, at most two reaches and a chunk."""

    columns = "start bigint, samples array<double>"

    def __init__(self, sample_rate: int, target: int, quality: str = "high"):
        self.up, self.down, self.reach, self.taps = resample_filter(sample_rate, target, quality)

    def fresh(self):
        return [-self.reach, 0, 0], np.zeros(self.reach)

    def load(self, numbers, values):
        (self.base, self.received, self.made), self.tail = numbers, values

    def dump(self):
        return [self.base, self.received, self.made], self.tail

    def _out(self, stop: int) -> list[tuple]:
        if stop <= self.made:
            return []
        first, self.made = self.made, stop
        y = resampled(self.tail, self.base, first, stop - first, self.up, self.down, self.reach, self.taps)
        keep = max(self.base, min(stop * self.down // self.up - self.reach, self.received))
        self.tail, self.base = self.tail[keep - self.base :], keep
        return [(first, y)]

    def step(self, x: np.ndarray) -> list[tuple]:
        self.tail, self.received = np.concatenate([self.tail, x]), self.received + len(x)
        return self._out(max(0, -(-(self.received - self.reach) * self.up // self.down)))

    def flush(self) -> list[tuple]:
        self.tail = np.concatenate([self.tail, np.zeros(self.reach + 1)])
        return self._out(-(-self.received * self.up // self.down))


class CqtKernel:
    """Columns of a constant-Q transform: one leaves when its slowest octave has all it reads; the state is the raw samples since."""

    def __init__(self, cfg: CqtConfig, columns: str, of):
        self.cfg, self.columns, self.of = cfg, f"frame bigint, {columns}", of
        self.halo, self.tile, self.count = tiles_of(cfg)

    def fresh(self):
        return [0, 0, 0], np.zeros(0)

    def load(self, numbers, values):
        (self.base, self.received, self.frame), self.tail = numbers, values

    def dump(self):
        return [self.base, self.received, self.frame], self.tail

    def _out(self, stop: int) -> list[tuple]:
        if stop <= self.frame:
            return []
        first, self.frame = self.frame, stop
        hi = min(self.received, (stop - 1) * self.cfg.hop + self.halo + 1)
        z = self.of(self.tile(self.tail[: hi - self.base], self.received, first, stop))
        keep = max(self.base, min(stop * self.cfg.hop - self.halo, self.received))
        self.tail, self.base = self.tail[keep - self.base :], keep
        return [(first + i, *row) for i, row in enumerate(zip(*map(list, z), strict=True))]

    def step(self, x: np.ndarray) -> list[tuple]:
        self.tail, self.received = np.concatenate([self.tail, x]), self.received + len(x)
        return self._out((self.received - self.halo - 1) // self.cfg.hop + 1)

    def flush(self) -> list[tuple]:
        return self._out(self.count(self.received))
