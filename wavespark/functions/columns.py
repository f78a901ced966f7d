"""Column to column: conversions and arithmetic on array columns; nothing here shuffles or leaves the JVM."""

from __future__ import annotations

from math import log, pi, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import StftConfig, check

TINY = 2.2250738585072014e-308


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def power_to_db(s, reference: float = 1.0, amin: float = 1e-10) -> Column:
    check(amin > 0 and reference > 0, "amin and reference are positive")
    return 10 * F.log10(F.greatest(F.lit(amin), _c(s))) - 10 * float(np.log10(max(amin, reference)))


def amplitude_to_db(s, reference: float = 1.0, amin: float = 1e-5) -> Column:
    check(amin > 0 and reference > 0, "amin and reference are positive")
    return 20 * F.log10(F.greatest(F.lit(amin), F.abs(_c(s)))) - 20 * float(np.log10(max(amin, reference)))


def db_to_power(db, reference: float = 1.0) -> Column:
    return reference * F.pow(F.lit(10.0), _c(db) / 10)


def db_to_amplitude(db, reference: float = 1.0) -> Column:
    return reference * F.pow(F.lit(10.0), _c(db) / 20)


def hz_to_mel(f, scale: str = "slaney") -> Column:
    f = _c(f)
    if scale == "htk":
        return 2595 * F.log10(1 + f / 700)
    return F.when(f < 1000, f * 3 / 200).otherwise(15 + F.ln(f / 1000) / (log(6.4) / 27))


def mel_to_hz(m, scale: str = "slaney") -> Column:
    m = _c(m)
    if scale == "htk":
        return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)
    return F.when(m < 15, m * 200 / 3).otherwise(1000 * F.exp((m - 15) * (log(6.4) / 27)))


def hz_to_midi(f) -> Column:
    ratio = _c(f) / 440  # may be zero where f is not
    return F.when(ratio == 0, float("-inf")).when(ratio < 0, float("nan")).otherwise(69 + 12 * F.log2(ratio))


def midi_to_hz(m) -> Column:
    return 440 * F.pow(F.lit(2.0), (_c(m) - 69) / 12)


def frames_to_time(frame, sample_rate, hop: int) -> Column:
    return _c(frame) * hop / _c(sample_rate)


def time_to_frames(t, sample_rate, hop: int) -> Column:
    return F.floor(_c(t) * _c(sample_rate) / hop)


def frame_count(n, cfg: StftConfig) -> Column:
    n = _c(n)
    padded = n + (cfg.left + cfg.right)
    return F.when((n == 0) | (padded < cfg.fft), F.lit(0).cast("bigint")).otherwise(1 + F.floor((padded - cfg.fft) / cfg.hop))


def first_complete(cfg: StftConfig) -> int:
    return -(-cfg.left // cfg.hop)


def last_complete(n, cfg: StftConfig) -> Column:
    reach = _c(n) + (cfg.left - cfg.fft)
    return F.when(reach < 0, F.lit(0).cast("bigint")).otherwise(F.least(frame_count(n, cfg), F.floor(reach / cfg.hop) + 1))


def output_frames(n, sample_rate: int, target: int) -> Column:
    g = int(np.gcd(sample_rate, target))
    return F.ceil(_c(n) * (target // g) / (sample_rate // g))


def magnitude(re, im, power: float = 1.0) -> Column:
    def of(a, b):
        square = a * a + b * b
        return square if power == 2 else F.sqrt(square) if power == 1 else F.pow(square, F.lit(power / 2))

    return F.zip_with(_c(re), _c(im), of)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x, weights) -> Column:
    return total(F.zip_with(_c(x), weights if isinstance(weights, Column) else literal(weights), lambda a, b: a * b))


def project(s, weights: np.ndarray) -> Column:
    """The product of a small matrix with an array, each row over its own bins only."""
    rows = []
    for w in weights:
        at = np.flatnonzero(w)
        lo, hi = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 1)
        rows.append(dot(F.slice(_c(s), lo + 1, hi - lo), w[lo:hi]))
    return F.array(*rows)


def dct2_ortho(x, n_in: int, n_out: int) -> Column:
    j, k = np.arange(n_in), np.arange(n_out)[:, None]
    basis = 2 * np.cos(pi * k * (2 * j + 1) / (2 * n_in)) * np.where(k == 0, 1 / sqrt(4 * n_in), 1 / sqrt(2 * n_in))
    return project(x, basis)


def lifter(x, n: int, amount: float) -> Column:
    if amount == 0:
        return _c(x)
    return F.zip_with(_c(x), literal(1 + amount / 2 * np.sin(pi * (np.arange(n) + 1) / amount)), lambda a, b: a * b)


def valid_magnitudes(s) -> Column:
    return F.forall(_c(s), lambda x: (x >= 0) & ~F.isnan(x))


def pcm_quantize(x, bits: int) -> Column:
    """Whole samples that saturate at full scale."""
    scale = float(1 << (bits - 1))
    return F.least(F.greatest(F.rint(_c(x) * scale), F.lit(-scale)), F.lit(scale - 1)).cast("bigint")


def normalize(s, p: float | None = None) -> Column:
    """Divided by its greatest magnitude (p None) or p-norm; a norm below the least normal number divides by 1."""
    s = _c(s)
    size = F.array_max(F.transform(s, F.abs)) if p is None else F.pow(total(F.transform(s, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1 / p))
    return F.element_at(F.transform(F.array(F.when(size < TINY, 1.0).otherwise(size)), lambda z: F.transform(s, lambda x: x / z)), 1)


def extend(samples, n, start, length, pad: str) -> Column:
    """`length` samples from place `start`, which may lie outside 0..n: zeros, the edge, or the signal mirrored about its ends."""
    samples, n, start, length = _c(samples), _c(n), _c(start), _c(length)
    inside = (start >= 0) & (start + length <= n)

    def at(q: Column) -> Column:
        if pad == "zero":
            return F.when((q >= 0) & (q < n), F.get(samples, q.cast("int"))).otherwise(0.0)
        if pad == "edge":
            return F.get(samples, F.greatest(F.lit(0), F.least(q, n - 1)).cast("int"))
        period = F.greatest(2 * (n - 1), F.lit(1))
        r = F.pmod(q, period)
        return F.get(samples, F.when(n == 1, 0).when(r < n, r).otherwise(period - r).cast("int"))

    outside = F.transform(F.sequence(start, start + length - 1), at)
    return F.when(inside, F.slice(samples, (F.greatest(start, F.lit(0)) + 1).cast("int"), length.cast("int"))).otherwise(outside)


def spectral_peaks(s) -> Column:
    """Bins above each of their two neighbours on either side (those that exist)."""
    s = _c(s)
    above = lambda x, i, d: F.coalesce(x > F.when(i + d >= 0, F.get(s, (i + d).cast("int"))), F.lit(True))
    flags = F.transform(s, lambda x, i: F.when(above(x, i, -2) & above(x, i, -1) & above(x, i, 1) & above(x, i, 2), i))
    return F.filter(flags, lambda i: i.isNotNull())


def median_freq(s, k: int) -> Column:
    """The upper middle of k neighbouring bins, ends mirrored with their edge repeated."""
    s, n = _c(s), F.size(_c(s))

    def mirrored(q: Column) -> Column:
        r = F.pmod(q, 2 * n)
        return F.get(s, F.when(r < n, r).otherwise(2 * n - 1 - r))

    return F.transform(s, lambda _, i: F.get(F.array_sort(F.transform(F.sequence(i - k // 2, i + (k - 1 - k // 2)), mirrored)), F.lit(k // 2)))
