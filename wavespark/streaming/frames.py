"""Chunks of signals to features in Structured Streaming: any chunking gives what the whole clip gives.

Chunks are rows (clip_id, channel, seq, samples, last, and ts or none), seq from 0, in
any order; ordered.py says how lost, late and repeated ones are told apart and when a
clip's state goes. Each function returns what was made, with the clip's segment; with
whole=True rejects come with it, as taken() and rejects() split them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChromaConfig, CqtConfig, MelConfig, StftConfig, check
from ..functions import columns as C
from .kernels import CqtKernel, FrameKernel, InverseKernel, OnsetKernel, ResampleKernel
from .ordered import ordered, taken


def _made(chunks: DataFrame, kernel, whole: bool = False, **options) -> DataFrame:
    rows = ordered(chunks, kernel, **options)
    return rows if whole else taken(rows)


def stream_frames(chunks: DataFrame, cfg: StftConfig, columns: str, of, **options) -> DataFrame:
    """clip_id, channel, segment, frame and the columns that of(frames [n, fft]) gives, each frame once its samples are in."""
    return _made(chunks, FrameKernel(cfg, columns, of), **options)


def stream_stft(chunks: DataFrame, cfg: StftConfig, **options) -> DataFrame:
    w = cfg.weights()

    def of(frames):
        z = np.fft.rfft(frames * w, axis=1)
        return z.real, z.imag

    return stream_frames(chunks, cfg, "re array<double>, im array<double>", of, **options)


def stream_power(chunks: DataFrame, cfg: StftConfig, power: float = 2.0, **options) -> DataFrame:
    w = cfg.weights()
    return stream_frames(chunks, cfg, "s array<double>", lambda x: (np.abs(np.fft.rfft(x * w, axis=1)) ** power,), **options)


def stream_mel(chunks: DataFrame, cfg: StftConfig, mel: MelConfig, power: float = 2.0, **options) -> DataFrame:
    w, m = cfg.weights(), mel.weights(cfg.fft).T.copy()
    return stream_frames(chunks, cfg, "s array<double>", lambda x: ((np.abs(np.fft.rfft(x * w, axis=1)) ** power) @ m,), **options)


def stream_rms(chunks: DataFrame, length: int = 2048, hop: int = 512, **options) -> DataFrame:
    cfg = StftConfig(fft=length, hop=hop, pad="zero")
    return stream_frames(chunks, cfg, "rms double", lambda x: (np.sqrt((x * x).sum(axis=1) / length),), **options)


def stream_zcr(chunks: DataFrame, length: int = 2048, hop: int = 512, threshold: float = 1e-10, **options) -> DataFrame:
    cfg = StftConfig(fft=length, hop=hop, pad="edge")

    def of(x):
        negative = x < -threshold
        return ((negative[:, 1:] != negative[:, :-1]).sum(axis=1) / length,)

    return stream_frames(chunks, cfg, "zcr double", of, **options)


def stream_chroma(chunks: DataFrame, cfg: StftConfig, chroma: ChromaConfig, power: float = 2.0, norm: float | None = None, **options) -> DataFrame:
    w, m = cfg.weights(), chroma.weights(cfg.fft).T.copy()
    rows = stream_frames(chunks, cfg, "s array<double>", lambda x: ((np.abs(np.fft.rfft(x * w, axis=1)) ** power) @ m,), **options)
    return rows.withColumn("s", C.normalize("s", norm))


def stream_onset(chunks: DataFrame, cfg: StftConfig, mel: MelConfig, lag: int = 1, **options) -> DataFrame:
    """clip_id, channel, segment, frame, onset: onset strength of mel decibels that are not clamped."""
    return _made(chunks, OnsetKernel(cfg, mel, lag), **options)


def stream_istft(chunks: DataFrame, cfg: StftConfig, **options) -> DataFrame:
    """clip_id, channel, segment, start, samples: streamed spectra (clip_id, channel, frame, re, im, last, and ts or none) back to samples."""
    ts = [c for c in ("ts",) if c in chunks.columns]
    rows = chunks.select("clip_id", "channel", F.col("frame").alias("seq"), F.concat("re", "im").alias("samples"), "last", *ts)
    return _made(rows, InverseKernel(cfg), **options)


def stream_resample(chunks: DataFrame, sample_rate: int, target: int, quality: str = "high", **options) -> DataFrame:
    """clip_id, channel, segment, start, samples at the target rate: ceil(n L / M) of them, delay removed."""
    return _made(chunks, ResampleKernel(sample_rate, target, quality), **options)


def stream_cqt(chunks: DataFrame, cfg: CqtConfig, **options) -> DataFrame:
    """clip_id, channel, segment, frame, re, im over the bins of cfg."""
    return _made(chunks, CqtKernel(cfg, "re array<double>, im array<double>", lambda z: (z.real.copy(), z.imag.copy())), **options)


def window_rms(rows: DataFrame, key: str, ts: str, value: Column | str, length: str, hop: str | None = None, late: str = "1 hour") -> DataFrame:
    """Root mean square of event-time windows, tumbling or sliding; the same plan for a table and for a stream."""
    check(bool(length), "a window has a length")
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    seen = rows.withWatermark(ts, late) if rows.isStreaming else rows
    made = seen.groupBy(F.window(ts, length, hop or length), F.col(key).alias("clip_id")).agg(F.count(x).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"))
    return made.select("clip_id", F.col("window.start").alias("start"), "n", "rms")
