"""Transforms: tiles and frames through batched FFTs in Arrow batches, the rest in expressions."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ChromaConfig, MelConfig, StftConfig, check
from ..functions import columns as C
from .frames import KEY, clamp_db, tile_signals

#: Frames transformed at a time.
BATCH = 2_048


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _tile_frames(batches: Iterator[pa.RecordBatch], fft: int, hop: int) -> Iterator[tuple]:
    """(batch, row, first frame, frames [n, fft]) of each tile, some thousand frames at a time."""
    for b in batches:
        p0 = b.column("p0").to_pylist()
        for i in range(b.num_rows):
            x = b.column("samples")[i].values.to_numpy()
            frames = np.lib.stride_tricks.sliding_window_view(x, fft)[::hop]
            for lo in range(0, len(frames), BATCH):
                yield b, i, p0[i] + lo, frames[lo : lo + BATCH]


def _map_frames(clips: DataFrame, cfg: StftConfig, frames_per_tile: int, columns: str, of) -> DataFrame:
    """One row per frame: the key, frame and the arrays that of(frames) returns."""
    names = [f.name for f in T.StructType.fromDDL(columns).fields]
    fft, hop = cfg.fft, cfg.hop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, first, frames in _tile_frames(batches, fft, hop):
            n = len(frames)
            key = [pa.repeat(b.column(c)[i], n) for c in KEY]
            yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(first, first + n)), *map(_lists, of(frames))], names=[*KEY, "frame", *names])

    tiles = clips if "p0" in clips.columns else tile_signals(clips, cfg, frames_per_tile)  # tiles are taken as they are
    kinds = dict(clips.dtypes)
    return tiles.select(*KEY, "p0", "samples").mapInArrow(run, f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, frame bigint, {columns}")


def stft(clips: DataFrame, cfg: StftConfig, frames_per_tile: int = 4096) -> DataFrame:
    """clip_id, channel, frame, re, im; a clip without samples has no frame."""
    w = cfg.weights()

    def of(frames):
        z = np.fft.rfft(frames * w, axis=1)
        return z.real.copy(), z.imag.copy()

    return _map_frames(clips, cfg, frames_per_tile, "re array<double>, im array<double>", of)


def stft_range(clips: DataFrame, cfg: StftConfig, p0: int, p1: int, frames_per_tile: int = 4096) -> DataFrame:
    """Frames p0 to p1 only: the other tiles are dropped before any transform."""
    check(0 <= p0 <= p1, "0 <= p0 <= p1")
    w, fft, hop = cfg.weights(), cfg.fft, cfg.hop

    def run(batches):
        for b, i, first, frames in _tile_frames(batches, fft, hop):
            z, n = np.fft.rfft(frames * w, axis=1), len(frames)
            yield pa.RecordBatch.from_arrays([*(pa.repeat(b.column(c)[i], n) for c in KEY), pa.array(np.arange(first, first + n)), _lists(z.real.copy()), _lists(z.imag.copy())], names=[*KEY, "frame", "re", "im"])

    tiles = tile_signals(clips, cfg, frames_per_tile).where((F.col("p0") < p1) & (F.col("p1") > p0)).select(*KEY, "p0", "samples")
    kinds = dict(clips.dtypes)
    rows = tiles.mapInArrow(run, f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, frame bigint, re array<double>, im array<double>")
    return rows.where((F.col("frame") >= p0) & (F.col("frame") < p1))


def power_spectrum(clips: DataFrame, cfg: StftConfig, power: float = 2.0, frames_per_tile: int = 4096) -> DataFrame:
    """clip_id, channel, frame, s: magnitudes of the transform to the given power."""
    w = cfg.weights()

    def of(frames):
        z = np.fft.rfft(frames * w, axis=1)
        square = z.real**2 + z.imag**2
        return (square if power == 2 else square ** (power / 2),)

    return _map_frames(clips, cfg, frames_per_tile, "s array<double>", of)


def _projected(clips: DataFrame, cfg: StftConfig, weights: np.ndarray, power: float, frames_per_tile: int) -> DataFrame:
    w, m = cfg.weights(), weights.T.copy()

    def of(frames):
        z = np.fft.rfft(frames * w, axis=1)
        square = z.real**2 + z.imag**2
        return ((square if power == 2 else square ** (power / 2)) @ m,)

    return _map_frames(clips, cfg, frames_per_tile, "s array<double>", of)


def mel_spectrogram(clips: DataFrame, cfg: StftConfig, mel: MelConfig, power: float = 2.0, frames_per_tile: int = 4096) -> DataFrame:
    return _projected(clips, cfg, mel.weights(cfg.fft), power, frames_per_tile)


def mel_apply(spectra: DataFrame, mel: MelConfig, fft: int) -> DataFrame:
    """The mel filters over given spectra rows."""
    return spectra.withColumn("s", C.project("s", mel.weights(fft)))


def chroma_apply(spectra: DataFrame, chroma: ChromaConfig, fft: int, norm: float | None = None) -> DataFrame:
    """The pitch classes of given spectra rows, normalized as chroma_stft does."""
    return spectra.withColumn("s", C.project("s", chroma.weights(fft))).withColumn("s", C.normalize("s", norm))


def mel_db(clips: DataFrame, cfg: StftConfig, mel: MelConfig, top_db: float = 80.0) -> DataFrame:
    rows = mel_spectrogram(clips, cfg, mel)
    return clamp_db(rows.withColumn("s", F.transform("s", lambda x: C.power_to_db(x))), "s", top_db)


def mfcc(clips: DataFrame, cfg: StftConfig, mel: MelConfig, n_mfcc: int = 20, lifter: float = 0.0) -> DataFrame:
    """Cosine transform of the clamped mel decibels: clip_id, channel, frame, s."""
    check(1 <= n_mfcc <= mel.n_mels, "n_mfcc is between 1 and n_mels")
    return mel_db(clips, cfg, mel).select(*KEY, "frame", C.lifter(C.dct2_ortho("s", mel.n_mels, n_mfcc), n_mfcc, lifter).alias("s"))


def chroma_stft(clips: DataFrame, cfg: StftConfig, chroma: ChromaConfig, power: float = 2.0, norm: float | None = None, frames_per_tile: int = 4096) -> DataFrame:
    """Pitch classes of each frame, divided by their greatest (norm None) or p-norm."""
    rows = _projected(clips, cfg, chroma.weights(cfg.fft), power, frames_per_tile)
    return rows.withColumn("s", C.normalize("s", norm))


def istft(spectra: DataFrame, lengths: DataFrame, cfg: StftConfig) -> DataFrame:
    """Least-squares inverse: clips of (clip_id, channel, n) in lengths, one row each.

    Each frame is cut into hop-sized parts in its task; a part's sums over the
    frames that overlap it are one aggregate, and the squared window is summed
    alike. Frames that begin beyond the length are dropped first.
    """
    check(cfg.hop <= cfg.fft, "hop above fft can't be inverted")
    w, fft, hop, left = cfg.weights(), cfg.fft, cfg.hop, cfg.left
    parts = -(-fft // hop)
    kinds = dict(spectra.dtypes)
    known = spectra.join(lengths.select(*KEY, "n"), list(KEY)).where(F.col("frame") * hop < F.col("n") + left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros(parts * hop)
        square[:fft] = w * w
        for b in batches:
            if not b.num_rows:
                continue
            bins = fft // 2 + 1
            z = b.column("re").flatten().to_numpy().reshape(-1, bins) + 1j * b.column("im").flatten().to_numpy().reshape(-1, bins)
            y = np.zeros((len(z), parts * hop))
            y[:, :fft] = np.fft.irfft(z, fft, axis=1) * w
            frame = b.column("frame").to_numpy()
            each = pa.array(np.repeat(np.arange(len(z)), parts))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(each) for c in KEY), pa.array((frame[:, None] + np.arange(parts)).ravel()), pa.array(np.repeat(frame, parts)), _lists(y.reshape(-1, hop)), _lists(np.tile(square.reshape(parts, hop), (len(z), 1)))],
                names=[*KEY, "part", "frame", "y", "q"],
            )

    schema = f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, part bigint, frame bigint, y array<double>, q array<double>"
    cut = known.select(*KEY, "frame", "re", "im").mapInArrow(run, schema)
    summed = cut.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.struct("frame", "y", "q"))).alias("f"))  # at most `parts` frames each, in order
    zero = F.array_repeat(F.lit(0.0), hop)
    add = lambda c: F.aggregate("f", zero, lambda a, f: F.zip_with(a, f[c], lambda x, y: x + y))
    value = F.zip_with(add("y"), add("q"), lambda y, q: y / F.when(q == 0, 1.0).otherwise(q))
    whole = summed.select(*KEY, "part", value.alias("v")).groupBy(*KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "v"))), lambda p: p["v"])).alias("v"))
    out = lengths.select(*KEY, "n").join(whole, list(KEY), "left")
    samples = F.slice(F.coalesce("v", F.array().cast("array<double>")), left + 1, F.col("n").cast("int"))
    filled = F.concat(samples, F.array_repeat(F.lit(0.0), (F.col("n") - F.size(samples)).cast("int")))
    return out.select(*KEY, "n", filled.alias("samples"))


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places of n, ends mirrored with their edge repeated."""
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _middle(x: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The upper middle of each k neighbours along the axis; k - 1 fewer come out than went in."""
    return np.partition(np.lib.stride_tricks.sliding_window_view(x, k, axis=axis), k // 2, axis=-1)[..., k // 2]


def _median_filter(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The upper middle of k neighbours, ends mirrored with their edge repeated."""
    n = s.shape[axis]
    return _middle(np.take(s, _mirrored(np.arange(-(k // 2), n + k - 1 - k // 2), n), axis=axis), k, axis)


def softmask(x: np.ndarray, other: np.ndarray, power: float, even: bool) -> np.ndarray:
    if np.isinf(power):
        return (x > other).astype(float)
    z = np.maximum(x, other)
    empty = z < C.TINY
    z = np.where(empty, 1.0, z)
    a, b = (x / z) ** power, (other / z) ** power
    return np.where(empty, 0.5 if even else 0.0, a / np.where(empty, 1.0, a + b))


def _by_tiles(spectra: DataFrame, arrays: list[str], columns: str, per: int, halo: int, of) -> DataFrame:
    """of(arrays as [frames, bins], first frame, p0, p1) for each tile of `per` frames; its rows are frames p0 to p1.

    A clip's frames are 0 to n - 1. Each goes to the tiles within `halo` of it, in one
    shuffle by tile, so a tile holds `halo` frames on either side of its own, fewer
    only at an end of the clip: where frames are missing behind it, its last is n - 1.
    """
    check(per >= 1, "frames_per_tile is positive")
    names = [f.name for f in T.StructType.fromDDL(columns).fields]
    kinds, frame = dict(spectra.dtypes), F.col("frame")
    to = F.explode(F.sequence(F.floor(F.greatest(F.lit(0), frame - halo) / per), F.floor((frame + halo) / per)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame").combine_chunks()
        first, end, p0 = t["frame"][0].as_py(), t["frame"][-1].as_py() + 1, t["tile"][0].as_py() * per
        check(end - first == t.num_rows, "the frames of a clip are 0 to n - 1, once each")
        p1 = max(p0, min(end, p0 + per))
        x = [t[a].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for a in arrays]
        out = of(*x, first, p0, p1) if p1 > p0 else [np.zeros((0, 1))] * len(names)  # behind the end there are only neighbours
        return pa.table([*(pa.repeat(t[c][0], p1 - p0) for c in KEY), pa.array(np.arange(p0, p1)), *map(_lists, out)], names=[*KEY, "frame", *names])

    rows = spectra.select(*KEY, "frame", to.alias("tile"), *arrays)
    return rows.groupBy(*KEY, "tile").applyInArrow(run, f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, frame bigint, {columns}")


def _medians_in_time(s: np.ndarray, k: int, first: int, p0: int, p1: int) -> np.ndarray:
    """Of frames p0 to p1, some at a time; s begins at frame `first`."""
    out, n = [], first + len(s)
    for lo in range(p0, p1, 64):
        out.append(_middle(s[_mirrored(np.arange(lo - k // 2, min(p1, lo + 64) + k - 1 - k // 2), n) - first], k, 0))
    return np.concatenate(out)


def median_time(spectra: DataFrame, k: int, frames_per_tile: int = 256) -> DataFrame:
    """The upper middle of k neighbouring frames for each bin, clip ends mirrored with their edge repeated."""
    check(k >= 1, "k is positive")
    return _by_tiles(spectra, ["s"], "s array<double>", frames_per_tile, k // 2, lambda s, *at: (_medians_in_time(s, k, *at),))


def _masks(kernel: tuple[int, int], power: float, margin: tuple[float, float]):
    """of(s, first, p0, p1): the harmonic and the percussive mask of frames p0 to p1."""
    check(min(kernel) >= 1 and power > 0 and min(margin) >= 1, "kernels and power are positive, margins at least 1")
    even = tuple(margin) == (1.0, 1.0)

    def of(s, first, p0, p1):
        h = _medians_in_time(s, kernel[0], first, p0, p1)
        own = s[p0 - first : p1 - first]
        p = np.concatenate([_median_filter(own[lo : lo + 64], kernel[1], 1) for lo in range(0, len(own), 64)])
        return softmask(h, p * margin[0], power, even), softmask(p, h * margin[1], power, even)

    return of


def hpss_masks(spectra: DataFrame, kernel: tuple[int, int] = (31, 31), power: float = 2.0, margin: tuple[float, float] = (1.0, 1.0), frames_per_tile: int = 256) -> DataFrame:
    """harmonic and percussive masks of magnitude rows, by medians along time and along frequency."""
    return _by_tiles(spectra, ["s"], "harmonic array<double>, percussive array<double>", frames_per_tile, kernel[0] // 2, _masks(kernel, power, margin))


def hpss_of_spectrogram(spectra: DataFrame, kernel: tuple[int, int] = (31, 31), power: float = 2.0, margin: tuple[float, float] = (1.0, 1.0), frames_per_tile: int = 256) -> DataFrame:
    """The harmonic and the percussive part of magnitude rows."""
    masks = _masks(kernel, power, margin)

    def of(s, first, p0, p1):
        return [s[p0 - first : p1 - first] * m for m in masks(s, first, p0, p1)]

    return _by_tiles(spectra, ["s"], "harmonic array<double>, percussive array<double>", frames_per_tile, kernel[0] // 2, of)


def hpss_of_stft(z: DataFrame, kernel: tuple[int, int] = (31, 31), power: float = 2.0, margin: tuple[float, float] = (1.0, 1.0), frames_per_tile: int = 256) -> DataFrame:
    """clip_id, channel, frame, part, re, im: two rows a frame, harmonic and percussive, with the phases of z."""
    masks = _masks(kernel, power, margin)

    def of(re, im, first, p0, p1):
        own = slice(p0 - first, p1 - first)
        return [x[own] * m for m in masks(np.hypot(re, im), first, p0, p1) for x in (re, im)]

    both = _by_tiles(z, ["re", "im"], "a array<double>, b array<double>, c array<double>, d array<double>", frames_per_tile, kernel[0] // 2, of)
    part = lambda name, re, im: F.struct(F.lit(name).alias("part"), F.col(re).alias("re"), F.col(im).alias("im"))
    return both.select(*KEY, "frame", F.inline(F.array(part("harmonic", "a", "b"), part("percussive", "c", "d"))))


def hpss_parts(clips: DataFrame, cfg: StftConfig, **options) -> DataFrame:
    """clip_id, channel, part, n, samples: both parts of each clip, at its own length, from one transform and one inverse."""
    named = F.struct("clip_id", "part").alias("clip_id")  # a part is inverted as a clip of its own
    z = hpss_of_stft(stft(clips, cfg), **options).select(named, "channel", "frame", "re", "im")
    lengths = clips.select("*", F.explode(F.array(F.lit("harmonic"), F.lit("percussive"))).alias("part")).select(named, "channel", "n")
    return istft(z, lengths, cfg).select("clip_id.clip_id", "channel", "clip_id.part", "n", "samples")


def hpss(clips: DataFrame, cfg: StftConfig, **options) -> tuple[DataFrame, DataFrame]:
    """The harmonic and the percussive part of each clip; hpss_parts gives both at once."""
    z = hpss_of_stft(stft(clips, cfg), **options)
    harmonic, percussive = (istft(z.where(F.col("part") == name), clips, cfg) for name in ("harmonic", "percussive"))
    return harmonic, percussive


def regions(size: np.ndarray) -> np.ndarray:
    """The peak that each bin of a magnitude row belongs to: bins above two neighbours on either side, parted halfway; no peak, no region."""
    n, k = len(size), np.arange(len(size))
    edge = np.concatenate([[-1.0, -1.0], size, [-1.0, -1.0]])
    peaks = np.flatnonzero(np.all([size > edge[2 + d : 2 + d + n] for d in (-2, -1, 1, 2)], axis=0))
    return k if not len(peaks) else peaks[np.searchsorted((peaks[:-1] + peaks[1:] + 1) // 2, k, "right")]


def phase_vocoder(z: DataFrame, cfg: StftConfig, rate: Fraction, locked: bool = False, frames_per_tile: int = 1024) -> DataFrame:
    """Frames at `rate` times the speed: interpolated magnitudes, accumulated phases of each bin.

    locked: a frame's bins take the phase of their region's peak and keep the phase
    difference to it that they have in the analysis; a frame without peaks is not locked.

    From one output frame to the next the phases move as phase[k] = before[p[k]] + c[k],
    p being the bins themselves unless locked. Such moves join to one of the same
    kind. So output frames are cut into tiles, which any tasks take: each gives its
    frames relative to its beginning and its own joined move, a pass over the moves of
    a clip, in order, gives where each tile begins, and the frames are turned by that.
    """
    check(rate > 0 and frames_per_tile >= 1, "rate and frames_per_tile are positive")
    num, den, omega, per, bins = rate.numerator, rate.denominator, 2 * np.pi * np.arange(cfg.bins) * cfg.hop / cfg.fft, frames_per_tile, cfg.bins
    kinds, keys = dict(z.dtypes), [*KEY, "tile"]
    head = f"clip_id {kinds['clip_id']}, channel {kinds['channel']}"
    up = lambda x: F.ceil(x * den / num)
    # a frame is read by the outputs that begin at it or at the one before
    counts = z.groupBy(*KEY).agg((F.max("frame") + 1).alias("frames"))
    rows = z.select(*KEY, "frame", "re", "im").join(counts, list(KEY)).withColumn("count", up(F.col("frames")))
    lo, hi = F.greatest(F.lit(0), up(F.col("frame") - 1)), F.least(F.col("count"), up(F.col("frame") + 1)) - 1
    rows = rows.where(hi >= lo).withColumn("tile", F.explode(F.sequence(F.floor(lo / per), F.floor(hi / per))))

    def relative(t: pa.Table) -> pa.Table:
        """A tile's magnitudes and moves from its beginning; its whole move, with the clip's first phases, as frame -1."""
        t = t.sort_by("frame").combine_chunks()
        tile, count, frame = t["tile"][0].as_py(), t["count"][0].as_py(), t["frame"].to_numpy()
        x = np.stack(t["re"].to_numpy(zero_copy_only=False)) + 1j * np.stack(t["im"].to_numpy(zero_copy_only=False))
        x = np.concatenate([x, np.zeros((1, bins))])
        i = np.arange(tile * per, min(count, (tile + 1) * per))
        at, part = i * num // den, (i * num % den / den)[:, None]
        one, two = np.searchsorted(frame, at), np.searchsorted(frame, at + 1)  # silence behind the last
        amount, angle = np.abs(x), np.angle(x)
        size = (1 - part) * amount[one] + part * amount[two]
        turn = angle[two] - angle[one] - omega
        turn = omega + turn - 2 * np.pi * np.rint(turn / (2 * np.pi))
        if locked:
            p, c, moves, adds = np.arange(bins), np.zeros(bins), [], []
            for j, a in enumerate(one):
                r = regions(amount[a])
                p, c = p[r], c[r] + (angle[a] - angle[a][r])
                moves.append(p)
                adds.append(c)
                c = c + turn[j]
            moves, adds = np.array([*moves, p], np.int32), np.array([*adds, c])
        else:
            moves, adds = np.tile(np.arange(bins, dtype=np.int32), (len(i) + 1, 1)), np.concatenate([np.zeros((1, bins)), np.cumsum(turn, axis=0)])
        size = np.concatenate([size, angle[one[:1]]])
        n = len(i) + 1
        return pa.table([*(pa.repeat(t[c][0], n) for c in keys), pa.array(np.append(i, -1)), _lists(size), _lists(moves), _lists(adds)], names=[*keys, "frame", "size", "p", "c"])

    parts = rows.groupBy(*keys).applyInArrow(relative, f"{head}, tile bigint, frame bigint, size array<double>, p array<int>, c array<double>")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The phases that each tile of a clip begins with."""
        own, phase = None, None
        for b in batches:
            made = []
            for i in range(b.num_rows):
                key = (b.column("clip_id")[i].as_py(), b.column("channel")[i].as_py())
                if phase is None or key != own:
                    own, phase = key, b.column("size")[i].values.to_numpy()
                made.append(phase)
                phase = phase[b.column("p")[i].values.to_numpy()] + b.column("c")[i].values.to_numpy()
            if made:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), _lists(np.array(made))], names=[*keys, "phase"])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                size, p, c, phase = (b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, bins) for n in ("size", "p", "c", "phase"))
                phase = np.take_along_axis(phase, p.astype(np.int64), axis=1) + c
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (*KEY, "frame")), _lists(size * np.cos(phase)), _lists(size * np.sin(phase))], names=[*KEY, "frame", "re", "im"])

    moves = parts.where("frame = -1").repartition(*KEY).sortWithinPartitions(*keys)
    starts = moves.select(*keys, "size", "p", "c").mapInArrow(begin, f"{head}, tile bigint, phase array<double>")
    both = parts.where("frame >= 0").join(starts, keys)
    return both.select(*KEY, "frame", "size", "p", "c", "phase").mapInArrow(turned, f"{head}, frame bigint, re array<double>, im array<double>")


def time_stretch(clips: DataFrame, cfg: StftConfig, rate: Fraction, locked: bool = False) -> DataFrame:
    lengths = clips.withColumn("n", F.rint(F.col("n") * rate.denominator / rate.numerator).cast("bigint"))
    return istft(phase_vocoder(stft(clips, cfg), cfg, rate, locked), lengths, cfg)


def resample_filter(sample_rate: int, target: int, quality: str = "high") -> tuple[int, int, int, np.ndarray]:
    """Up and down factors, reach K in source samples, and the Kaiser-windowed sinc of 2KL + 1 taps."""
    attenuation = {"fast": 100.0, "high": 126.0, "best": 175.0}[quality]
    g = int(np.gcd(sample_rate, target))
    up, down, edge = target // g, sample_rate // g, 0.913
    width = (1 - edge) / max(up, down)
    taps = int(np.ceil((attenuation - 7.95) / 2.285 / (np.pi * width) + 1)) | 1
    reach = -(-(taps - 1) // (2 * up))
    cut, i = (1 + edge) / (2 * max(up, down)), np.arange(-reach * up, reach * up + 1)
    h = cut * np.sinc(cut * i) * np.i0(0.1102 * (attenuation - 8.7) * np.sqrt(1 - (i / (reach * up)) ** 2))
    return up, down, reach, h * (up / h.sum())


#: Products of taps and samples that are made at once, where a block is short.
AT_ONCE = 1 << 16


def resampled(x: np.ndarray, lo: int, first: int, count: int, up: int, down: int, reach: int, h: np.ndarray) -> np.ndarray:
    """Outputs first to first + count of samples x, which begin at place lo and hold all that is read."""
    padded, i = np.concatenate([h, np.zeros(up)]), first + np.arange(count)
    t, p = i * down // up - reach - lo, i * down % up
    if count * (2 * reach + 1) <= AT_ONCE:  # the same sums in the same order
        s = np.arange(2 * reach + 1)[:, None]
        return np.add.reduce(padded[np.minimum(p + (2 * reach - s) * up, len(padded) - 1)] * x[t + s], axis=0)
    y = np.zeros(count)
    for s in range(2 * reach + 1):
        y += padded[np.minimum(p + (2 * reach - s) * up, len(padded) - 1)] * x[t + s]
    return y


def resample(clips: DataFrame, sample_rate: int, target: int, quality: str = "high", block: int = 65536) -> DataFrame:
    """Clips at the target rate: ceil(n L / M) samples, zeros outside, delay removed.

    A clip is cut into output blocks that carry the source samples they read, so
    a block is computed alone and exactly; the blocks are joined at the end.
    """
    if sample_rate == target:
        return clips
    up, down, reach, h = resample_filter(sample_rate, target, quality)
    out_n = C.output_frames("n", sample_rate, target)
    rows = clips.withColumn("m", out_n).where("m > 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / block))))
    first, last = F.col("b") * block, F.least(F.col("m"), (F.col("b") + 1) * block) - 1
    lo, hi = F.floor(first * down / up) - reach, F.floor(last * down / up) + reach
    rows = rows.select(*KEY, "b", first.alias("first"), (last - first + 1).alias("count"), lo.alias("lo"), C.extend("samples", "n", lo, hi - lo + 1, "zero").alias("x"))
    kinds = dict(clips.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(*(b.column(c).to_pylist() for c in ("first", "count", "lo")), b.column("x"), strict=True)
            out = [resampled(x.values.to_numpy(), lo_, first_, count, up, down, reach, h) for first_, count, lo_, x in each]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEY, "b")), pa.array(out, pa.list_(pa.float64()))], names=[*KEY, "b", "y"])

    made = rows.mapInArrow(run, f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, b bigint, y array<double>")
    whole = made.groupBy(*KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", "y"))), lambda p: p["y"])).alias("samples"))
    rest = clips.drop("samples", "sample_rate", "n").join(whole, list(KEY), "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))
    return rest.select(*KEY, F.lit(target).alias("sample_rate"), F.size("samples").cast("bigint").alias("n"), "samples")


def pitch_shift(clips: DataFrame, cfg: StftConfig, ratio: Fraction, quality: str = "high", locked: bool = False) -> DataFrame:
    """Stretched by the ratio, then resampled back to its own length."""
    stretched = time_stretch(clips, cfg, 1 / ratio, locked)
    moved = resample(stretched, ratio.numerator, ratio.denominator, quality)
    back = moved.select(*KEY, "samples").join(clips.select(*KEY, "sample_rate", "n"), list(KEY))
    cut = F.slice("samples", 1, F.col("n").cast("int"))
    return back.select(*KEY, "sample_rate", "n", F.concat(cut, F.array_repeat(F.lit(0.0), (F.col("n") - F.size(cut)).cast("int"))).alias("samples"))


def _signal_length(frames: int, cfg: StftConfig) -> int:
    """Samples that `frames` frames cover, borders left out."""
    return (frames - 1) * cfg.hop + cfg.fft - cfg.left - cfg.right


def _reanalysis(cfg: StftConfig, first: int, count: int, frames: int):
    """of(spectra of frames first to first + count): their signal by overlap-add, its borders made as for a clip, transformed again.

    frames: those of the clip. Frames within ceil(fft / hop) + 1 of an end that is not the clip's come out wrong.
    """
    w, fft, hop, parts = cfg.weights(), cfg.fft, cfg.hop, -(-cfg.fft // cfg.hop)
    wide = parts * hop

    def added(y: np.ndarray) -> np.ndarray:
        out = np.zeros((count + parts - 1, hop))
        for j in range(parts):
            out[j : j + count] += y[:, j * hop : (j + 1) * hop]
        return out.ravel()[: (count - 1) * hop + fft]

    square = np.zeros(wide)
    square[:fft] = w * w
    norm = added(np.broadcast_to(square, (count, wide)))
    norm[norm == 0] = 1.0
    n, start = _signal_length(frames, cfg), cfg.left - first * hop  # where the signal begins in this run of frames
    at = np.arange(len(norm)) - start
    outside = np.flatnonzero((at < 0) | (at >= n))
    q = at[outside]
    if cfg.pad == "reflect":
        q = np.mod(q, max(2 * (n - 1), 1))
        q = np.zeros_like(q) if n == 1 else np.where(q < n, q, 2 * (n - 1) - q)
    read = np.clip(np.clip(q, 0, n - 1) + start, 0, len(norm) - 1)

    def of(z: np.ndarray) -> np.ndarray:
        y = np.zeros((count, wide))
        y[:, :fft] = np.fft.irfft(z, fft, axis=1) * w
        y = added(y) / norm
        y[outside] = 0.0 if cfg.pad == "zero" else y[read]
        return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, fft)[::hop] * w, axis=1)

    return of


def griffin_lim(
    spectra: DataFrame, cfg: StftConfig, iterations: int = 32, momentum: float = 0.99, init: str | None = None, frames_per_tile: int = 512, together: int = 8
) -> DataFrame:
    """re, im of a signal whose magnitudes approach the given ones; istft gives it at any length.

    init: a column of first phases, in radians; zero without one. An iteration moves
    what a frame knows by ceil(fft / hop) + 1 frames, so tiles that carry that many
    neighbours for each of `together` iterations do these alone, and
    iterations / together shuffles do all, for clips of any length.
    """
    check(cfg.hop <= cfg.fft and momentum >= 0 and iterations >= 1 and together >= 1, "hop above fft, negative momentum, or no iteration")
    reach, beta = -(-cfg.fft // cfg.hop) + 1, momentum / (1 + momentum)
    phase = [F.transform(init, F.cos), F.transform(init, F.sin)] if init else [F.transform("s", lambda _: F.lit(1.0)), F.transform("s", lambda _: F.lit(0.0))]
    zero = F.transform("s", lambda _: F.lit(0.0))
    rows = spectra.select(*KEY, "frame", "s", *(c.alias(n) for c, n in zip((*phase, zero, zero), ("p", "q", "a", "b"), strict=True)))

    def passed(count: int):
        def of(s, p, q, a, b, first, p0, p1):
            phase, before = p + 1j * q, a + 1j * b
            if _signal_length(first + len(s), cfg) > 0:
                again = _reanalysis(cfg, first, len(s), first + len(s))
                for _ in range(count):
                    c = again(s * phase)
                    moved = c - beta * before
                    before, size = c, np.abs(moved)
                    phase = np.where(size > C.TINY, moved / np.where(size > C.TINY, size, 1.0), 1.0)
            own = slice(p0 - first, p1 - first)
            return s[own], *(x[own].copy() for x in (phase.real, phase.imag, before.real, before.imag))

        return of

    for done in range(0, iterations, together):
        count = min(together, iterations - done)
        rows = _by_tiles(rows, ["s", "p", "q", "a", "b"], ", ".join(f"{n} array<double>" for n in "spqab"), frames_per_tile, reach * count, passed(count))
    times = lambda c: F.zip_with("s", c, lambda x, y: x * y)
    return rows.select(*KEY, "frame", times("p").alias("re"), times("q").alias("im"))


def spectral_convergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Norm of the difference of two magnitude tables over the norm of the second, for each clip."""
    both = a.select(*KEY, "frame", F.col("s").alias("x")).join(b.select(*KEY, "frame", F.col("s").alias("y")), [*KEY, "frame"])
    gap = C.total(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)))
    return both.groupBy(*KEY).agg((F.sqrt(F.sum(gap)) / F.sqrt(F.sum(C.dot("y", F.col("y"))))).alias("convergence"))
