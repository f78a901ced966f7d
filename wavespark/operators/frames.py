"""Signals from tables, frames of signals, and features of frames: built-in expressions, but for the characters of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StftConfig, check
from ..functions import columns as C

KEY = ("clip_id", "channel")
#: Characters of texts that are handed on at a time, about.
POINTS = 1 << 20


def signals_from_table(df: DataFrame, key: str, order: list[str], value: Column | str, sample_rate: int = 22050) -> DataFrame:
    """Clips from any ordered table: one clip of each key, its samples in the given order.

    A clip becomes one row, so keys should have up to some million rows.
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.col(key).alias("clip_id"), F.struct(*order, x.cast("double").alias("x")).alias("s"))
    grouped = rows.groupBy("clip_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    samples = F.transform("s", lambda s: s["x"])
    return grouped.select("clip_id", F.lit(0).alias("channel"), F.lit(sample_rate).alias("sample_rate"), F.size("s").cast("bigint").alias("n"), samples.alias("samples"))


def signals_from_arrays(df: DataFrame, key: str, array: str, sample_rate: int = 22050) -> DataFrame:
    samples = F.transform(array, lambda x: x.cast("double"))
    return df.select(F.col(key).alias("clip_id"), F.lit(0).alias("channel"), F.lit(sample_rate).alias("sample_rate"), F.size(array).cast("bigint").alias("n"), samples.alias("samples"))


def code_point_signals(df: DataFrame, key: str, text: str, sample_rate: int = 22050) -> DataFrame:
    """A text's characters as samples, all but U+0000; a null text has none."""

    def clips(ids: list, points: list, kind: pa.DataType) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, points)]).astype(np.int32)
        samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *points])))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(np.diff(ends).astype(np.int64)), samples], names=["clip_id", "n", "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, points, held, kind = [], [], 0, b.column("i").type
            for i, t in zip(b.column("i").to_pylist(), b.column("t"), strict=True):
                x = np.frombuffer((t.as_py() or "").encode("utf-32-le"), "<u4")
                ids.append(i)
                points.append(x[x > 0].astype(float))
                held += len(x)
                if held > POINTS:
                    yield clips(ids, points, kind)
                    ids, points, held = [], [], 0
            yield clips(ids, points, kind)

    made = df.select(F.col(key).alias("i"), F.col(text).alias("t")).mapInArrow(run, f"clip_id {dict(df.dtypes)[key]}, n bigint, samples array<double>")
    return made.select("clip_id", F.lit(0).alias("channel"), F.lit(sample_rate).alias("sample_rate"), "n", "samples")


def to_blocks(clips: DataFrame, block: int = 65536) -> DataFrame:
    """Clips cut into blocks, so that a long one is many rows."""
    at = F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).otherwise(F.array().cast("array<bigint>")))
    out = clips.withColumn("block", at)
    start = F.col("block") * block
    return out.withColumns({"start": start, "samples": F.slice("samples", (start + 1).cast("int"), block)})


def blocks_from_table(df: DataFrame, key: str, order: list[str], value: Column | str, folder: str, sample_rate: int = 22050, block: int = 65536) -> DataFrame:
    """Blocks of clips from any ordered table: keys of any size, as no key's rows come together in one task.

    The rows are spread by ranges of key and order and written to folder, so that
    every later reading sees the same ranges; a row's place in its clip is that in
    its range plus the rows of the clip in earlier ranges.
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.col(key).alias("clip_id"), *order, x.cast("double").alias("x"))
    names = [f"o{i}" for i in range(len(order))]
    rows = rows.select("clip_id", *(F.col(c).alias(n) for c, n in zip(order, names, strict=True)), "x").repartitionByRange("clip_id", *names).sortWithinPartitions("clip_id", *names)
    rows.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder).select("clip_id", "x", "at", F.shiftright("at", 33).alias("range"))
    parts = rows.groupBy("clip_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("clip_id")
    before = F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("clip_id", "range", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n"))
    parts = parts.select(F.col("clip_id").alias("__key"), F.col("range").alias("__range"), "first", "before", "n")
    same = F.col("clip_id").eqNullSafe(F.col("__key")) & (F.col("range") == F.col("__range"))  # a null key is a clip of its own
    placed = rows.join(parts, same).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    cut = placed.groupBy("clip_id", "n", F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return cut.select("clip_id", F.lit(0).alias("channel"), F.lit(sample_rate).alias("sample_rate"), "n", "block", (F.col("block") * block).alias("start"), F.transform("s", lambda v: v["x"]).alias("samples"))


def tiles_of_blocks(blocks: DataFrame, cfg: StftConfig, frames_per_tile: int = 4096) -> DataFrame:
    """Tiles as tile_signals gives them, from blocks: each block hands its samples to the tiles that read them, in one shuffle by tile.

    A tile reads no further than itself for its borders, so a clip has to be longer
    than a frame or fit one tile.
    """
    check(frames_per_tile >= 1, "frames_per_tile is positive")
    out = blocks.withColumn("frames", C.frame_count("n", cfg)).where("frames > 0")
    step, reach = frames_per_tile * cfg.hop, (frames_per_tile - 1) * cfg.hop + cfg.fft
    end = F.col("start") + F.size("samples")
    last = F.floor((F.col("frames") - 1) / frames_per_tile)
    # the first and the last tile also take a frame's length at their end of the clip, which borders are made from
    t0 = F.least(last, F.greatest(F.lit(0), F.floor((F.col("start") + cfg.left - reach - cfg.fft) / step) + 1))
    t1 = F.least(last, F.floor((end - 1 + cfg.left + cfg.fft) / step))
    out = out.withColumn("tile", F.explode(F.sequence(t0, F.greatest(t0, t1))))
    lo = F.greatest(F.lit(0), F.least(F.col("tile") * step - cfg.left, F.col("n") - cfg.fft))
    hi = F.least(F.col("n"), F.greatest(F.col("tile") * step - cfg.left + reach, F.lit(cfg.fft)))
    a, b = F.greatest(lo, F.col("start")), F.least(hi, end)
    part = F.slice("samples", (a - F.col("start") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    out = out.withColumns({"part": part, "lo": lo}).where(F.size("part") > 0)
    whole = out.groupBy(*KEY, "sample_rate", "n", "frames", "tile", "lo").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda s: s["part"])).alias("samples"))
    p0 = F.col("tile") * frames_per_tile
    p1 = F.least(F.col("frames"), p0 + frames_per_tile)
    x = C.extend("samples", F.size("samples"), p0 * cfg.hop - cfg.left - F.col("lo"), (p1 - p0 - 1) * cfg.hop + cfg.fft, cfg.pad)
    return whole.select(*KEY, "sample_rate", "n", "tile", p0.alias("p0"), p1.alias("p1"), x.alias("samples"))


def seek(blocks: DataFrame, frame: int, count: int) -> DataFrame:
    """`count` samples from `frame` of each clip: blocks outside the range are filtered before they are cut."""
    end = F.col("start") + F.size("samples")
    lo, hi = F.greatest(F.lit(frame), F.col("start")), F.least(F.lit(frame + count), end)
    kept = blocks.where((F.col("start") < frame + count) & (end > frame))
    return kept.withColumns({"samples": F.slice("samples", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")), "start": lo})


def tile_signals(clips: DataFrame, cfg: StftConfig, frames_per_tile: int = 4096) -> DataFrame:
    """Runs of frames p0..p1 of each clip with all the samples they read, borders filled in.

    A short clip is one tile where it stands; the tiles of a long one are rows of
    their own, which a shuffle by (clip_id, tile) may spread.
    """
    check(frames_per_tile >= 1, "frames_per_tile is positive")
    frames = C.frame_count("n", cfg)
    out = clips.withColumn("frames", frames).where("frames > 0")
    out = out.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("frames") - 1) / frames_per_tile))))
    p0 = F.col("tile") * frames_per_tile
    p1 = F.least(F.col("frames"), p0 + frames_per_tile)
    samples = C.extend("samples", "n", p0 * cfg.hop - cfg.left, (p1 - p0 - 1) * cfg.hop + cfg.fft, cfg.pad)
    return out.withColumns({"p0": p0, "p1": p1, "samples": samples}).drop("frames")


def frame_signal(clips: DataFrame, length: int, hop: int, pad: str) -> DataFrame:
    """One row per centered frame: clip_id, channel, frame, x."""
    cfg = StftConfig(fft=length, hop=hop, pad=pad)
    frames = C.frame_count("n", cfg)
    out = clips.withColumn("frames", frames).where("frames > 0").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1)))
    return out.select(*KEY, "frame", C.extend("samples", "n", F.col("frame") * hop - cfg.left, F.lit(length).cast("bigint"), pad).alias("x"))


def times(frames: DataFrame, sample_rate: float, hop: int) -> DataFrame:
    """frames with t, the seconds at which each begins."""
    return frames.withColumn("t", C.frames_to_time("frame", sample_rate, hop))


def complete_frames(frames: DataFrame, n: Column | str, cfg: StftConfig, complete: bool = True) -> DataFrame:
    """The frames that read no padding; n: samples of the frame's clip."""
    inside = (F.col("frame") >= C.first_complete(cfg)) & (F.col("frame") < C.last_complete(n, cfg))
    return frames.where(inside if complete else ~inside)


def border_frames(frames: DataFrame, n: Column | str, cfg: StftConfig) -> DataFrame:
    """The frames that read padding."""
    return complete_frames(frames, n, cfg, False)


def rms(clips: DataFrame, length: int = 2048, hop: int = 512) -> DataFrame:
    rows = frame_signal(clips, length, hop, "zero")
    return rows.select(*KEY, "frame", F.sqrt(C.dot("x", F.col("x")) / length).alias("rms"))


def zero_crossing_rate(clips: DataFrame, length: int = 2048, hop: int = 512, threshold: float = 1e-10) -> DataFrame:
    rows = frame_signal(clips, length, hop, "edge")
    negative = F.transform("x", lambda v: v < -threshold)
    rows = rows.withColumn("x", negative)
    crossed = F.filter(F.zip_with(F.slice("x", 2, length), F.slice("x", 1, length - 1), lambda a, b: a != b), lambda c: c)
    return rows.select(*KEY, "frame", (F.size(crossed) / length).alias("zcr"))


def rms_of_spectrogram(spectra: DataFrame, length: int) -> DataFrame:
    """From magnitudes: each bin but the ends stands for two."""
    bins = length // 2 + 1
    w = np.full(bins, 2.0)
    w[0] = 1.0
    if length % 2 == 0:
        w[-1] = 1.0
    square = F.transform("s", lambda x: x * x)
    return spectra.select(*KEY, "frame", (F.sqrt(C.dot(square, w)) / length).alias("rms"))


def spectral_shape(spectra: DataFrame, freqs: np.ndarray, p: float = 2.0, roll: float = 0.85, amin: float = 1e-10) -> DataFrame:
    """centroid, bandwidth, rolloff and flatness of magnitude rows, each a fold over the row."""
    f = C.literal(freqs)
    sum_ = C.total(F.col("s"))
    out = spectra.withColumn("__t", F.when(sum_ < C.TINY, 1.0).otherwise(sum_))
    out = out.withColumn("centroid", C.dot("s", freqs) / F.col("__t"))
    spread = F.zip_with("s", f, lambda a, b: a / F.col("__t") * F.pow(F.abs(b - F.col("centroid")), F.lit(p)))
    running = F.aggregate(
        "s", F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("c")), lambda z, x: F.struct((z["a"] + x).alias("a"), F.concat(z["c"], F.array(z["a"] + x)).alias("c")), lambda z: z["c"]
    )
    out = out.withColumn("__c", running)
    reached = F.filter(F.zip_with("__c", f, lambda c, b: F.when(c >= roll * F.element_at("__c", -1), b)), lambda b: b.isNotNull())
    power = F.transform("s", lambda x: F.greatest(F.lit(amin), x * x))
    flat = F.exp(C.total(F.transform(power, F.ln)) / F.size("s")) / (C.total(power) / F.size("s"))
    return out.withColumns({"bandwidth": F.pow(C.total(spread), F.lit(1 / p)), "rolloff": F.element_at(reached, 1), "flatness": flat}).select(
        *KEY, "frame", "centroid", "bandwidth", "rolloff", "flatness"
    )


def contrast_bands(fft: int, sample_rate: float, n_bands: int = 6, f_min: float = 200.0, quantile: float = 0.02) -> list[tuple[int, int, int]]:
    """(first bin, last bin, values averaged) of each octave band."""
    f = np.arange(fft // 2 + 1) * sample_rate / fft
    edges = np.concatenate([[0.0], f_min * 2.0 ** np.arange(n_bands + 1)])
    check(edges[-2] < sample_rate / 2, "the bands go beyond half the sample rate")
    out = []
    for k in range(n_bands + 1):
        inside = np.flatnonzero((f >= edges[k]) & (f <= edges[k + 1]))
        check(len(inside) > 0, f"band {k} has no bin")
        lo, hi = int(inside[0]) - (k > 0), int(inside[-1])
        hi = len(f) - 1 if k == n_bands else hi
        wanted = max(1, int(np.rint(quantile * (hi - lo + 1))))
        hi -= k < n_bands
        check(hi >= lo, f"band {k} has no bin below its top edge")
        out.append((lo, hi, min(wanted, hi - lo + 1)))
    return out


def spectral_contrast(spectra: DataFrame, fft: int, sample_rate: float, n_bands: int = 6, f_min: float = 200.0, quantile: float = 0.02, linear: bool = False) -> DataFrame:
    """contrast: peak less valley of each band; in decibels both are floored 80 dB below their own clip's greatest."""
    peaks, valleys = [], []
    for lo, hi, take in contrast_bands(fft, sample_rate, n_bands, f_min, quantile):
        ordered = F.array_sort(F.slice("s", lo + 1, hi - lo + 1))
        valleys.append(C.total(F.slice(ordered, 1, take)) / take)
        peaks.append(C.total(F.slice(ordered, -take, take)) / take)
    out = spectra.withColumns({"peak": F.array(*peaks), "valley": F.array(*valleys)})
    if not linear:
        whole = Window.partitionBy(*KEY)
        for c in ("peak", "valley"):
            out = out.withColumn(c, F.transform(c, lambda x: C.power_to_db(x)))
            out = out.withColumn("__m", F.max(F.array_max(c)).over(whole) - 80).withColumn(c, F.transform(c, lambda x: F.greatest(x, F.col("__m"))))
    return out.select(*KEY, "frame", F.zip_with("peak", "valley", lambda a, b: a - b).alias("contrast"))


def clamp_db(df: DataFrame, column: str, top_db: float = 80.0, scope: str = "clip") -> DataFrame:
    """Array values floored at top_db below the greatest of their clip, or of the table.

    The maxima are aggregated, one row a clip, and joined back.
    """
    check(top_db >= 0, "top_db is not negative")
    check(scope in ("clip", "table"), f"unknown scope {scope}")
    keys = list(KEY) if scope == "clip" else []
    most = df.groupBy(*keys).agg((F.max(F.array_max(column)) - top_db).alias("__floor"))
    both = df.join(most, keys) if keys else df.join(F.broadcast(most))  # without keys: one row
    return both.withColumn(column, F.transform(column, lambda x: F.greatest(x, F.col("__floor")))).drop("__floor")


def power_to_db_of_maximum(spectra: DataFrame, column: str = "s", amin: float = 1e-10) -> DataFrame:
    """Decibels against the greatest power of the clip; amin where that is not positive or not finite."""
    most = spectra.groupBy(*KEY).agg(F.max(F.array_max(column)).alias("__m"))
    good = (F.col("__m") > 0) & (F.col("__m") < float("inf"))
    both = spectra.join(most, list(KEY)).withColumn("__r", 10 * F.log10(F.when(good, F.greatest(F.lit(amin), F.col("__m"))).otherwise(amin)))
    return both.withColumn(column, F.transform(column, lambda x: C.power_to_db(x, amin=amin) - F.col("__r"))).drop("__m", "__r")


def onset_flux(spectra_db: DataFrame, lag: int = 1) -> DataFrame:
    """Mean rise over the bins against the frame `lag` before; the first frames have none."""
    check(lag >= 1, "lag is positive")
    before = F.lag("s", lag).over(Window.partitionBy(*KEY).orderBy("frame"))
    rise = C.total(F.zip_with("s", before, lambda a, b: F.greatest(F.lit(0.0), a - b))) / F.size("s")
    return spectra_db.withColumn("__b", before).select(*KEY, "frame", F.when(F.col("__b").isNull(), 0.0).otherwise(rise).alias("flux"))


def onset_strength(mel_db: DataFrame, cfg: StftConfig, lag: int = 1) -> DataFrame:
    """Flux moved to the time of the attack: half a frame later if centered, zeros in front."""
    shift = cfg.fft // (2 * cfg.hop) if cfg.alignment == "centered" else 0
    rows = onset_flux(mel_db, lag)
    moved = F.lag("flux", shift, 0.0).over(Window.partitionBy(*KEY).orderBy("frame")) if shift else F.col("flux")
    return rows.select(*KEY, "frame", moved.alias("onset"))


def downmix(clips: DataFrame) -> DataFrame:
    """The mean of a clip's channels, added in channel order."""
    both = clips.groupBy("clip_id", "sample_rate", "n").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("c"))
    first = F.transform(F.get("c", F.lit(0))["samples"], lambda x: x * 0.0)
    mean = F.transform(F.aggregate("c", first, lambda a, c: F.zip_with(a, c["samples"], lambda x, y: x + y)), lambda x: x / F.size("c"))
    return both.select("clip_id", F.lit(0).alias("channel"), "sample_rate", "n", mean.alias("samples"))


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [*KEY, "frame"], "full")


def align_asof(a: DataFrame, hop_a: int, b: DataFrame, hop_b: int) -> DataFrame:
    """Each row of a with the last frame of b that begins at or before it: an equal join on the computed frame."""
    return a.withColumn("__f", F.floor(F.col("frame") * hop_a / hop_b)).join(b.withColumnRenamed("frame", "__f"), [*KEY, "__f"], "left").drop("__f")
