"""WAV files to clips, or to blocks by byte ranges, and back; what can't be read becomes a reject row.

audio_info reads headers only. read_audio_blocks cuts each file into ranges that
any tasks read, so a long file is many rows and never whole in one task; it
can mix down and resample while reading. read_audio decodes a file whole in one task
(binaryFile reads up to 2 GB) and is for short ones. Ranged reads use the file systems
of Arrow: local paths and those it knows by scheme. Many short clips are packed: a file
a task, in which an index says where each clip's WAV file begins.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import check
from ..operators.transforms import resample_filter, resampled

#: Encoding to (format tag, bits).
ENCODINGS = {"pcm16": (1, 16), "pcm24": (1, 24), "pcm32": (1, 32), "float32": (3, 32), "float64": (3, 64)}
_NAMES = {v: k for k, v in ENCODINGS.items()}
_READ = (
    "path string, channel int, sample_rate int, n bigint, samples array<double>, encoding string, channels int,"
    " error struct<kind:string,expected:bigint,read:bigint>"
)
_ERROR = pa.struct([("kind", pa.string()), ("expected", pa.int64()), ("read", pa.int64())])


def format_of_path(path: Column) -> Column:
    """Container by extension, in any case; null where it is unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("wav", "wave"), "wav").when(ext.isin("aif", "aiff"), "aiff").when(ext.isin("flac", "ogg", "caf"), ext)


class Unreadable(Exception):
    """kind, and for truncated data the bytes expected and read."""


#: Bytes of a header that are read at once, and of each later chunk's head.
HEAD, NEXT = 512, 64
#: Factors of a change of rate beyond which a file is refused: the filter grows with them.
FACTOR = 1 << 16
#: Samples and rows of blocks that are handed on at a time.
HELD, HELD_ROWS = 1 << 16, 4096


def _header(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, int, str, int, int]:
    """(channels, sample rate, bytes a frame, encoding, first data byte, data bytes) of a file of `length` bytes.

    read(at, count) gives bytes of it, fewer at its end. Chunks are skipped by their
    sizes, so a few hundred bytes are read, wherever the data begin.
    """
    head = read(0, HEAD)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise Unreadable("unrecognized_format", None, None)
    at, form, long = 12, None, None
    while at + 8 <= length:
        data = head[at : at + NEXT] if at + NEXT <= len(head) else read(at, NEXT)
        name, size = data[:4], struct.unpack_from("<I", data, 4)[0]
        if name == b"ds64" and head[:4] == b"RF64" and size >= 16 and len(data) >= 24:
            long = struct.unpack_from("<Q", data, 16)[0]
        elif name == b"fmt ":
            if size < 16 or len(data) < 24:
                raise Unreadable("truncated", size, length - at - 8)
            tag, channels, rate, _, width, bits = struct.unpack_from("<HHIIHH", data, 8)
            if tag == 0xFFFE and size >= 26 and len(data) >= 34:  # extensible: the tag stands in the sub-format
                tag = struct.unpack_from("<H", data, 32)[0]
            if (tag, bits) not in _NAMES or not channels or not rate or width != channels * bits // 8:
                raise Unreadable("unsupported", None, None)
            form = channels, rate, width, _NAMES[tag, bits]
        elif name == b"data":
            if form is None:
                raise Unreadable("unrecognized_format", None, None)
            size, first = long if long is not None and size == 0xFFFFFFFF else size, at + 8
            if first + size > length or size % form[2]:
                raise Unreadable("truncated", size, min(size, length - first))
            return *form, first, size
        at += 8 + size + size % 2
    raise Unreadable("truncated", at, length)


def _samples(data: bytes, encoding: str) -> np.ndarray:
    if encoding == "pcm24":
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    if encoding.startswith("float"):
        return np.frombuffer(data, "<f4" if encoding == "float32" else "<f8").astype(float)
    bits = ENCODINGS[encoding][1]
    return np.frombuffer(data, f"<i{bits // 8}") / float(1 << (bits - 1))


def _bytes(x: np.ndarray, encoding: str) -> bytes:
    tag, bits = ENCODINGS[encoding]
    if tag == 3:
        return x.astype(f"<f{bits // 8}").tobytes()
    scale = float(1 << (bits - 1))
    whole = np.clip(np.rint(np.nan_to_num(x) * scale), -scale, scale - 1).astype("<i8")  # saturates
    return whole.view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _opened(path: str) -> pa.NativeFile:
    """A path as Spark lists it, for ranged reads."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@=&?+,;!$'()*~"))
    return store.open_input_file(inside)


class _Last:
    """Opens files for ranged reads and keeps the last one, for the rows that follow."""

    def __init__(self):
        self.path = self.file = None

    def __call__(self, path: str) -> pa.NativeFile:
        if path != self.path:
            self.close()
            self.file, self.path = _opened(path), path
        return self.file

    def close(self) -> None:
        if self.path is not None:
            self.file.close()
        self.path = self.file = None


def _factors(rate: int, target: int) -> int:
    return max(rate, target) // int(np.gcd(rate, target))


def audio_info_of(paths: DataFrame, sample_rate: int | None = None) -> DataFrame:
    """Header facts of each file named in column path: n, sample_rate, channels, encoding, width, first (data byte), error.

    Some hundred bytes of a file are read. error.kind: not_found, permission_denied,
    io, unrecognized_format, unsupported, truncated; a null path is not found. Where the
    file is to be read at `sample_rate`, a rate that no filter is made for is unsupported.
    Rows of write_packed's index (clip_id, path, at, bytes) keep their clip_id and name a
    part of a file each.
    """
    packed = "at" in paths.columns
    fields = {"path": pa.string(), "n": pa.int64(), "sample_rate": pa.int64(), "channels": pa.int32(), "encoding": pa.string(), "width": pa.int32(), "first": pa.int64(), "error": _ERROR}

    def of(opened: _Last, path: str | None, begin: int = 0, length: int | None = None) -> tuple:
        try:
            if path is None:
                raise FileNotFoundError
            f = opened(path)
            length = f.size() if length is None else length

            def read(at: int, count: int) -> bytes:
                f.seek(begin + at)
                return f.read(min(count, max(0, length - at)))

            channels, rate, width, encoding, first, size = _header(read, length)
            if sample_rate and _factors(rate, sample_rate) > FACTOR:
                raise Unreadable("unsupported", None, None)
            return path, size // width, rate, channels, encoding, width, begin + first, None
        except Unreadable as e:
            error = e.args
        except FileNotFoundError:
            error = "not_found", None, None
        except PermissionError:
            error = "permission_denied", None, None
        except OSError:
            error = "io", None, None
        return path, None, None, None, None, None, None, dict(zip(("kind", "expected", "read"), error, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Last()
        for b in batches:
            at = [b.column(c).to_pylist() for c in ("path", "at", "bytes") if c in b.schema.names]
            rows = [of(opened, *r) for r in zip(*at, strict=True)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(fields.values())]
            if packed:
                yield pa.RecordBatch.from_arrays([b.column("clip_id"), *columns], names=["clip_id", *fields])
            else:
                opened.close()
                yield pa.RecordBatch.from_arrays(columns, names=list(fields))
        opened.close()

    ddl = "path string, n bigint, sample_rate bigint, channels int, encoding string, width int, first bigint, error struct<kind:string,expected:bigint,read:bigint>"
    if packed:
        return paths.select("clip_id", "path", "at", "bytes").mapInArrow(run, f"clip_id {dict(paths.dtypes)['clip_id']}, {ddl}")
    return paths.select("path").mapInArrow(run, ddl)


def audio_info(spark: SparkSession, path: str, sample_rate: int | None = None) -> DataFrame:
    """audio_info_of every file below path, as Spark lists them: without reading contents, and without empty files."""
    return audio_info_of(_files(spark, path).select("path"), sample_rate)


def audio_ranges(info: DataFrame, block: int = 65536, blocks: int = 16, sample_rate: int | None = None) -> DataFrame:
    """info with a row for each run of up to `blocks` blocks of a readable file: start, end (at sample_rate, where given) and n alike.

    Rows filtered out here are never read.
    """
    check(block >= 1 and blocks >= 1 and (sample_rate is None or sample_rate >= 1), "block, blocks and sample_rate are positive")
    m = F.expr(f"(n * {sample_rate} + sample_rate - 1) div sample_rate") if sample_rate else F.col("n")
    rows = info.where("error is null").withColumn("m", m).where("m > 0")
    run = block * blocks
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(run).cast("bigint")))
    return rows.withColumn("start", start).withColumn("end", F.least(F.col("m"), F.col("start") + run))


@lru_cache(maxsize=4)
def _filter(rate: int, target: int, quality: str):
    return resample_filter(rate, target, quality)


def read_ranges(ranges: DataFrame, block: int = 65536, sample_rate: int | None = None, mono: bool = False, quality: str = "high", tasks: int | None = None) -> DataFrame:
    """Blocks (clip_id, channel, sample_rate, n, block, start, samples) of audio_ranges' rows, as to_blocks gives them for whole clips.

    mono: the mean of the channels, added in their order, before any change of rate.
    sample_rate: blocks at that rate; each reads the bytes that its filter reaches, so
    the native signal is never put together. Ranges are dealt to `tasks` tasks (by
    default spark.sql.shuffle.partitions); a task holds one block of all channels, or
    some short ones up to HELD samples. A file that fails after its header was read
    fails the task, which Spark repeats. clip_id is the path where ranges have none.
    """
    spark = ranges.sparkSession
    ranges = ranges if "clip_id" in ranges.columns else ranges.withColumn("clip_id", F.col("path"))
    kind = ranges.schema["clip_id"].dataType
    names = ["clip_id", "channel", "sample_rate", "n", "block", "start", "samples"]

    def decoded(f, r: dict, lo: int, hi: int) -> np.ndarray:
        """Frames lo to hi as [channels, frames], silence outside the file."""
        a, b = max(0, min(lo, r["n"])), max(0, min(hi, r["n"]))
        f.seek(r["first"] + a * r["width"])
        data = f.read((b - a) * r["width"])
        if len(data) != (b - a) * r["width"]:
            raise OSError(f"{r['path']} became shorter while it was read")
        x = _samples(data, r["encoding"]).reshape(-1, r["channels"]).T
        if mono:
            x = (sum(x[1:], x[0].copy()) * (1 / len(x)))[None]
        return np.pad(x, ((0, 0), (a - lo, hi - b))) if a > lo or hi > b else x

    kinds = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, rows, held = _Last(), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                rate, f = sample_rate or r["sample_rate"], opened(r["path"])
                for start in range(r["start"], r["end"], block):
                    count = min(block, r["end"] - start)
                    if rate == r["sample_rate"]:
                        x = decoded(f, r, start, start + count)
                    else:
                        up, down, reach, h = _filter(r["sample_rate"], rate, quality)
                        lo, hi = start * down // up - reach, (start + count - 1) * down // up + reach + 1
                        x = [resampled(c, lo, start, count, up, down, reach, h) for c in decoded(f, r, lo, hi)]
                    rows += [(r["clip_id"], k, rate, r["m"], start // block, start, v) for k, v in enumerate(x)]
                    held += len(x) * count
                    if held >= HELD or len(rows) >= HELD_ROWS:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)
        opened.close()

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranges.select("clip_id", "path", "n", "m", "sample_rate", "channels", "encoding", "width", "first", "start", "end").repartition(tasks, "path", "first", "start")
    rows = rows.sortWithinPartitions("path", "first", "start")  # a file is opened once a task
    return rows.mapInArrow(run, f"clip_id {kind.simpleString()}, channel int, sample_rate int, n bigint, block bigint, start bigint, samples array<double>")


def read_audio_blocks(
    spark: SparkSession, path: str, block: int = 65536, sample_rate: int | None = None, mono: bool = False, quality: str = "high", tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejects) of every file below path; a file without samples gives no block. Headers are read for each of the two."""
    info = audio_info(spark, path, sample_rate)
    blocks = read_ranges(audio_ranges(info, block, sample_rate=sample_rate), block, sample_rate, mono, quality, tasks)
    return blocks, info.where("error is not null").select("path", "error.*")


def read_audio_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row per file and channel, or one with an error (unrecognized_format, unsupported, truncated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "channel", "sample_rate", "n", "samples", "encoding", "channels", "error"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.int32(), _ERROR]
        for b in batches:
            for i in range(b.num_rows):
                where, data, rows = b.column("path")[i].as_py(), b.column("content")[i].as_py(), []
                try:
                    channels, rate, _, encoding, first, size = _header(lambda at, n, data=data: data[at : at + n], len(data))
                    x = _samples(data[first : first + size], encoding).reshape(-1, channels)
                    rows = [(where, c, rate, len(x), x[:, c], encoding, channels, None) for c in range(channels)]
                except Unreadable as e:
                    rows = [(where, None, None, None, None, None, None, dict(zip(("kind", "expected", "read"), e.args, strict=True)))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).select("path", "content").mapInArrow(run, _READ)


def read_audio(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clips, rejects): clips carry the path as clip_id; samples are never filled in where data are missing.

    The two tables are two filters over one decoding; materialize
    read_audio_rows first where both are used at scale.
    """
    rows = read_audio_rows(spark, path)
    clips = rows.where("error is null").select(F.col("path").alias("clip_id"), "channel", "sample_rate", "n", "samples")
    return clips, rows.where("error is not null").select("path", "error.*")


def write_audio(clips: DataFrame, path: str, encoding: str = "pcm16") -> DataFrame:
    """One WAV file a clip, named <clip_id>.wav under path; returns clip_id, path, bytes once acted upon.

    A file is written under another name and then moved, so that a task may run
    twice. Channels are interleaved in order; PCM saturates.
    """
    check(encoding in ENCODINGS, f"unknown encoding {encoding}")
    rows, root = _by_clip(clips), _root(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        for b in batches:
            made, sizes = [], []
            for i in range(b.num_rows):
                head, data = _image(b, i, encoding)
                name = f"{folder}/{b.column('clip_id')[i].as_py()}.wav"
                draft = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(head)
                    out.write(data)
                store.move(draft, name)
                made.append(name)
                sizes.append(len(head) + len(data))
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), pa.array(made, pa.string()), pa.array(sizes, pa.int64())], names=["clip_id", "path", "bytes"])

    return rows.mapInArrow(run, f"clip_id {dict(clips.dtypes)['clip_id']}, path string, bytes bigint")


def write_packed(clips: DataFrame, path: str, encoding: str = "pcm16") -> DataFrame:
    """The WAV files of many clips, one behind the other in a file a task; returns their index: clip_id, path, at, bytes, once acted upon.

    Files have new names, so a task that runs twice leaves one that no index names;
    write the index before it is used. audio_info_of takes it.
    """
    check(encoding in ENCODINGS, f"unknown encoding {encoding}")
    rows, root = _by_clip(clips), _root(path)
    scheme = root.partition("://")[0] if "://" in path else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.wavs", 0, None
        named = f"{path.rstrip('/')}/{name}" if scheme else f"{folder}/{name}"
        for b in batches:
            out = out or store.open_output_stream(f"{folder}/{name}")
            places, sizes = [], []
            for i in range(b.num_rows):
                head, data = _image(b, i, encoding)
                out.write(head + data)
                places.append(at)
                sizes.append(len(head) + len(data))
                at += sizes[-1]
            columns = [b.column("clip_id"), pa.array([named] * b.num_rows, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["clip_id", "path", "at", "bytes"])
        if out:
            out.close()

    return rows.mapInArrow(run, f"clip_id {dict(clips.dtypes)['clip_id']}, path string, at bigint, bytes bigint")


def _by_clip(clips: DataFrame) -> DataFrame:
    """(clip_id, sample_rate, x): the samples of each channel, in order."""
    both = clips.groupBy("clip_id", "sample_rate").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("c"))
    return both.select("clip_id", "sample_rate", F.transform("c", lambda c: c["samples"]).alias("x"))


def _root(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"


def _image(b: pa.RecordBatch, i: int, encoding: str) -> tuple[bytes, bytes]:
    """Header and data of row i of _by_clip."""
    tag, bits = ENCODINGS[encoding]
    x = np.stack([c.values.to_numpy() for c in b.column("x")[i]], axis=1)
    rate, width = b.column("sample_rate")[i].as_py(), x.shape[1] * bits // 8
    data = _bytes(np.ascontiguousarray(x).ravel(), encoding)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, tag, x.shape[1], rate, rate * width, width, bits, b"data", len(data)), data
