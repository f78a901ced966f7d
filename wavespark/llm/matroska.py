"""Matroska (EBML) media columns: payloads to files, files to packet tables.

Files are binary columns, muxed and parsed row by row in Arrow batches without any
shuffle. The parser reads variable-length element ids and sizes (unknown sizes
too), clusters, simple blocks and block groups, all four lacings and cues; each
packet has its track, timestamp, and byte range in the file. Damaged and hostile
files give the packets before the damage and an error text: nesting is bounded, and
numbers that do not fit a long are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Element ids of the format.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, TRACKS, TRACK = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, TRACKS, TRACK, INFO, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}

FRAME, SAMPLE_RATE = 192, 8000
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 16
_FRAME_MS = FRAME * 1000 // SAMPLE_RATE


def _size(n: int) -> bytes:
    """A variable-length size of the least width; the value of all ones is kept for unknown."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block after its header: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return frames[0]
    out = bytes([len(frames) - 1])
    if lacing == 1:
        out += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        out += _size(len(frames[0]))
        for a, b in zip(frames[:-2], frames[1:-1], strict=True):  # signed differences, around the middle of the width's range
            d = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return out + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A one-track file of 8-bit samples; blocks of eight frames take fixed and EBML lacing in turn."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    audio = element(AUDIO, element(RATE, np.float32(SAMPLE_RATE).astype(">f4").tobytes()) + element(CHANNELS, 1) + element(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(DURATION, _FRAME_MS * 1_000_000) + audio))
    body, cues = [element(INFO, element(SCALE, 1_000_000)), tracks], []
    at = sum(map(len, body))
    block_bytes = FRAME * FRAMES_PER_BLOCK
    for c in range(0, len(payload), block_bytes * BLOCKS_PER_CLUSTER):
        start = c // FRAME * _FRAME_MS
        parts = [element(TIME, start)]
        for b in range(c, min(c + block_bytes * BLOCKS_PER_CLUSTER, len(payload)), block_bytes):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + block_bytes, len(payload)), FRAME)]
            lacing = 0 if len(frames) == 1 else 2 + (b // block_bytes) % 2
            relative = b // FRAME * _FRAME_MS - start
            parts.append(element(SIMPLE, b"\x81" + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing_bits(lacing)]) + lace(frames, lacing)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, element(CUE_TIME, start) + element(CUE_AT, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def lacing_bits(lacing: int) -> int:
    return {0: 0, 1: 0x02, 2: 0x04, 3: 0x06}[lacing]


#: Levels of elements inside each other that are followed; the format needs five.
DEPTH_LIMIT = 16


def _whole(data: bytes, at: int, stop: int) -> int:
    """An unsigned number of an element's body."""
    value = int.from_bytes(data[at:stop], "big") if stop - at <= 8 else 1 << 63
    if value >= 1 << 62:
        raise ValueError(f"number beyond a long at byte {at}")
    return value


def _number(data: bytes, at: int, end: int, keep: bool) -> tuple[int | None, int, int]:
    """A variable-length number: value (None: unknown size), the place after it, its width."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width, width
    value ^= 1 << 7 * width
    return (None if value == (1 << 7 * width) - 1 else value), at + width, width


def _block(data: bytes, at: int, end: int, state: dict, key: bool | None, out: list) -> None:
    """Adds a block's frames; those after the first follow by the track's frame duration, where it has one."""
    track, at, _ = _number(data, at, end, False)
    if at + 3 > end:
        raise ValueError(f"cut block at byte {at}")
    time, flags = state["cluster"] + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at, lacing = at + 3, flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    if lacing == 0:
        sizes = [end - at]
    else:
        count, at = data[at] + 1, at + 1
        if lacing == 2:
            if (end - at) % count:
                raise ValueError(f"uneven fixed lacing at byte {at}")
            sizes = [(end - at) // count] * count
        else:
            sizes = []
            for i in range(count - 1):
                if lacing == 1:
                    n = 0
                    while data[at] == 255:
                        n, at = n + 255, at + 1
                    n, at = n + data[at], at + 1
                else:
                    n, at, width = _number(data, at, end, False)
                    if i:
                        n = sizes[-1] + n - ((1 << 7 * width - 1) - 1)
                sizes.append(n)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError(f"lacing beyond the block at byte {at}")
    step = state["durations"].get(track, 0)
    for i, n in enumerate(sizes):
        moved = time + i * step // state["scale"]
        if moved >= 1 << 63:
            raise ValueError(f"timestamp beyond a long at byte {at}")
        out.append((track, moved, at, n, key))
        at += n


def parse(data: bytes) -> tuple[list[tuple], list[tuple], int, str | None]:
    """Packets (track, timestamp, offset, size, key), cues (time, track, cluster offset in the file), clusters, error."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    state = {"cluster": 0, "clusters": 0, "segment": 0, "time": 0, "track": 0, "number": 0, "scale": 1_000_000, "durations": {}}

    def walk(at: int, end: int, parent: int, depth: int) -> int:
        if depth > DEPTH_LIMIT:
            raise ValueError(f"more than {DEPTH_LIMIT} levels at byte {at}")
        block = None
        key = True
        while at < end:
            here = at
            kind, at, _ = _number(data, at, end, True)
            if parent == CLUSTER and kind in (CLUSTER, CUES):
                return here  # ends a cluster of unknown size
            size, at, _ = _number(data, at, end, False)
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"element at byte {here} goes beyond its parent")
            if kind == CLUSTER:
                state["clusters"] += 1
            if kind == SEGMENT:
                state["segment"] = at
            if kind in _MASTERS:
                stop = walk(at, stop, kind, depth + 1)
            elif kind == TIME:
                state["cluster"] = _whole(data, at, stop)
            elif kind == SIMPLE:
                _block(data, at, stop, state, None, packets)
            elif kind == BLOCK:
                block = (at, stop)
            elif kind == REFERENCE:
                key = False
            elif kind == SCALE:
                state["scale"] = max(1, _whole(data, at, stop))
            elif kind == NUMBER and parent == TRACK:
                state["number"] = _whole(data, at, stop)
            elif kind == DURATION:
                state["durations"][state["number"]] = _whole(data, at, stop)
            elif kind == CUE_TIME:
                state["time"] = _whole(data, at, stop)
            elif kind == CUE_TRACK:
                state["track"] = _whole(data, at, stop)
            elif kind == CUE_CLUSTER:
                cues.append((state["time"], state["track"], state["segment"] + _whole(data, at, stop)))
            at = stop
        if block:
            _block(data, *block, state, key, packets)
        return at

    try:
        if data[:4] != EBML.to_bytes(4, "big"):
            raise ValueError("no EBML header")
        walk(0, len(data), 0, 0)
    except (ValueError, IndexError) as e:
        return packets, cues, state["clusters"], str(e) or "cut file"
    return packets, cues, state["clusters"], None


PACKET = "array<struct<track:bigint,timestamp:bigint,offset:bigint,size:bigint,key:boolean>>"
_PACKET = pa.list_(pa.struct([("track", pa.int64()), ("timestamp", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key", pa.bool_())]))
_CUE = pa.list_(pa.struct([("timestamp", pa.int64()), ("track", pa.int64()), ("offset", pa.int64())]))


#: Rows that go through the steps together: files, packets and samples of no more are held at once.
ROWS = 256


def _steps(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """df with the columns of each step (DDL of its columns, function of a batch that returns their arrays), in one pass."""
    fields = [T.StructType.fromDDL(ddl).fields for ddl, _ in steps]
    df = df.drop(*(f.name for own in fields for f in own))
    functions, names = [f for _, f in steps], [[f.name for f in own] for own in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                for of, own in zip(functions, names, strict=True):
                    part = pa.RecordBatch.from_arrays([*part.columns, *of(part)], names=[*part.schema.names, *own])
                yield part

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(f for own in fields for f in own)]))


def _mux_step(payload: str, to: str) -> tuple:
    return f"{to} binary", lambda b: [pa.array([None if x is None else mux(x) for x in b.column(payload).to_pylist()], pa.binary())]


def _packet_step(media: str) -> tuple:
    def of(b: pa.RecordBatch) -> list:
        found = [parse(x or b"") for x in b.column(media).to_pylist()]
        packets = pa.array([[dict(zip(("track", "timestamp", "offset", "size", "key"), p, strict=True)) for p in f[0]] for f in found], _PACKET)
        cues = pa.array([[dict(zip(("timestamp", "track", "offset"), c, strict=True)) for c in f[1]] for f in found], _CUE)
        return [packets, cues, pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.string())]

    return f"packets {PACKET}, cues array<struct<timestamp:bigint,track:bigint,offset:bigint>>, clusters bigint, error string", of


def _read_step(media: str, track: int) -> tuple:
    def of(b: pa.RecordBatch) -> list:
        packets = b.column("packets")
        flat, ends = packets.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in packets])])
        kind, time, at, n = (flat.field(c).to_numpy() for c in ("track", "timestamp", "offset", "size"))
        out = []
        for i, data in enumerate(b.column(media).to_pylist()):
            own = np.arange(ends[i], ends[i + 1])
            own = own[kind[own] == track]
            own = own[np.argsort(time[own], kind="stable")]
            out.append(b"".join([data[s : s + k] for s, k in zip(at[own].tolist(), n[own].tolist(), strict=True)]))
        return [pa.array(out, pa.binary())]

    return "samples binary", of


def mux_column(df: DataFrame, payload: str, to: str = "media") -> DataFrame:
    """df with a file for each payload (binary); a null payload gives null."""
    return _steps(df, [_mux_step(payload, to)])


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """df with packets, cues, clusters and error of each file; null and empty files give no packets and an error."""
    return _steps(df, [_packet_step(media)])


def read_track(df: DataFrame, media: str = "media", track: int = 1) -> DataFrame:
    """df (with packets) and samples: the bytes of a track's packets, in order of their timestamps."""
    return _steps(df, [_read_step(media, track)])


def store_and_read(df: DataFrame, payload: str, track: int = 1) -> DataFrame:
    """mux_column, packet_table and read_track in one pass, and a feature of the samples.

    A null payload gives no file, an error, and empty samples; repeated rows are
    stored each; an empty table gives no rows; columns of df that have the names of
    results are replaced, any other is kept.
    """
    feature = "feature string", lambda b: [pa.array([_features(x) for x in b.column("samples").to_pylist()], pa.string())]
    return _steps(df, [_mux_step(payload, "media"), _packet_step("media"), _read_step("media", track), feature])


def _features(samples: bytes) -> str:
    """Mean, mean square, crossings of 128, least and greatest sample: whole numbers, so equal on any machine."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = max(len(x), 1)
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    return f"mean={int(x.sum()) * 1000 // n},power={int((x * x).sum()) // n},crossings={crossings},low={x.min() if len(x) else 0},high={x.max() if len(x) else 0}"


def op8_matroska(spark, sf_dir: str) -> DataFrame:
    """Every document as a file of 8-bit samples, read back through its packet table."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("raw"))
    n = F.octet_length("raw").cast("bigint")
    padded = F.greatest(F.ceil(n / 192), F.lit(1)) * 192
    docs = docs.select("doc_id", n.alias("n_bytes"), F.rpad("raw", padded.cast("int"), F.lit(b" ")).alias("payload"))
    return store_and_read(docs, "payload").select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("bigint").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", F.size("packets").cast("bigint").alias("n_packets"),
    )
