"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints are computed in one narrow pass. Equal ones are merged before any
comparison, so that copies never multiply. Two fingerprints within the radius r
agree on at least b - r of b blocks of bits; with b = r + 4 each choice of r
blocks to leave out gives a table keyed by the others, and linked fingerprints
meet in one of them. All that meet under a key differ in few free bits, so a
group is bounded by those bits (about two million for r = 2), whatever the data.

A group is compared bit-sliced: 64 members make a lane, held as 64 bit planes. A
pair (member, lane) updates 64 distances at once with a carry-save counter, plane
by plane, and is abandoned when all of them exceed the radius. A group hands on a
spanning forest of its links only.

Near duplicates by Jaccard similarity are found in the same way by wide fingerprints
(512 bits) of the sets of shingles. Their radius is too large for tables that miss
nothing, so many tables take a few bits each; the similarity is checked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table
from .components import connected_components
from .textbytes import mix

SEED = 42
#: Pairs of a member and a lane compared at a time.
PAIRS = 100_000
#: MinHash bands and values in each: two sets of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9993 at 0.8, 0.02 at 0.3.
BANDS, ROWS = 24, 6
#: Bits of each MinHash value that are kept for estimates of the similarity, as planes of 64-bit words.
PLANES = 4
#: 64-bit words of the wide fingerprints that near duplicates are found by; the first SENT of them are compared bit-sliced.
WORDS, SENT = 8, 2
#: Tables, and the bits of a wide fingerprint that key each: two sets of similarity 0.8 share a key with probability 0.999, of 0.9 nearly always.
TABLES, BITS = 88, 14
#: A pair is not checked where so many standard deviations more of its bits, or MinHash values, differ than those of just similar sets do (3e-6, 3e-5 of these).
BIT_DEVIATIONS, DEVIATIONS = 4.5, 4.0
#: Sets of fewer shingles differ in more bits than the angle between them says: up to FEW_APART of all.
FEW, FEW_APART = 9, 0.1875
#: Near documents under a key, the smallest, that a document is held against in the first round.
FIRSTS = 1
#: Groups of so many documents are compared pair by pair, larger ones bit-sliced.
SMALL = 16
#: How many times more it is held against in each further round.
GROWTH = 8
#: Rows of sets that are handed on at a time, and bytes of the sets, about.
SET_ROWS, SET_BYTES = 1_000, 4_000_000


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = np.array(hashes[lo : lo + 65536], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp) of every row; a text without words has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(fps.view(np.int64))], names=["i", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, fp bigint").withColumnRenamed("i", id_col)


def _lanes(fps: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes [bits, lanes] of fingerprints [rows, words], the valid members of each lane, its first row, and the first lane of each group."""
    count = (size + 63) // 64
    lane0 = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(lane0[-1]) - np.repeat(lane0[:-1], count)
    begin = np.repeat(first, count) + within * 64
    n = np.minimum(64, np.repeat(first + size, count) - begin)
    words = fps.shape[1]
    members = np.zeros((len(begin), 64, words), np.uint64)
    row = np.repeat(np.arange(len(begin)), n)
    col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    members[row, col] = fps[begin[row] + col]
    bits = np.unpackbits(members.view(np.uint8).reshape(len(begin), 64, 8 * words), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(64 * words, -1, 8).copy().view(np.uint64)[:, :, 0]
    valid = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    return planes, valid, begin, lane0


def _compare(query: np.ndarray, lane: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query fingerprint, lane): the pair numbers left and their masks of members within the radius.

    A counter of `width` bit words counts the differing planes of 64 members at
    once; `over` gathers those beyond the radius.
    """
    width = radius.bit_length() + 1
    alive, over, counter = np.arange(len(query)), ~valid[lane], np.zeros((width, len(query)), np.uint64)
    for b in range(len(planes)):
        carry = planes[b][lane[alive]] ^ (np.uint64(0) - ((query[alive, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
        for w in range(width):
            counter[w], carry = counter[w] ^ carry, counter[w] & carry
        over |= carry
        if b % 8 == 7:
            more = np.zeros_like(over)  # counters above the radius, compared from the highest bit
            equal = ~np.uint64(0) & ~more
            for w in reversed(range(width)):
                if radius >> w & 1:
                    equal = equal & counter[w]
                else:
                    more |= equal & counter[w]
                    equal = equal & ~counter[w]
            over |= more
            left = over != ~np.uint64(0)
            if not left.all():
                alive, over, counter = alive[left], over[left], counter[:, left]
                if not len(alive):
                    break
    return alive, ~over


def _forest(fps: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root of its group's tree) within sorted groups of fingerprints [rows, words]."""
    planes, valid, begin, lane0 = _lanes(fps, first, size)
    root = np.arange(len(fps))
    lanes_of = lane0[1:] - lane0[:-1]
    pairs = size * lanes_of  # of each group
    lo = 0
    while lo < len(first):  # small groups together, a large one alone and in parts
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(pairs[lo:]), PAIRS, "right")) + lo)
        group = np.repeat(np.arange(lo, hi), size[lo:hi])
        row = np.arange(len(group)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi]) + first[group]
        step = max(1, PAIRS // int(lanes_of[lo:hi].max()))
        for at in range(0, len(row), step):
            r, g = row[at : at + step], group[at : at + step]
            n = lanes_of[g]
            q = np.repeat(r, n)
            lane = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lane0[g], n)
            keep = begin[lane] <= q  # each pair once
            q, lane = q[keep], lane[keep]
            alive, mask = _compare(fps[q], lane, planes, valid, radius)
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            p, j = np.nonzero(bits)
            _union(root, q[alive[p]], begin[lane[alive[p]]] + j)
        lo = hi
    out = np.flatnonzero(root != np.arange(len(fps)))
    return out, root[out]


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b; every row's root is final afterwards."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root[:] = root[root]


def near_links(fps: DataFrame, radius: int, spare: int = 4) -> DataFrame:
    """Links (a, b) that join all distinct values of fp (bigint) within `radius` differing bits, as forests of groups."""
    blocks = radius + spare  # of which `spare` are the key of a table
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for out in combinations(range(blocks), radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks) if i not in out)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    rows = fps.select(F.col("fp").alias("node"), "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks])).alias("t", "key"))
    return links_of_groups(rows, ["fp"], radius)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, from rows sorted by the columns `by`, with the first row and the size of each group of more than one row."""
    held = None
    for part in chain(batches, [None]):
        if part is None:
            t = held
            if t is None:
                return
            stop = t.num_rows
        else:
            if not part.num_rows:
                continue
            t = pa.Table.from_batches([part])
            t = t if held is None else pa.concat_tables([held, t])
            same = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in by])
            stop = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            held = t.slice(stop)
        if not stop:
            continue
        t = t.slice(0, stop)
        keys = [t[c].to_numpy() for c in by]
        first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
        size = np.diff(np.concatenate([first, [stop]]))
        many = size > 1
        if many.any():
            yield t, first[many], size[many]


def links_of_groups(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Links (a, b) of nodes under the same (t, key) whose fingerprints, of the columns `words`, are within the radius: forests of groups, compared bit-sliced."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first, size in _whole_groups(batches, ["t", "key"]):
            node, fps = t["node"].to_numpy(), np.stack([t[w].to_numpy().view(np.uint64) for w in words], axis=1)
            a, b = _forest(fps, first, size, radius)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return rows.select("t", "key", "node", *(w for w in words)).repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(groups, "a bigint, b bigint")


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, spare: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) of every row; component_id: the smallest id that links lead to.

    Null and blank texts share the fingerprint 0 and are linked like any other;
    repeated rows stay; a row with a null id gets its group's smallest id, null
    if none of its group has one; an empty table gives no rows.
    """
    fps = materialize(simhash(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    nodes = connected_components(near_links(distinct.select("fp"), radius, spare))
    linked = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    linked = materialize(linked, "linked")
    least = materialize(linked.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    classes = materialize(linked.join(least, "component").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select(id_col, "fp", "component_id")


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's word shingles, lower-cased A-Z (fewer words: the whole sequence; none: empty)."""
    from .textbytes import NOT_SPACE, Hasher, chunks, spans

    for lo, hi, data, offsets in chunks(texts):
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, first = spans(low, offsets, NOT_SPACE)
        h = Hasher(low)(starts, ends)
        for i in range(hi - lo):
            own = h[first[i] : first[i + 1]]
            k = min(shingle, len(own))
            mixed = np.zeros(max(len(own) - k + 1, 0) if k else 0, np.uint64)
            for j in range(k):
                mixed = mix(mixed * np.uint64(31) + own[j : len(own) - k + 1 + j])
            yield np.unique(mixed)


def set_digest(own: np.ndarray) -> np.uint64:
    """Equal for equal sets."""
    return mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, text) to (id, digest, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids, digests, sets):
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.uint64()).view(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "digest", "set"])

        for b in batches:
            kind, ids, digests, sets = b.schema.field("id").type, [], [], []
            for i, own in zip(b.column("id").to_pylist(), _sets(b.column("text"), shingle), strict=True):
                ids.append(i)
                digests.append(int(set_digest(own)))
                sets.append(own.view(np.int64))
                if len(ids) >= SET_ROWS or 8 * sum(map(len, sets[-50:])) > SET_BYTES:
                    yield rows(ids, digests, sets)
                    ids, digests, sets = [], [], []
            yield rows(ids, digests, sets)

    return docs.select("id", "text").mapInArrow(run, T.StructType([docs.schema["id"], *T.StructType.fromDDL("digest bigint, set array<bigint>").fields]))


def minhash_bands(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text) to (id, digest, keys, planes, size): a key for each band of MinHash values of the shingle set; empty sets share one.

    planes: the low bits of all values, each bit in words of its own (see values_apart).
    """
    words = -(-bands * rows // 64)
    salts = np.random.default_rng(SEED).integers(0, 2**63, (2, bands * rows), dtype=np.uint64)
    turn, scale = salts[0][:, None], (salts[1] | np.uint64(1))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), []
            bits = np.zeros((b.num_rows, PLANES, 64 * words), np.uint8)
            for i, h in enumerate(_sets(b.column("text"), shingle)):
                digests[i], sizes[i] = set_digest(h), len(h)
                least = np.full(bands * rows, ~np.uint64(0))
                for lo in range(0, len(h), 256):
                    x = h[lo : lo + 256] ^ turn
                    x *= scale
                    np.minimum(least, x.min(axis=1), out=least)
                bits[i, :, : len(least)] = (mix(least) >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
                key = np.arange(1, bands + 1).astype(np.uint64) if len(h) else np.zeros(1, np.uint64)
                for column in (least.reshape(bands, rows).T if len(h) else ()):
                    key = mix(key * np.uint64(31) + column)
                keys.append(key)
            cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            planes = np.packbits(bits, axis=2, bitorder="little").reshape(-1).view(np.int64)
            starts = np.arange(b.num_rows + 1, dtype=np.int32) * PLANES * words
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for at, x in ((cut, flat), (starts, planes))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests.view(np.int64)), *lists, pa.array(sizes)], names=["id", "digest", "keys", "planes", "size"])

    return docs.select("id", "text").mapInArrow(run, T.StructType([docs.schema["id"], *T.StructType.fromDDL("digest bigint, keys array<bigint>, planes array<bigint>, size bigint").fields]))


def values_apart(a: Column, b: Column, values: int = BANDS * ROWS) -> Column:
    """How many of the MinHash values differ in their low bits, 64 at a time: the planes' differences are united and counted."""
    words = -(-values // 64)
    apart = [reduce(Column.bitwiseOR, (a[p * words + w].bitwiseXOR(b[p * words + w]) for p in range(PLANES))) for w in range(words)]
    return reduce(Column.__add__, map(F.bit_count, apart))


def most_apart(similarity: float, values: int = BANDS * ROWS) -> int:
    """The most values_apart of a pair that is checked: the mean of just similar sets and DEVIATIONS beyond it."""
    p = (1 - similarity) * (1 - 2.0**-PLANES)
    return math.ceil(values * p + DEVIATIONS * math.sqrt(values * p * (1 - p)))


def wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, text) to (id, digest, size, words): the SimHash of the set of shingles, in WORDS words; where as many hashes have a bit as not, that of a constant."""
    salts = np.random.default_rng(SEED).integers(0, 2**63, (2, WORDS), dtype=np.uint64)
    even = np.unpackbits(mix(salts[1].copy()).view(np.uint8), bitorder="little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, bits = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 64 * WORDS), np.uint8)
            for i, h in enumerate(_sets(b.column("text"), shingle)):
                digests[i], sizes[i], ones = set_digest(h), len(h), np.zeros(64 * WORDS, np.int64)
                for lo in range(0, len(h), 255):  # sums that fit a byte
                    hashes = mix(h[lo : lo + 255, None] ^ salts[0])
                    ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
                bits[i] = 2 * ones + even > len(h)
            words = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WORDS), pa.array(words))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests.view(np.int64)), pa.array(sizes), lists], names=["id", "digest", "size", "words"])

    return docs.select("id", "text").mapInArrow(run, T.StructType([docs.schema["id"], *T.StructType.fromDDL("digest bigint, size bigint, words array<bigint>").fields]))


def _taken() -> np.ndarray:
    """The bits of a wide fingerprint that each table takes."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(64 * WORDS, BITS, replace=False) for _ in range(TABLES)])


def fingerprint_keys(prints: DataFrame) -> DataFrame:
    """(node, words) to a row (t, key, node, w0, w1) for each table: key is the bits of the fingerprint that the table takes."""
    taken = _taken()
    kinds, names = [pa.int32(), pa.int32(), *[pa.int64()] * (1 + SENT)], ["t", "key", "node", *(f"w{i}" for i in range(SENT))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SET_ROWS):
                b = batch.slice(lo, SET_ROWS)
                words = b.column("words").flatten().to_numpy().reshape(-1, WORDS)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
                keys = (bits[:, taken].astype(np.int32) << np.arange(BITS, dtype=np.int32)).sum(axis=2, dtype=np.int32)
                columns = [np.tile(np.arange(TABLES), len(keys)), keys.ravel(), np.repeat(b.column("node").to_numpy(), TABLES), *(np.repeat(words[:, i], TABLES) for i in range(SENT))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return prints.select("node", "words").mapInArrow(run, "t int, key int, node bigint, " + ", ".join(f"w{i} bigint" for i in range(SENT)))


def bits_apart(a: Column, b: Column) -> Column:
    """How many bits of two wide fingerprints differ."""
    return reduce(Column.__add__, (F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(WORDS)))


def most_bits_apart(similarity: float, words: int = WORDS, few: bool = False) -> int:
    """The most differing bits of a pair that is checked: the mean of just similar sets, whose cosine is 2s / (1 + s) at least, and BIT_DEVIATIONS beyond it."""
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * words
    p = max(p, FEW_APART) if few else p
    return math.ceil(n * p + BIT_DEVIATIONS * math.sqrt(n * p * (1 - p)))


def _met_before(apart: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which pairs, of differing bits [pairs, words], share a key in a table before t, so that they meet there."""
    bits = np.zeros((TABLES, 64 * WORDS), np.uint8)
    np.put_along_axis(bits, _taken(), 1, axis=1)
    out, open_ = np.zeros(len(t), bool), np.arange(len(t))
    for i, mask in enumerate(np.packbits(bits, axis=1, bitorder="little").view(np.uint64)):
        open_ = open_[t[open_] > i]
        shared = ~(apart[open_] & mask).any(axis=1)
        out[open_[shared]] = True
        open_ = open_[~shared]
    return out


def _smallest_near(fps: np.ndarray, t: np.ndarray, sizes: np.ndarray, asks: np.ndarray, first: np.ndarray, size: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, earlier row of its group) of rows that ask and may be similar, of the first `most` of each, and the rows that may have more.

    A pair is given in the first table only in which it meets. Lanes are taken in the
    order of rows, so a member of a large group of near copies is held against as many
    lanes as it takes to find `most`.
    """
    usual, few = most_bits_apart(similarity), most_bits_apart(similarity, few=True)
    found, pairs, more = np.zeros(len(fps), np.int64), [], []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        less, greater = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])  # sets that differ more in size can't be similar
        apart = fps[a] ^ fps[b]
        near = (less >= similarity * greater) & (np.bitwise_count(apart).sum(axis=1) <= np.where(less < FEW, few, usual))
        a, b, apart = a[near], b[near], apart[near]
        early = found[a] + np.arange(len(a)) - np.searchsorted(a, a) < most
        here = ~_met_before(apart, t[a])
        pairs.append((a[early & here], b[early & here]))
        more.append(a[~early & here])
        np.add.at(found, a, 1)

    ask, _, rank = _asking(asks, first[size <= SMALL], size[size <= SMALL])
    for lo in range(0, len(ask), PAIRS // SMALL):
        n, begins = rank[lo : lo + PAIRS // SMALL], (ask - rank)[lo : lo + PAIRS // SMALL]
        take(np.repeat(ask[lo : lo + PAIRS // SMALL], n), np.arange(n.sum()) + np.repeat(begins - np.cumsum(n) + n, n))
    first, size = first[size > SMALL], size[size > SMALL]
    planes, valid, begin, lane0 = _lanes(fps, first, size)
    row, group, rank = _asking(asks, first, size)
    lane, end = lane0[group], lane0[group] + rank // 64 + (rank % 64 > 0)  # lanes that begin before the row
    while len(row):
        for lo in range(0, len(row), PAIRS):
            r, n = row[lo : lo + PAIRS], lane[lo : lo + PAIRS]
            alive, mask = _compare(fps[r], n, planes, valid, max(usual, few))
            p, j = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = r[alive[p]], begin[n[alive[p]]] + j
            take(a[b < a], b[b < a])
        lane = lane + 1
        goes_on, enough = lane < end, found[row] >= most
        more.append(row[enough & goes_on])
        row, lane, end = (x[goes_on & ~enough] for x in (row, lane, end))
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *(p[i] for p in pairs)]) for i in (0, 1)), np.unique(np.concatenate([none, *more]))


def _asking(asks: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of groups that ask, the group of each, and its place there."""
    group = np.repeat(np.arange(len(first)), size)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    row = first[group] + rank
    return row[asks[row]], group[asks[row]], rank[asks[row]]


def firsts_of_groups(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """Rows (t, key, id, size, words, asks) to (id, first): the smallest documents under its key that one that asks may be similar to, `most` at most.

    Where there may be more, a row (id, key) without first says so. A group is
    compared bit-sliced; it hands on `most` rows a member, however large it is.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first, size in _whole_groups(batches, ["key"]):
            fps = np.concatenate([c.flatten().to_numpy() for c in t["words"].chunks]).view(np.uint64).reshape(-1, WORDS)
            a, b, more = _smallest_near(fps, t["t"].to_numpy(), t["size"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False), first, size, similarity, most)
            ids = t["id"].combine_chunks()
            kind, n = ids.type, len(a)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.nulls(n, pa.int64())], names=["id", "first", "key"])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(more)), pa.nulls(len(more), kind), pa.array(t["key"].to_numpy()[more])], names=["id", "first", "key"])

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("first", kind), T.StructField("key", T.LongType())])
    return rows.select("t", "key", "id", "size", "words", "asks").repartition("key").sortWithinPartitions("key", "id").mapInArrow(groups, schema)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less near duplicates: in the order of ids, a document goes if a smaller one that stays is similar.

    Documents of equal shingle sets are merged first. Wide SimHash fingerprints of
    the sets are compared bit-sliced under the keys of many tables, at a radius
    chosen from the similarity; the links' connected components are the groups of
    candidates. Under its keys in a group each document is held against the smallest
    ones whose wide fingerprints say that they may be similar: FIRSTS of each key in
    the first round, so that a large group of copies falls to its smallest members,
    and GROWTH times as many in each further one, for the documents that are
    undecided and have more. Pairs are decided by the Jaccard similarity of the
    shingle sets. A document that was held against all such smaller ones of its keys
    and is like none that stays or is undecided stays; those like one that stays go.
    This is repeated until every document is decided; no two documents are held
    against each other twice.
    Rows of one id are one document (that of the smallest digest counts); rows with
    a null id stay; blank texts are alike; columns of any name are kept.
    """

    def texts_of(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    signs = wide_fingerprints(texts_of(docs.where(F.col(id_col).isNotNull())), shingle).groupBy("id").agg(F.min(F.struct("digest", "size", "words")).alias("own"))
    signs = materialize(signs.select("id", "own.*"), "signs")
    least = materialize(signs.groupBy("digest").agg(F.min("id").alias("first")), "first")
    gone = materialize(signs.join(least, "digest").where("id > first").select("id"), "copies")
    # from here on a digest is one document
    ones = materialize(signs.join(least, "digest").where("id = first").select("id", F.col("digest").alias("node"), "size", "words"), "ones")
    links = links_of_groups(fingerprint_keys(ones), [f"w{i}" for i in range(SENT)], most_bits_apart(similarity, SENT))
    linked = materialize(connected_components(links), "groups")
    linked = materialize(ones.join(linked, "node"), "linked")
    keys = fingerprint_keys(linked).select("node", F.struct("t", "key").alias("table"))
    left = keys.join(linked.select("node", "id", "size", "component"), "node").select("id", F.col("node").alias("digest"), "size", F.xxhash64("component", "table").alias("key"), "table.t")
    left = materialize(left, "keys")
    shared = materialize(left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    left = materialize(left.join(shared, "key"), "left")
    # merge joins with the texts: neither the plan nor a task's memory depends on how many documents are candidates
    members = materialize(left.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "members")
    sets = shingle_sets(texts_of(docs.join(members.select("__id").hint("merge"), F.col(id_col) == F.col("__id"), "left_semi")), shingle)
    sets = sets.join(members, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_semi").dropDuplicates(["id"])
    sets = materialize(sets.select("id", "set"), "sets")
    # the fingerprints go only to rows under shared keys
    left = materialize(left.select("id", "size", "key", "t").join(signs.select("id", "words").hint("merge"), "id"), "candidates")
    rest, asking, removed, m = members.select(F.col("__id").alias("id")), left.withColumn("asks", F.lit(True)), [gone], FIRSTS
    compared = likes = materialize(left.select("id", F.col("id").alias("first")).limit(0), "compared")  # pairs that met, and those alike of which both are undecided
    stayed = rest.limit(0)
    while not rest.isEmpty():
        firsts = materialize(firsts_of_groups(asking, similarity, m), "firsts")
        met = firsts.where("first IS NOT NULL").select("id", "first")
        met = materialize(met.join(compared, ["id", "first"], "left_anti"), "met")
        both = met.join(sets, "id").join(sets.select(F.col("id").alias("first"), F.col("set").alias("other")), "first")
        same = F.size(F.array_intersect("set", "other"))
        alike = both.where(same >= similarity * (F.size("set") + F.size("other") - same)).select("id", "first")
        alike = materialize(alike.unionByName(likes), "alike")
        # documents that were held against all smaller ones
        further = firsts.where("first IS NULL").select("id", "key")
        stay = rest.join(further.unionByName(alike.select("id", F.lit(0).cast("bigint").alias("key"))).select("id").distinct(), "id", "left_anti")
        stayed = materialize(stayed.unionByName(stay), "stayed")
        gone = materialize(alike.join(stayed.withColumnRenamed("id", "first"), "first").select("id").distinct(), "gone")
        removed.append(gone)
        rest = materialize(rest.join(gone.unionByName(stayed), "id", "left_anti"), "rest")
        # keys under which an undecided document may have more: those not gone meet again
        further = materialize(further.join(rest, "id", "left_semi"), "further")
        left = left.join(further.select("key").distinct(), "key", "left_semi").join(gone, "id", "left_anti")
        left = materialize(left, "left")
        asking, m = left.join(further.withColumn("asks", F.lit(True)), ["id", "key"], "left").withColumn("asks", F.col("asks").isNotNull()), GROWTH * m
        likes = materialize(alike.join(rest, "id", "left_semi").join(rest.withColumnRenamed("id", "first"), "first", "left_semi").select("id", "first"), "likes")
        compared = materialize(met.unionByName(compared).join(rest, "id", "left_semi"), "compared")
    every = removed[0]
    for g in removed[1:]:
        every = every.unionByName(g)
    every = materialize(every.distinct().withColumnRenamed("id", "__id"), "removed")
    return docs.join(every.hint("merge"), F.col(id_col) == F.col("__id"), "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    rows = near_duplicate_groups(table(spark, sf_dir, "documents"), 3, 2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
