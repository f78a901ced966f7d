"""Repeated word windows by prefix-partitioned suffix trees.

A suffix is a place in a document from which at least `window` words follow. The
tree is only needed down to that depth: suffixes that share their first `window`
words hang under one deep internal node, whose word sequence is a repeat. Paths are
known by fingerprints of their first words: two short prefixes, and the whole
window by 128 bits.

1. A suffix can only share a deep node with one of another document if the two
   have the same anchor: the least fingerprint among the window's ANCHOR-word grams.
   An aggregate with map-side combine finds the anchors of several documents; no
   other suffix is ever moved.
2. Inside a batch all but the suffixes of a node's smallest document are decided at
   once, so a passage of any frequency sends at most one document's a batch.
3. The rest are split by prefixes of variable length. A prefix of PREFIXES[0] words
   with no more than GROUP suffixes is a subtree of one task; those of a larger
   group are split by their first PREFIXES[1] words, and where that still holds too
   many, each path of full depth is a subtree of its own. A task walks its sorted
   subtrees and marks the suffixes under deep nodes that a smaller document is under
   too. A path of full depth is one node: the smallest document under it is an
   aggregate with map-side combine, joined back, so no node has to fit a task.
4. Marked places return to their document, which drops the words they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table
from .textbytes import NOT_SPACE, Hasher, chunks, mix, powers, spans

WINDOW, ANCHOR = 50, 16
#: Words of the two prefixes; suffixes of a prefix above which it is split further.
PREFIXES = (8, 24)
GROUP = 2_000
#: Suffixes of a batch that are held at once, about.
HELD = 500_000
#: Shared anchors that are sent to all tasks at most (8 bytes each); beyond, each document gets its own by a join.
SENT = 1 << 22
#: Ids of exact copies, or prefixes to be split, that are broadcast at most.
BROADCAST = 1_000_000
_B = 0xD6E8FEB86659FD93
_B_INVERSE = pow(_B, -1, 2**64)


def _sums(h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_B, len(h)), dtype=np.uint64)])


def _labels(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    sums = _sums(h)
    return mix((sums[k:] - sums[:-k]) * powers(_B_INVERSE, len(h) + 1)[: len(sums) - k] + np.uint64(k))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _windows(texts: pa.Array, window: int, anchor: int) -> Iterator[tuple]:
    """For a chunk: first row, and for each window its row (in the chunk), place and anchor; then all word hashes and the windows' first words."""
    for lo, _, data, offsets in chunks(texts):
        starts, ends, first = spans(data, offsets, NOT_SPACE)
        h = Hasher(data)(starts, ends)
        n = len(h)
        if n < window:
            continue
        least = _least(_labels(h, anchor), window - anchor + 1)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = row[: n - window + 1] == row[window - 1 :]  # all words in one document
        at = np.flatnonzero(whole)
        if len(at):
            yield lo, row[at], at - first[row[at]], least[at].view(np.int64), h, at


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = b.column("doc").to_numpy(), b.column("tag").to_numpy()
            for lo, row, _, least, _, _ in _windows(b.column("text"), window, anchor):
                change = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (least[1:] != least[:-1])])[: len(row)])
                once = np.unique(np.stack([least[change], row[change]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(doc[lo + once[1]]), pa.array(tag[lo + once[1]])], names=["anchor", "doc", "tag"])

    return docs.select("doc", "tag", "text").mapInArrow(run, "anchor bigint, doc bigint, tag bigint")


_SUFFIX = "short bigint, long bigint, label bigint, check bigint, doc bigint, tag bigint, place int"


def _suffixes(docs: DataFrame, window: int, anchor: int, prefixes: tuple[int, int], sent: int) -> DataFrame:
    """_SUFFIX and done: the suffixes under anchors of several documents; those that a smaller document of their batch repeats are done."""
    spark = docs.sparkSession
    shared = _anchors(docs, window, anchor).groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = materialize(shared.where("lo < hi").select("anchor"), "anchors")
    if shared.count() <= sent:
        own = spark.sparkContext.broadcast(np.sort(shared.toArrow()["anchor"].to_numpy()))
        rows = docs.withColumn("hits", F.lit(None).cast("array<bigint>"))
    else:
        own = spark.sparkContext.broadcast(None)
        hits = _anchors(docs, window, anchor).join(shared, "anchor").groupBy("doc", "tag").agg(F.collect_set("anchor").alias("hits"))
        rows = docs.join(materialize(hits, "hits"), ["doc", "tag"])

    def kept(least: np.ndarray, row: np.ndarray, lo: int, hits: pa.Array) -> np.ndarray:
        known = own.value
        if known is not None:
            at = np.minimum(np.searchsorted(known, least), max(len(known) - 1, 0))
            return np.flatnonzero(known[at] == least) if len(known) else np.zeros(0, int)
        keep, edge = np.zeros(len(row), bool), np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            keep[s:e] = np.isin(least[s:e], hits[lo + int(row[s])].values.to_numpy())
        return np.flatnonzero(keep)

    def decided(parts: list[tuple]) -> pa.RecordBatch:
        short, long, label, check, d, t, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, check, label))
        new = np.concatenate([[True], (label[order][1:] != label[order][:-1]) | (check[order][1:] != check[order][:-1])])
        done = np.zeros(len(d), bool)
        done[order] = d[order] > d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        columns = [pa.array(x, mask=done) for x in (short, long, label, check)]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, (d, t, place, done))], names=["short", "long", "label", "check", "doc", "tag", "place", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag, parts, held = b.column("doc").to_numpy(), b.column("tag").to_numpy(), [], 0
            for lo, row, place, least, h, at in _windows(b.column("text"), window, anchor):
                keep = kept(least, row, lo, b.column("hits"))
                if not len(keep):
                    continue
                at, row = at[keep], lo + row[keep]
                sums, back = _sums(h), powers(_B_INVERSE, len(h) + 1)
                other = _sums(mix(h + np.uint64(0xA0761D6478BD642F)))
                path = lambda k, of=sums: mix((of[at + k] - of[at]) * back[at] + np.uint64(k)).view(np.int64)
                parts.append((*map(path, prefixes), path(window), path(window, other), doc[row], tag[row], place[keep].astype(np.int32)))
                held += len(keep)
                if held > HELD:
                    yield decided(parts)
                    parts, held = [], 0
            if parts:
                yield decided(parts)

    return materialize(rows.select("doc", "tag", "text", "hits").mapInArrow(run, f"{_SUFFIX}, done boolean"), "suffixes")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes, of subtrees in order, under nodes of full depth that a smaller document is under too."""
    last = (None, None, None)  # label, check and smallest document of the node at the end of the batch before
    for b in batches:
        if not b.num_rows:
            continue
        label, check, d = (b.column(c).to_numpy() for c in ("label", "check", "doc"))
        new = np.concatenate([[(label[0], check[0]) != last[:2]], (label[1:] != label[:-1]) | (check[1:] != check[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(len(d)), -1))
        least = np.where(head >= 0, d[np.maximum(head, 0)], last[2] if last[2] is not None else 0)
        last = (label[-1], check[-1], least[-1])
        at = pa.array(np.flatnonzero(d > least))
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("doc", "tag", "place")], names=["doc", "tag", "place"])


def repeated_places(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, prefixes: tuple[int, int] = PREFIXES, group: int = GROUP, sent: int = SENT) -> DataFrame:
    """(doc, tag, places): the windows (start word) of each row whose words also start in a smaller document.

    docs: (doc bigint, tag bigint, text string) without nulls in doc; tag tells the texts of one doc apart.
    """
    found = _suffixes(docs, window, anchor, prefixes, sent)
    left = found.where("not done").drop("done")

    def crowded(rows: DataFrame, by: str) -> DataFrame:
        most = materialize(rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > group).select(by), "crowded")
        return F.broadcast(most) if most.count() <= BROADCAST else most

    subtrees = lambda rows, by: rows.repartition(by).sortWithinPartitions(by, "label", "check", "doc").mapInArrow(_walk, "doc bigint, tag bigint, place int")
    places = [found.where("done").select("doc", "tag", "place")]
    for by in ("short", "long"):
        most = crowded(left, by)
        places.append(subtrees(left.join(most, by, "left_anti"), by))
        left = materialize(left.join(most, by, "left_semi").select(*found.drop("done").columns), "split")
    # both sides of this join are read from tables, so that a node of any size is split between tasks
    least = materialize(left.groupBy("label", "check").agg(F.min("doc").alias("least")), "nodes")
    places.append(left.join(least, ["label", "check"]).where("doc > least").select("doc", "tag", "place"))
    marked = places[0]
    for more in places[1:]:
        marked = marked.unionByName(more)
    return marked.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with kept_text (kept words, one space between), n_words and n_removed, by the words that repeated windows cover.

    Null, blank and short texts lose nothing. Rows of one id are one document, so
    that none of them hides a word from another, but each is judged by its own
    text; a row with a null id is left alone and hides nothing from others; columns
    of docs with the new names are replaced; an empty table gives no rows. Exact
    copies of a smaller document are found by their digest first: all their windows
    repeat. options: as repeated_places takes them.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    ids = materialize(keyed.select("doc", "tag", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    first = materialize(ids.groupBy("digest").agg(F.min("doc").alias("first")), "first")
    copies = materialize(ids.join(first, "digest").where("doc > first").select("doc", "tag").distinct(), "copies")
    few = copies.count() <= BROADCAST
    single = keyed.join(F.broadcast(copies) if few else copies, ["doc", "tag"], "left_anti")
    places = repeated_places(single, window, anchor, **options)
    removal = places.withColumn("copy", F.lit(False)).unionByName(copies.select("doc", "tag", F.array().cast("array<int>").alias("places"), F.lit(True).alias("copy")))
    removal = materialize(removal, "removal").select(*(F.col(c).alias(f"__{c}") for c in ("doc", "tag", "places", "copy")))
    same = (F.col(id_col).cast("bigint") == F.col("__doc")) & (F.xxhash64(text) == F.col("__tag"))
    return _without(docs.join(removal.hint("merge"), same, "left"), docs, window, text_col)


def _without(marked: DataFrame, docs: DataFrame, window: int, text_col: str) -> DataFrame:
    out = [*docs.columns, "kept_text", "n_words", "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            kept, n_words, n_removed = [], [], []
            for text, places, copy in zip(*(b.column(c).to_pylist() for c in (text_col, "__places", "__copy")), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(own) + 1, np.int64)
                if copy and len(own) >= window:
                    edge[0] = 1
                elif places:
                    at = np.unique(places)
                    at = at[at <= len(own) - window]
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                gone = np.cumsum(edge)[:-1] > 0
                if gone.any():
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(~gone)]))
                else:
                    kept.append(b" ".join(own))
                n_words.append(len(own))
                n_removed.append(int(gone.sum()))
            columns = [b.column(c) for c in names if c not in ("__doc", "__tag", "__places", "__copy")]
            more = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=out)

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("kept_text string, n_words bigint, n_removed bigint").fields])
    return marked.mapInArrow(run, schema)


def op4_substring(spark, sf_dir: str) -> DataFrame:
    """What every document keeps when windows of 50 words that a smaller document has go."""
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
