"""Cross-entropy difference: a target and a background n-gram model over one vocabulary.

Both models are interpolated bigrams with the same vocabulary (all lower-cased words
of the corpus), smoothing and pass: every document counts for the background, those
marked as target also for the target. Words and pairs are counted by 64-bit keys, so
the models grow with the corpus and are never collected or sent to all tasks.

Documents are dealt to blocks of some megabytes, keys to ranges. A block sends each
range where it has keys these, distinct and sorted, with their counts, so that the most
common word is one entry a block, and that there are never more rows than keys of blocks,
however many ranges there are. A range adds them up and sends each block the sums of the
keys it asked for, in the same order and so without the keys; the block scores its
documents with them. The totals of both models are one row, summed over the ranges. One
plan counts and scores, over one shuffle of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textbytes import WORD_LIKE, Hasher, chunks, mix, spans

#: Bytes of texts in a block, about.
BLOCK_BYTES = 4 << 20
#: Blocks for each range of keys: what a range adds up is as large as the keys of so many blocks.
BLOCKS_A_RANGE = 3
#: Weights of the pair, the word and the even distribution.
WEIGHTS = (0.5, 0.45, 0.05)


@dataclass(frozen=True)
class Models:
    """The corpus, the number of key ranges, and its counts by block and range (see _asks)."""

    docs: DataFrame
    ranges: int
    counts: DataFrame


def _tokens(texts: pa.Array) -> Iterator[tuple]:
    """For a chunk: first row, last + 1, first token of each row, keys of word, word before and pair of each token.

    Keys of words are odd, of pairs even; a document's first word follows 0.
    """
    import pyarrow.compute as pc

    for lo, hi, data, offsets in chunks(pc.utf8_lower(texts)):
        starts, ends, first = spans(data, offsets, WORD_LIKE)
        word = Hasher(data)(starts, ends) | np.uint64(1)
        before = np.concatenate([np.zeros(1, np.uint64), word[:-1]]) if len(word) else word.copy()
        before[first[:-1][first[:-1] < len(word)]] = 0
        pair = mix(before * np.uint64(0x2545F4914F6CDD1D) + word) & ~np.uint64(1)
        yield lo, hi, first, word, before, pair


def count_blocks(docs: DataFrame, text: Column) -> int:
    return (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BLOCK_BYTES + 1


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint"))


def _blocks(docs: DataFrame, text_col: str) -> DataFrame:
    if "__block" in docs.columns:
        return docs
    key = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    return docs.withColumn("__block", block_of(key, count_blocks(docs, F.col(text_col))))


def _packed(x: np.ndarray) -> bytes:
    """Byte planes, the highest bytes of all first: sorted keys and small counts compress."""
    return x.view(np.uint8).reshape(-1, 8).T[::-1].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1)[::-1].T).view(np.uint64).reshape(-1)


def _asks(docs: DataFrame, text_col: str, target: Column, ranges: int, counting: bool = True) -> DataFrame:
    """(__block, range, keys, background, target), packed: the distinct words and pairs of each block and their counts there (or 0)."""

    def run(t: pa.Table) -> pa.Table:
        own, found = t["target"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool), [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)]
        for lo, hi, first, word, _, pair in _tokens(t["text"].combine_chunks()):
            marked = np.repeat(own[lo:hi], np.diff(first))
            keys, at = np.unique(np.concatenate([word, pair]), return_inverse=True)
            found.append((keys, np.bincount(at, minlength=len(keys)), np.bincount(at[np.concatenate([marked, marked])], minlength=len(keys))))
        keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        counts = [np.zeros(len(keys), np.int64) for _ in range(2)]
        for m, total in enumerate(counts if counting else []):
            np.add.at(total, at, np.concatenate([f[m + 1] for f in found]))
        cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(cut))
        packed = [pa.array([_packed(x[cut[r] : cut[r + 1]]) for r in some], pa.binary()) for x in (keys, *counts)]
        block = np.full(len(some), t["__block"][0].as_py(), np.int64)
        return pa.table([pa.array(block), pa.array(some), *packed], ["__block", "range", "keys", "background", "target"])

    rows = docs.select("__block", F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    return rows.groupBy("__block").applyInArrow(run, "__block bigint, range bigint, keys binary, background binary, target binary")


def _sums(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """A range's distinct keys, the keys of each of its rows, all their places among the distinct ones, and both models' sums."""
    parts = [_unpacked(k) for k in t["keys"].to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unpacked(c) for c in t[m].to_pylist()]), len(keys)).astype(np.int64) for m in ("background", "target")]
    return keys, parts, at, sums


def _answers(asks: DataFrame) -> DataFrame:
    """(__block, range, background, target): sums for the keys a block asked for there."""

    def run(t: pa.Table) -> pa.Table:
        _, parts, at, sums = _sums(t)
        cut, rows = np.cumsum([0, *map(len, parts)]), []
        for i, block in enumerate(t["__block"].to_pylist()):
            if block is not None:
                rows.append((block, t["range"][i].as_py(), *(_packed(s[at[cut[i] : cut[i + 1]]]) for s in sums)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, out, strict=True)], schema=out)

    out = pa.schema([("__block", pa.int64()), ("range", pa.int64()), ("background", pa.binary()), ("target", pa.binary())])
    return asks.groupBy("range").applyInArrow(run, "__block bigint, range bigint, background binary, target binary")


def _totals(asks: DataFrame) -> DataFrame:
    """One row: the distinct words, and the tokens of both models."""

    def run(t: pa.Table) -> pa.Table:
        keys, _, _, sums = _sums(t)
        word = (keys & np.uint64(1) == 1) & (sums[0] > 0)
        return pa.table({"words": [int(word.sum())], "n_background": [int(sums[0][word].sum())], "n_target": [int(sums[1][word].sum())]})

    parts = asks.groupBy("range").applyInArrow(run, "words bigint, n_background bigint, n_target bigint")
    return parts.agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns)).alias("totals"))


def fit_models(docs: DataFrame, text_col: str = "text", target_col: str = "target", blocks: int | None = None) -> Models:
    """Count all of docs; target_col is true where a document also counts for the target (null: false).

    A column __block of docs, if there is one, deals the rows to blocks.
    """
    ranges = (blocks or count_blocks(docs, F.col(text_col))) // BLOCKS_A_RANGE + 1
    return Models(docs, ranges, _asks(_blocks(docs, text_col), text_col, F.col(target_col), ranges))


def cross_entropy_difference(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, target_loss, background_loss (nats a token) and score = background_loss - target_loss.

    A text without words has no loss: 0 tokens and zeros. Rows are kept as they
    are; columns of docs with the new names are replaced.
    """
    blocks = _blocks(docs, text_col)
    asks = models.counts
    if docs is not models.docs:  # other documents ask without counting
        asks = _asks(blocks, text_col, F.lit(False), models.ranges, counting=False).unionByName(asks.withColumn("__block", F.lit(None).cast("bigint")))
    kept = [f for f in docs.schema.fields if f.name not in ("n_tokens", "target_loss", "background_loss", "score")]
    names = [f.name for f in kept]
    more = T.StructType.fromDDL("n_tokens bigint, target_loss double, background_loss double, score double")

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("range")  # none for a block without words
        words, *totals = known["totals"][0].as_py().values() if known.num_rows else (0, 0, 0)
        counts = [np.concatenate([np.zeros(0, np.int64), *(_unpacked(c).view(np.int64) for c in known[m].to_pylist())]) for m in ("background", "target")]
        parts = list(_tokens(t[text_col].combine_chunks()))
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(np.concatenate([word, pair])) for _, _, _, word, _, pair in parts)]))
        n, loss = np.zeros(t.num_rows, np.int64), np.zeros((2, t.num_rows))
        for lo, hi, first, word, before, pair in parts:
            n[lo:hi] = np.diff(first)
            if not len(word):
                continue
            start = before == 0
            own, pairs = np.searchsorted(keys, word), np.searchsorted(keys, pair)
            context = np.concatenate([own[:1], own[:-1]])
            for m in (0, 1):
                total = max(totals[m], 1)
                seen = np.where(start, total, counts[m][context].astype(float))
                p = WEIGHTS[0] * counts[m][pairs] / np.maximum(seen, 1.0) + WEIGHTS[1] * counts[m][own] / total + WEIGHTS[2] / (words + 1)
                sums = np.concatenate([[0.0], np.cumsum(-np.log(p))])
                loss[m, lo:hi] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n[lo:hi], 1)
        return pa.table([*(t[c] for c in names), pa.array(n), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[0] - loss[1])], [*names, *more.names])

    answers = _answers(asks).withColumn("totals", _totals(asks).scalar())
    return blocks.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(run, T.StructType([*kept, *more.fields]))


def op5_lm(spark, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference between good documents (labels.quality) and all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = count_blocks(docs, F.col("text"))
    # rows with a null id are never targets, so their texts deal them
    block = F.when(F.col("doc_id").isNull(), block_of(F.col("text"), blocks)).otherwise(block_of(F.col("doc_id"), blocks))
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").groupBy(block_of(F.col("doc_id"), blocks).alias("__block")).agg(F.collect_set("doc_id").alias("good"))
    # joined by block, so that this shuffle of the texts is also the one that counts and scores; the plan is the same at any size
    docs = docs.withColumn("__block", block).join(good.hint("merge"), "__block", "left")
    docs = docs.select("doc_id", "text", "__block", F.array_contains("good", F.col("doc_id")).alias("target"))
    return cross_entropy_difference(docs, fit_models(docs, blocks=blocks)).select("doc_id", "n_tokens", "target_loss", "background_loss", "score")
