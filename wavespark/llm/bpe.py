"""Byte-level BPE over whole texts: ranked merges folded by higher-order functions.

Three narrow steps over the texts, none of which shuffles them, so the work is
linear in the text and a lost task is simply run again. Before them the words of a
bounded sample are folded, each once, and every task starts with these as known:
they save tasks the folding of words that most of them hold and change no result.

1. The JVM splits every text by the tokenizer's pattern; an Arrow step numbers the
   distinct words of its task as they come up and hands on the new ones, as byte
   arrays, before the documents that hold them, as word numbers.
2. A higher-order fold merges each word once a task: its state is one array that
   holds tokens with the ranks of their pairs; every step takes the smallest rank,
   the leftmost on ties, and asks the literal rank map for the two new pairs only.
   A long word is folded in windows that are joined at tokens on which both agree,
   so that the work is linear in its length.
3. An Arrow step, which gets the rows in that order, puts the ids of the words back
   together per document.

The rank map is a literal of the plan whose size is that of the vocabulary, never
of the data: for each pair of tokens whose bytes joined are a token, that token.
It is laid out as an array of displaced rows without gaps, because a lookup in a
Spark map value scans all its entries, and every task receives a copy.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: Unicode white space, as the pattern's \s means it; Java's \s is ASCII only.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The greatest of 18 bits: no rank.
_TOP = (1 << 18) - 1


def java_pattern(pattern: str) -> str:
    """The split pattern in Java's syntax, with Unicode white space."""
    return (
        pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
        .replace(r"(?!\S)", rf"(?![^{_SPACE}])")
        .replace(r"\s", f"[{_SPACE}]")
    )


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, space, rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _displace(rows: dict[int, list[tuple[int, int]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sparse matrix laid into each other's gaps: cell (a, b) stands at base[a] + b, as a << 18 | value; others hold -1."""
    rng, total = np.random.default_rng(0), sum(map(len, rows.values()))
    most, span = 12 * total + width, float(max(total, 64))
    base, cell, single = np.zeros(width, np.int64), np.full(most + width, -1, np.int64), []
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        b, tries = np.array([x for x, _ in row]), 0
        if len(row) == 1:
            single.append((a, b[0], row[0][1]))
            continue
        at = int(rng.integers(int(span))) - int(b.min())
        while (cell[at + b] >= 0).any():
            tries += 1
            if tries % 300 == 0:
                span = min(span * 1.02, most)
            at = int(rng.integers(int(span))) - int(b.min())
        base[a], cell[at + b] = at, (a << 18) + np.array([v for _, v in row])
    for place, (a, b, v) in zip(np.flatnonzero(cell < 0)[: len(single)].tolist(), single, strict=True):
        base[a], cell[place] = place - b, (a << 18) + v
    return base, cell[: int(np.flatnonzero(cell >= 0).max(initial=0)) + 1]


@lru_cache(maxsize=4)
def _tables(path: str) -> dict[str, str]:
    ranks = load_ranks(path)
    if len(ranks) >= _TOP:
        raise ValueError(f"a vocabulary has fewer than {_TOP} tokens")
    rows: dict[int, list[tuple[int, int]]] = {}
    two = np.full(65536, -1)
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
        if len(token) == 2:
            two[token[0] * 256 + token[1]] = rank
    width = max(ranks.values()) + 1
    base, cell = _displace(rows, width)
    by_id: list[bytes] = [b""] * width
    for token, rank in ranks.items():
        by_id[rank] = token
    put = lambda x: json.dumps([int(v) for v in x], separators=(",", ":"))
    return {
        "base": put(base), "cell": put(cell), "two": put(two), "bytes": put(ranks[bytes([b])] for b in range(256)), "length": put(map(len, by_id)),
        "pieces": json.dumps([base64.b64encode(t).decode() for t in by_id]),
    }


def _literal(text: str, kind: str) -> Column:
    """An array literal; the optimizer folds it once."""
    return F.from_json(F.lit(text), kind)


def rank_map(path: str) -> Column:
    """The rank map as one literal struct: pairs of tokens (base, cell), pairs of bytes, the id of each byte, and the length of each token."""
    t, kinds = _tables(path), {"base": "int", "cell": "bigint", "two": "int", "bytes": "int", "length": "int"}
    return F.struct(*(_literal(t[c], f"array<{kind}>").alias(c) for c, kind in kinds.items()))


def fold_word(word: Column, ranks: Column) -> Column:
    """Token ids (array<int>) of one word given as array of byte values; ranks: a bound rank_map.

    The state is one array of longs, a token each: the rank of the pair that starts
    there (the bits from 44 on, _TOP if none) and its id. An entry without rank
    stands in front. Each entry's place is added when the least is looked for, so
    that it is the smallest rank, the leftmost on ties, and says where it is.
    Values are bound by folds over one element, which evaluate no types.
    """

    def rank(a: Column, b: Column) -> Column:  # looking the cell up twice costs less than binding it
        cell = F.get(ranks["cell"], F.get(ranks["base"], a) + b)
        return F.when(F.shiftright(cell, 18) == a, cell.bitwiseAND(_TOP)).otherwise(F.lit(_TOP).cast("bigint"))

    up = lambda r: F.shiftleft(r, 44)
    id_of = lambda x: x.bitwiseAND(_TOP).cast("int")

    def merge(s: Column, least: Column) -> Column:
        p, token = F.shiftright(least, 18).bitwiseAND((1 << 26) - 1).cast("int"), F.shiftright(least, 44).cast("int")
        before, after = id_of(F.get(s, p - 1)), id_of(F.get(s, p + 2))
        new = F.array(up(rank(before, token)) + before, up(rank(token, after)) + token)  # entries p and p + 1 become one; the one before gets a new rank
        return F.aggregate(F.array(new), s, lambda s, new: F.flatten(F.array(F.slice(s, F.lit(1), p - 1), new, F.slice(s, p + 3, F.size(s)))))

    def step(s: Column, _: Column) -> Column:
        least = F.array_min(F.transform(s, lambda x, i: x + F.shiftleft(i.cast("bigint"), 18)))
        return F.aggregate(F.array(least), s, lambda s, least: F.when(least < (_TOP << 44), merge(s, least)).otherwise(s))

    def pair(a: Column, b: Column) -> Column:
        r = F.get(ranks["two"], a.cast("int") * 256 + b)
        return up(F.when(r >= 0, r).otherwise(F.lit(_TOP)).cast("bigint"))

    rest = F.slice(word, F.lit(2), F.size(word))
    tokens = F.transform(word, lambda b: F.get(ranks["bytes"], b.cast("int")).cast("bigint"))
    paired = F.zip_with(tokens, F.zip_with(word, rest, pair), lambda t, r: t + F.coalesce(r, F.lit(_TOP << 44)))
    start = F.flatten(F.array(F.array(F.lit((_TOP << 44) + _TOP)), paired))
    return F.aggregate(rest, start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s)), id_of))


#: Bytes of the windows of a long word, and bytes at a window's end whose tokens are not relied on.
WINDOW, MARGIN = 192, 64
#: Greatest bytes of a word.
LONGEST = (1 << 26) - 1


def fold_long(word: Column, ranks: Column) -> Column:
    """The same ids as fold_word, in steps of a window each: linear in the length of the word.

    A sequence of tokens is what the merges give exactly if that holds for each two
    neighbours. So two windows can be joined at a token that both have: the step
    keeps a window's tokens up to one well before its end, and folds the next window
    from there. If that does not begin with the same token, the step before is taken
    back with twice the window. Where this leads to nothing the word is folded whole.
    """
    none = F.array().cast("array<int>")

    def state(done, last, back, at, head, width) -> Column:
        fields = zip(("done", "last", "back", "at", "head", "width"), (done, last, back, at, head, width), strict=True)
        return F.struct(*(F.lit(v).alias(c) if isinstance(v, int) else v.alias(c) for c, v in fields))

    def advance(z: Column, ids: Column) -> Column:
        whole = z["at"] + z["width"] >= F.size(word)
        same = (z["head"] < 0) | (F.get(ids, F.lit(0)) == z["head"])

        def cut(c: Column) -> Column:  # c: tokens that begin early enough, and the place of the last of them
            kept = F.concat(z["done"], F.array_join(F.concat(z["last"].cast("array<string>"), F.array(F.lit(""))), " ").cast("binary"))
            on = state(kept, F.slice(ids, F.lit(1), c["n"] - 1), c["start"], z["at"] + c["start"], F.get(ids, c["n"] - 1), WINDOW)
            return F.when(c["n"] > 1, on).otherwise(wider)

        wider = state(z["done"], z["last"], z["back"], z["at"], z["head"], z["width"] * 2)
        again = state(z["done"], none, 0, z["at"] - z["back"], F.coalesce(F.get(z["last"], F.lit(0)), F.lit(-2)), z["width"] * 2)
        finished = state(z["done"], F.concat(z["last"], ids), 0, F.size(word), 0, 0)
        limit = z["width"] - MARGIN
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"))
        early = lambda c, t: F.struct(
            F.when(c["end"] <= limit, c["n"] + 1).otherwise(c["n"]).alias("n"),
            F.when(c["end"] <= limit, c["end"]).otherwise(c["start"]).alias("start"),
            (c["end"] + F.get(ranks["length"], t)).alias("end"),
        )
        return F.when(~same, again).when(whole, finished).otherwise(let(F.aggregate(ids, zero, early), cut))

    def step(z: Column, _: Column) -> Column:
        # head is -1 in front of the word, and -2 where a step can't be taken back: then nothing is left to try
        over = (z["at"] >= F.size(word)) | (z["head"] == -2)
        return F.when(over, z).otherwise(let(fold_word(F.slice(word, z["at"] + 1, z["width"]), ranks), lambda ids: advance(z, ids)))

    def finish(z: Column) -> Column:
        before = F.filter(F.split(z["done"].cast("string"), " "), lambda x: x != "").cast("array<int>")
        return F.when(z["at"] >= F.size(word), F.concat(before, z["last"]))

    steps = F.sequence(F.lit(0), F.floor(F.size(word) / (WINDOW // 8)).cast("int"))
    windows = F.aggregate(steps, state(F.lit("").cast("binary"), none, 0, 0, -1, WINDOW), step, finish)
    return let(windows, lambda ids: F.coalesce(ids, fold_word(word, ranks)))


def fold(word: Column, ranks: Column) -> Column:
    """Token ids of a word of any length."""
    n = F.size(word)
    refused = F.raise_error(F.lit(f"a word has more than {LONGEST} bytes")).cast("array<int>")
    return F.when(n <= WINDOW, fold_word(word, ranks)).when(n <= LONGEST, fold_long(word, ranks)).otherwise(refused)


BLOCK = "reset boolean, doc array<bigint>, n array<int>, at array<int>, word array<array<smallint>>, whole array<int>"
#: Words that a task numbers before it starts anew, about; words of a row and their bytes, about; pieces looked up at a time and of a row, about.
WORDS, WORDS_ROW, BYTES_ROW, PIECES_ROW, PIECES_OUT = 1 << 20, 1 << 13, 1 << 18, 1 << 20, 1 << 17


class KnownWords(NamedTuple):
    """Words of no vocabulary entry with their token ids: the bytes, all ids one after the other, and how many each word has."""

    word: pa.Array
    ids: np.ndarray
    size: np.ndarray


#: Rows of the sample that words are taken from (at most a fourth of the table), words kept, and their greatest bytes.
SAMPLE_ROWS, KNOWN_WORDS, KNOWN_BYTES = 20_000, 1 << 18, 64


def known_words(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", rows: float = SAMPLE_ROWS, most: int = KNOWN_WORDS, share: float = 0.25
) -> KnownWords:
    """The words of a sample, each folded once, those of the most tasks if there are more than `most`.

    What is collected has at most `most` words of KNOWN_BYTES, whatever the table.
    """
    spark = df.sparkSession
    fraction = min(share, rows / max(df.count(), 1))
    sample = df.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = piece_blocks(sample if fraction >= 1 else sample.sample(fraction, 0), "doc_id", "text", pattern, [*load_ranks(ranks_path)])
    fresh = blocks.select(F.explode(F.arrays_zip("word", "whole")).alias("z")).where(f"z.whole < 0 and size(z.word) <= {KNOWN_BYTES}")
    counted = materialize(fresh.groupBy(F.col("z.word").alias("word")).agg(F.count("*").alias("tasks")), "known-words")
    total, least = 0, 1 << 62
    for r in sorted(counted.groupBy("tasks").count().collect(), reverse=True):  # at most one row for each row of the sample
        total += r["count"]
        if total > most:
            break
        least = r["tasks"]
    # the folding is worth tasks of its own: a stated number, which adaptive execution leaves as it is
    dealt = counted.where(F.col("tasks") >= least).repartition(4 * spark.sparkContext.defaultParallelism, "word")
    t = dealt.select("word", let(rank_map(ranks_path), lambda ranks: fold(F.col("word"), ranks)).alias("ids")).toArrow().combine_chunks()
    word, ids = (t.column(c).combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("word", "ids"))
    data = word.flatten().to_numpy().astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(word.value_lengths().to_numpy())]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return KnownWords(raw, ids.flatten().to_numpy().astype(np.int32), ids.value_lengths().to_numpy().astype(np.int32))


def _byte_lists(word: pa.Array) -> pa.ListArray:
    offsets = np.frombuffer(word.buffers()[1], np.int32)[word.offset : word.offset + len(word) + 1]
    data = np.frombuffer(word.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int16)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(data))


def piece_blocks(
    df: DataFrame, id_col: str, text_col: str, pattern: str, vocabulary: list[bytes] | None = None, words: int = WORDS, known: KnownWords | None = None
) -> DataFrame:
    """Rows of two kinds, in the order of each task: words that are new to the task, then documents as numbers of words.

    whole: a word's rank where the whole word is in the vocabulary, else -1.
    reset: numbers start again with this row, so that no task holds many more than `words` words.
    Words of `known` have the first numbers in every task and are never handed on.
    """
    first = known.word if known else pa.array([], pa.binary())
    pieces = df.select(
        F.col(id_col).cast("bigint").alias("doc"),
        F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0)).alias("p"),
    )
    none = pa.array([], pa.int32())

    def row(reset: bool, doc=none.cast(pa.int64()), n=none, at=none, word=pa.array([], pa.list_(pa.int16())), whole=none) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (doc, n, at, word, whole)]
        return pa.RecordBatch.from_arrays([pa.array([reset]), *lists], names=["reset", "doc", "n", "at", "word", "whole"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        vocab, seen = pa.array(vocabulary or [], pa.binary()), first
        for b in batches:
            ends, lo = np.cumsum(pc.list_value_length(b.column("p")).to_numpy(), dtype=np.int64), 0
            while lo < b.num_rows:
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + PIECES_ROW, "right")))
                doc, p = b.column("doc").slice(lo, hi - lo), b.column("p").slice(lo, hi - lo)
                lo = hi
                coded = p.flatten().cast(pa.binary()).dictionary_encode()
                if len(seen) - len(first) > words:
                    seen = first
                    yield row(True)
                old = pc.index_in(coded.dictionary, value_set=seen)
                fresh = coded.dictionary.filter(old.is_null())
                is_new = old.is_null().to_numpy(zero_copy_only=False)
                number = np.where(is_new, len(seen) + np.cumsum(is_new) - 1, pc.fill_null(old, 0).to_numpy()).astype(np.int32)
                seen = pa.concat_arrays([seen, fresh])
                whole = pc.fill_null(pc.index_in(fresh, value_set=vocab), -1)
                filled, at = np.cumsum(pc.binary_length(fresh).to_numpy(), dtype=np.int64), 0
                while at < len(fresh):
                    full = int(np.searchsorted(filled, (filled[at - 1] if at else 0) + BYTES_ROW, "right"))
                    n = max(1, min(WORDS_ROW, full - at))
                    yield row(False, word=_byte_lists(fresh.slice(at, n)), whole=whole.slice(at, n))
                    at += n
                at, n = number[coded.indices.to_numpy()], pc.list_value_length(p)
                stops, i = np.cumsum(n.to_numpy(), dtype=np.int64), 0
                while i < len(doc):  # documents leave in rows of fewer pieces than are looked up at a time
                    start = int(stops[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(stops, start + PIECES_OUT, "right")))
                    yield row(False, doc.slice(i, j - i), n.slice(i, j - i), pa.array(at[start : int(stops[j - 1])]))
                    i = j
                del coded, old, fresh, is_new, number, whole, at
                pa.default_memory_pool().release_unused()

    return pieces.mapInArrow(blocks, BLOCK)


def join_blocks(blocks: DataFrame, known: KnownWords | None = None) -> DataFrame:
    """Blocks with a column ids (array<array<int>>, one entry a word) to one row per document: doc, ids."""
    start = (known.ids, known.size) if known else (np.zeros(0, np.int32), np.zeros(0, np.int32))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (flat, size), more = start, []  # ids of the task's words, one after the other
        first = np.cumsum(size, dtype=np.int64) - size
        for batch in batches:
            for i in range(batch.num_rows):
                doc, n, at, ids = (batch.column(c)[i].values for c in ("doc", "n", "at", "ids"))
                if batch.column("reset")[i].as_py():
                    (flat, size), more = start, []
                    first = np.cumsum(size, dtype=np.int64) - size
                if len(ids):
                    more.append((ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(ids.offsets.to_numpy()).astype(np.int32)))
                if not len(doc):
                    continue
                if more:
                    flat, size = (np.concatenate(x) for x in zip((flat, size), *more, strict=True))
                    first, more = np.cumsum(size, dtype=np.int64) - size, []
                word = at.to_numpy()
                own = size[word].astype(np.int64) if len(word) else np.zeros(0, np.int64)
                stop = np.cumsum(own)
                out = flat[np.repeat(first[word] - (stop - own), own) + np.arange(stop[-1])] if len(word) else flat[:0]
                cut = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(n.to_numpy())])]
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(out, pa.int32()))], names=["doc", "ids"]
                )

    return blocks.select("reset", "doc", "n", "at", "ids").mapInArrow(put, "doc bigint, ids array<int>")


def bpe_encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    known: KnownWords | None = None,
) -> DataFrame:
    """Token ids of every whole text: one row (id_col, ids array<int>) per input row.

    Null and empty texts give an empty array; repeated rows stay repeated; a null
    id stays null; other columns of df are ignored; an empty table gives no rows. A
    word (match of the pattern) of more than LONGEST bytes is an error. known: words
    that tasks need not fold, those of known_words(df, ...) unless given.
    """
    known = known_words(df, ranks_path, pattern, text_col) if known is None else known
    vocabulary = [t for t, _ in sorted(load_ranks(ranks_path).items(), key=lambda x: x[1])]
    blocks = piece_blocks(df, id_col, text_col, pattern, vocabulary, words, known)
    words_of = lambda ranks: F.zip_with("word", "whole", lambda w, r: F.when(r >= 0, F.array(r)).otherwise(fold(w, ranks)))
    merged = let(rank_map(ranks_path), words_of)
    return join_blocks(blocks.withColumn("ids", merged), known).withColumnRenamed("doc", id_col)


def bpe_decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of a text from its token ids: the tokens' bytes, one after the other.

    The binary pieces are joined as strings, which Spark takes as bytes of any kind.
    """
    pieces = _literal(_tables(ranks_path)["pieces"], "array<binary>").cast("array<string>")
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "").cast("binary")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the bytes decoded from them."""
    import public_tokenizers as P

    from .common import table

    path = P.path("byte_bpe_50k.tiktoken")
    coded = bpe_encode(table(spark, sf_dir, "documents"), path, P.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe_decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
