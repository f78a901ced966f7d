"""Spelling variants: words one edit apart, by states that descend a trie held as a table of edges.

The trie of the vocabulary is compressed: a node is kept where words part or end, and an
edge is the label between two kept nodes, so the trie has at most two edges a word,
however long words are. Nodes are known by a hash of their prefix; a clash of two only
adds candidates, as every result is looked up among the words.

A state is (word, position, node, edits). All states without an edit are known at once:
each kept node on a word's own path. The edit is made where the two words part, so each
pair is found once: a join with the edges makes the states with one edit, further joins
move all of them down by one edge each, level by level, until none is left. A state
whose next letters don't follow below its node ends where it would be made. A removed
letter is the other word's inserted one, so pairs are found as replaced by a greater
letter or as inserted, and are taken both ways.
"""

from __future__ import annotations

import collections
import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .textbytes import Hasher

#: Letters besides a-z, as UTF-8: U+00C0 to U+00FF are 0xC3 and one byte more.
_LEAD = 0xC3
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() or b == _LEAD for b in range(256)])
_CRC = np.array([functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), b) for b in range(256)], np.uint32)
#: Nodes of less than SHALLOW letters stand on the paths of many words; their rows are dealt to SALTS keys.
SHALLOW, SALTS = 2, 16
#: Letters below a node that a state is held against before it is made; words of 64 bits that a node's set of them takes at most.
AHEAD, MOST_BITS = 3, 1024
#: Bytes of texts whose words are counted together.
CHUNK = 4_000_000


def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] behind what gave each state, all at once by byte position; long ones one by one."""
    out = state ^ np.uint32(0xFFFFFFFF)
    size = end - start
    order = np.argsort(-size, kind="stable")
    size_, at, c = size[order], start[order], out[order]
    long = int(np.searchsorted(-size_, -64))  # those of more than 64 bytes come first
    alive = len(size_) - np.searchsorted(size_[::-1], np.arange(64), "right")
    for j in range(64):
        n = alive[j]
        if n <= long:
            break
        own = c[long:n]
        c[long:n] = _CRC[(own ^ data[at[long:n] + j]) & 255] ^ (own >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(data[at[i] : at[i] + size_[i]], int(state[order[i]]))
    out[order] = c
    return out


def counted_words(texts: pa.Array, ids: list[str], shortest: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of some texts, one run in 97 without one letter, and how often each occurs."""
    text = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    own = np.zeros(len(data) + 2, bool)
    own[1:-1] = _LETTER[data]
    own[2:-1] |= data[:-1] == _LEAD
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = np.flatnonzero(own[1:] & (~own[:-1] | cut)), np.flatnonzero(own[:-1] & (~own[1:] | cut))
    lead = np.concatenate([[0], np.cumsum(data == _LEAD)])
    points = end - start - (lead[end] - lead[start])
    good = points >= shortest
    start, end, points = start[good], end[good], points[good]
    row = np.searchsorted(offsets, start, "right") - 1
    h = _checksums(data, start, end, np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[row])
    hit = h % 97 == 0
    less = collections.Counter()
    for s, e, k, n in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist(), points[hit].tolist(), strict=True):
        if n > shortest:
            word = data[s:e].tobytes().decode()
            less[(word[: k % n] + word[k % n + 1 :]).encode()] += 1
    start, end = start[~hit], end[~hit]
    _, first, n = np.unique(Hasher(data)(start, end), return_index=True, return_counts=True)
    whole = data.tobytes()
    words = [whole[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return words + list(less), np.concatenate([n, np.fromiter(less.values(), np.int64, len(less))])


def damaged_words(docs: DataFrame, shortest: int = 5) -> DataFrame:
    """(word, n): runs `[A-Za-z\\u00C0-\\u00FF]+` of whole texts, A-Z lower-cased, of at least `shortest` code points.

    One run in 97, by a checksum of document and run, lacks one letter. A null doc_id
    counts as empty. A word is in several rows, one for each few megabytes of texts.
    """

    def run(batches):
        for b in batches:
            size = np.cumsum(np.nan_to_num(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
                part = b.slice(lo, hi - lo)
                words, n = counted_words(part.column("text"), part.column("doc_id").to_pylist(), shortest)
                for k in range(0, len(words), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(words[k : k + (1 << 14)], pa.binary()).cast(pa.string()), pa.array(n[k : k + (1 << 14)])], names=["word", "n"])
                lo = hi

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint")


def vocabulary(words: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of words that occur `least` times; the counts are summed before any shuffle."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def prefixes(words: DataFrame) -> DataFrame:
    """(id, depth, node, letter) for each prefix of each word: a hash of it, and the code point that follows (0: the word ends)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                text = part.column("word").cast(pa.large_string())
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
                points = np.array([ord(c) for c in data.tobytes().decode()], np.int64)
                at = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
                first, last = np.searchsorted(at, start), np.searchsorted(at, end)
                size = last - first + 1  # prefixes of each word, itself included
                word = np.repeat(np.arange(len(text)), size)
                depth = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
                whole = depth == size[word] - 1
                place = first[word] + depth
                bytes_ = np.where(whole, end[word], np.append(at, len(data))[place])
                node = Hasher(data)(start[word], bytes_).view(np.int64)
                letter = np.where(whole, 0, np.append(points, 0)[place])
                ids = part.column("id").to_numpy()
                for k in range(0, len(word), 1 << 16):
                    cut = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[word[cut]]), pa.array(depth[cut].astype(np.int32)), pa.array(node[cut]), pa.array(letter[cut].astype(np.int32))], names=["id", "depth", "node", "letter"])

    return words.select("id", "word").mapInArrow(run, "id bigint, depth int, node bigint, letter int")


def _salt(of: Column) -> Column:
    return F.when(F.col("depth") < SHALLOW, F.pmod(of, F.lit(SALTS))).otherwise(0).cast("int")


def _salts() -> Column:
    """Every salt that a row of this depth may be asked for with."""
    return F.explode(F.sequence(F.lit(0), F.when(F.col("depth") < SHALLOW, SALTS - 1).otherwise(0)))


def _ahead(word: Column, at: Column) -> Column:
    """A number for the next letters behind a place; fewer are left where the word ends."""
    return F.xxhash64(F.substring(word, at + 1, F.lit(AHEAD)))


def _may_follow(bits: Column, ahead: Column) -> Column:
    """Whether a node's set of what follows may have this: one bit, looked up in place."""
    word = F.get(bits, (F.shiftright(ahead, 6).bitwiseAND(F.size(bits) - 1)).cast("int"))
    return F.call_function("shiftright", word, ahead.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _bit_sets(rows: DataFrame) -> DataFrame:
    """(child, ahead array) to (child, bits): eight bits and more for each number, a power of two of words."""

    def run(batches):
        for b in batches:
            lists, out = b.column("ahead"), []
            for i in range(b.num_rows):
                h = lists[i].values.to_numpy()
                size = min(MOST_BITS, 1 << max(0, (len(h) * 8 - 1) // 64).bit_length())
                bits = np.zeros(size, np.int64)
                np.bitwise_or.at(bits, (h >> 6) & (size - 1), np.left_shift(np.int64(1), h & 63))
                out.append(bits)
            yield pa.RecordBatch.from_arrays([b.column("child"), pa.array(out, pa.list_(pa.int64()))], names=["child", "bits"])

    return rows.mapInArrow(run, "child bigint, bits array<bigint>")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept nodes on each word's path (id, word, depth, node) and the edges (node, depth, label, child, bits).

    bits: a set of the next letters below the child, which may have more than there are.
    """
    every = materialize(prefixes(words), "prefixes")
    kinds = every.groupBy("node", "depth").agg(F.min("letter").alias("least"), F.max("letter").alias("most"))
    kept = kinds.where((F.col("least") != F.col("most")) | (F.col("least") == 0) | (F.col("depth") == 0))
    kept = materialize(kept.select("node", "depth"), "nodes").withColumn("salt", _salts())
    path = every.select("id", "depth", "node", _salt(F.col("id")).alias("salt")).join(kept, ["node", "depth", "salt"]).drop("salt")
    own = Window.partitionBy("id").orderBy("depth")  # a word's own nodes
    path = path.withColumns({"child": F.lead("node").over(own), "below": F.lead("depth").over(own)})
    path = materialize(path.join(words.select("id", "word"), "id"), "path")
    label = F.substring("word", F.col("depth") + 1, F.col("below") - F.col("depth"))
    edges = path.where("child IS NOT NULL").groupBy("node", "depth", "child", label.alias("label")).agg(F.lit(1).alias("one")).drop("one")
    ahead = path.where("depth > 0").groupBy(F.col("node").alias("child"), _ahead(F.col("word"), F.col("depth")).alias("ahead")).agg(F.lit(1).alias("one"))
    sets = _bit_sets(ahead.groupBy("child").agg(F.collect_list("ahead").alias("ahead")))  # as many as AHEAD letters can make, at most
    return path.select("id", "word", "depth", "node"), materialize(edges.join(sets, "child").select("node", "depth", "label", "child", "bits"), "trie")


def near_words(words: DataFrame) -> DataFrame:
    """(id, near): each word of (id, word) with each word that differs from it by one inserted or by one replaced, greater letter."""
    path, edges = trie(words)
    edges = edges.withColumn("letter", F.left("label", F.lit(1)))
    both = path.withColumn("salt", _salt(F.col("id"))).join(edges.withColumn("salt", _salts()), ["node", "depth", "salt"])
    own, more, rest = F.substring("word", F.col("depth") + 1, F.lit(1)), F.length("label") - 1, F.lit(1 << 30)
    both = both.where(F.col("letter") != own)

    def edited(skip: int) -> Column:
        """The near word if the edge's first letter stands for `skip` letters of the word."""
        behind = F.col("depth") + 1 + skip
        follows = (F.substring("word", behind, more) == F.substring("label", 2, more)) & _may_follow(F.col("bits"), _ahead(F.col("word"), F.col("depth") + skip + more))
        return F.when(follows, F.concat(F.left("word", F.col("depth")), "label", F.substring("word", behind + more, rest)))

    replaced = F.when((own != "") & (F.col("letter") > own), edited(1))
    made = both.select("id", F.explode(F.array(replaced, edited(0))).alias("near"), (F.col("depth") + F.length("label")).alias("at"), F.col("child").alias("node"))
    states = materialize(made.where("near IS NOT NULL"), "states")
    ended = F.col("at") == F.length("near")
    out = states.where(ended).select("id", "near")
    steps = edges.select("node", "letter", "label", "child", "bits")
    while not (states := states.where(~ended)).isEmpty():
        moved = states.withColumn("letter", F.substring("near", F.col("at") + 1, F.lit(1))).join(steps, ["node", "letter"])
        moved = moved.where(F.substring("near", F.col("at") + 1, F.length("label")) == F.col("label"))
        at = F.col("at") + F.length("label")
        moved = moved.where(_may_follow(F.col("bits"), _ahead(F.col("near"), at))).select("id", "near", at.alias("at"), F.col("child").alias("node"))
        states = materialize(moved, "states")
        out = out.unionByName(states.where(ended).select("id", "near"))
    return out


def spelling_forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n): near words, the form, and where forms lead.

    A form has at least twice its word's n, so a chain of forms has no more than
    log2 of the greatest n, and its end is found by doubling steps that many times.
    """
    words = materialize(words.withColumn("id", F.monotonically_increasing_id()), "words")
    other = words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = materialize(near_words(words).join(other, "near"), "pairs")
    pairs = pairs.join(words.select("id", "word", "n"), "id")
    one = pairs.select("word", "near", "near_n")
    two = pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    near = one.unionByName(two).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.select("word", "n").join(near, "word", "left")
    good = -F.col("best.n") >= 2 * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))
    rows = materialize(rows, "forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    ends = rows.where("form IS NOT NULL").select("word", F.col("form").alias("end"))
    for _ in range(most.bit_length().bit_length()):
        further = ends.select(F.col("word").alias("end"), F.col("end").alias("further"))
        ends = materialize(ends.join(further, "end", "left").select("word", F.coalesce("further", "end").alias("end")), "ends")
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("end", "word")).drop("end")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of five letters or more that occur three times, with their near words, form and root."""
    docs = table(spark, sf_dir, "documents")
    return spelling_forms(vocabulary(damaged_words(docs))).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by halves of bytes, words by their runs, near words by what is left without one letter, roots by following forms.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0], lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents
), d AS (
  SELECT w, count(*) AS k, flatten(list_transform(string_split(concat(coalesce(doc_id::VARCHAR, ''), ':', w), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b
  FROM r GROUP BY doc_id, w
), h AS (
  SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) >> 4, t[(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) & 15) + 1]))) AS h
  FROM d, t
), v AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN concat(substring(w, 1, h % length(w)), substring(w, h % length(w) + 2)) ELSE w END AS word, k FROM h
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), c AS MATERIALIZED (
  SELECT word, n, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS less FROM v, unnest(generate_series(1, length(word))) AS g(i)
), p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM c AS a JOIN c AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.less = v.word
  UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.less = v.word
), m AS (SELECT word, count(*) AS n_near, min({'n': -near_n, 'w': near}) AS best FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * v.n THEN best.w END AS form, CASE WHEN -best.n >= 2 * v.n THEN -best.n END AS form_n
  FROM v LEFT JOIN m USING (word)
), o AS (
  SELECT word, form AS at FROM f WHERE form IS NOT NULL
  UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.at WHERE f.form IS NOT NULL
), e AS (SELECT o.word, o.at FROM o JOIN f ON f.word = o.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)
"""
