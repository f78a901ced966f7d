"""Lines that recur across documents, by log templates.

Lines are parsed as logs are: a tree of fixed depth leads by the number of tokens
and the first tokens (tokens with a digit are variable) to a leaf. Within a leaf a
token is constant at its place if a large enough share of the leaf's documents have
it there; any other is a variable field. A line has a template for each of SHARES,
from the widest to the narrowest (its constants go on being constants), and the line
itself if it has no variable field. A document's line goes if any of these recurs. So a template is decided by counts alone, whatever the
order of lines or the partitioning, and no leaf has to fit a task.

1. One scan counts, for each leaf, the documents that reach it. A template cannot
   recur more often than its leaf, so all but a few leaves end here.
2. A second scan keeps the lines of the remaining leaves, as token hashes. They
   are merged to distinct variants before anything is exploded, so that a line
   that a third of all documents share is one row.
3. Counts of tokens by place give each variant its templates; templates with
   enough constant tokens, beyond the leading ones too, that occur in enough
   documents recur. Their lines are
   dropped, but for those of the smallest document that has the template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .textbytes import NOT_SPACE, Hasher, chunks, mix, spans

MIN_DOCUMENTS = 5
DEPTH = 3
#: Share of a template's tokens, and of those beyond the leaf's leading ones, that must be constant, and at least so many of the latter.
CONSTANT, BEYOND = 0.5, 2
#: Shares of a leaf's documents from which a token is constant at its place.
SHARES = (0.5, 0.1, 0.02)
#: Leaves that are sent to all tasks at most (8 bytes each); beyond, the lines are joined with them.
SENT = 1 << 22
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
#: As a token of _candidates.
_SHORT = 0x5851F42D
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def _lines(texts: pa.Array, depth: int) -> Iterator[tuple]:
    """For a chunk: first row, and of each line with a token its row, number, leaf, first token and tokens; all token hashes."""
    for lo, _, data, offsets in chunks(texts):
        starts, ends, _ = spans(data, offsets, NOT_SPACE)
        if not len(starts):
            continue
        h = Hasher(data)(starts, ends)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        h = np.where(digits[ends] > digits[starts], _VARIABLE, h)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts) + np.searchsorted(offsets[1:-1], starts, "right")  # of the whole chunk
        row = np.searchsorted(offsets, starts, "right") - 1
        first = np.flatnonzero(np.diff(line, prepend=-1))
        n = np.diff(np.concatenate([first, [len(line)]]))
        own = row[first]
        number = np.searchsorted(breaks, starts[first]) - np.searchsorted(breaks, offsets[own])
        leaf = n.astype(np.uint64)
        for d in range(depth):
            leaf = mix(leaf * np.uint64(31) + np.where(n > d, h[np.minimum(first + d, len(h) - 1)], np.uint64(0)))
        yield lo, own, number, leaf.view(np.int64), first, n, h


def _leaf_counts(docs: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, row, _, leaf, _, _, _ in _lines(b.column("text"), depth):
                once = np.unique(np.stack([leaf, row]), axis=1)[0]  # each leaf once for each document
                found, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["leaf", "n"])

    return docs.mapInArrow(run, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, leaves: DataFrame, depth: int, sent: int) -> DataFrame:
    """doc, number, leaf, variant, tokens of the lines whose leaf is in leaves."""
    few = leaves.count() <= sent
    known = docs.sparkSession.sparkContext.broadcast(np.sort(leaves.toArrow()["leaf"].to_numpy()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for b in batches:
            doc = b.column("doc").to_numpy()
            for lo, row, number, leaf, first, n, h in _lines(b.column("text"), depth):
                if own is None:
                    keep = np.arange(len(leaf))
                else:
                    at = np.minimum(np.searchsorted(own, leaf), max(len(own) - 1, 0))
                    keep = np.flatnonzero(own[at] == leaf) if len(own) else np.zeros(0, int)
                stop = np.cumsum(n[keep])
                place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n[keep], n[keep])
                tokens = h[np.repeat(first[keep], n[keep]) + place]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
                cut = np.concatenate([[0], stop])
                variant = mix(sums[cut[1:]] - sums[cut[:-1]] + leaf[keep].view(np.uint64)).view(np.int64)
                short = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[lo + row[keep]]), pa.array(number[keep].astype(np.int32)), pa.array(leaf[keep]), pa.array(variant), short],
                    names=["doc", "number", "leaf", "variant", "tokens"],
                )

    rows = docs.mapInArrow(run, "doc bigint, number int, leaf bigint, variant bigint, tokens array<int>")
    return rows if few else rows.join(leaves.select("leaf"), "leaf", "left_semi")


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, depth: int = DEPTH, constant: float = CONSTANT, sent: int = SENT) -> DataFrame:
    """(doc, number, template): the lines to drop, numbered from 0. docs: (doc bigint, text string), doc not null."""
    leaves = materialize(_leaf_counts(docs, depth).where(F.col("n") >= min_documents), "leaves")
    lines = materialize(_candidates(docs, leaves, depth, sent), "lines")
    once = lines.groupBy("variant", "leaf", "doc").agg(F.first("tokens").alias("tokens"))
    variants = once.groupBy("variant", "leaf").agg(F.first("tokens").alias("tokens"), F.count("*").alias("docs"))
    variants = materialize(variants, "variants")
    sizes = materialize(variants.groupBy("leaf").agg(F.sum("docs").alias("of")), "sizes")
    tokens = variants.select("variant", "leaf", "docs", F.posexplode("tokens").alias("place", "token")).where(F.col("token") != _SHORT)
    frequent = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_documents)
    frequent = frequent.join(sizes, "leaf").select("leaf", "place", "token", (F.col("n") / F.col("of")).alias("share")).where(F.col("share") >= min(SHARES))
    frequent = materialize(frequent, "frequent")
    fixed = tokens.join(frequent, ["leaf", "place", "token"]).withColumn("level", F.explode(F.array(*map(F.lit, SHARES)))).where("share >= level")
    fixed = fixed.groupBy("variant", "leaf", "level").agg(
        F.count("*").alias("same"), F.count_if(F.col("place") >= depth).alias("beyond"), F.bit_xor(F.xxhash64("place", "token")).alias("mark")
    )
    length = F.col("length")
    shaped = fixed.join(variants.select("variant", F.size("tokens").alias("length")), "variant").where(
        (F.col("same") >= constant * length) & (F.col("beyond") >= F.greatest(F.lit(BEYOND), constant * (length - depth)))
    )
    whole = variants.where(~F.array_contains("tokens", _SHORT)).select("variant", F.xxhash64("leaf", "variant", F.lit("whole")).alias("template"))
    shaped = shaped.select("variant", F.xxhash64("leaf", "level", "mark").alias("template")).unionByName(whole)
    shaped = materialize(shaped, "templates")
    of_docs = lines.select("variant", "doc", "number").join(shaped, "variant")
    counted = of_docs.groupBy("template", "doc").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    counted = materialize(counted.where(F.col("n") >= min_documents), "recurring")
    return of_docs.join(counted, "template").where("doc > first").groupBy("doc", "number").agg(F.min("template").alias("template"))


def drop_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """docs with their text less recurring lines, and n_lines and n_dropped.

    Lines end at a line feed. A line without tokens is kept and counts for no
    template; null text stays null (0 lines), an empty text has one empty line.
    Rows of one id are one document; a row with a null id is left alone. The
    document with the smallest id keeps its lines of a template. Columns of docs
    named n_lines or n_dropped are replaced; an empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    gone = recurring_lines(keyed, min_documents, sent=sent).groupBy("doc").agg(F.collect_set("number").alias("__gone"))
    gone = materialize(gone.withColumnRenamed("doc", "__doc"), "dropped")
    # always a merge join, so that neither the plan nor a task's memory depends on how many lines go
    both = docs.join(gone.hint("merge"), F.col(id_col).cast("bigint") == F.col("__doc"), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    return both.withColumns(
        {text_col: text, "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("bigint"), "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint")}
    ).drop("__doc", "__gone")


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    rows = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
