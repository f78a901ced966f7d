"""A corpus from raw documents to packed token windows, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.llm.common import materialize, table
from wavespark.llm.lines import drop_recurring_lines
from wavespark.llm.packing import pack
from wavespark.llm.simhash import drop_near_duplicates
from wavespark.llm.substring import remove_repeats
from wavespark.llm.toxicity import fit_toxicity, held_out, score_toxicity

#: Columns of documents that stages read or change; any other is handed through under a name that no operator uses.
OWN = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """of(docs) with the columns of docs, whatever their names: only those of OWN reach the operator as they are."""
    inside = {c: c if c in OWN else f"__own_{i}" for i, c in enumerate(docs.columns)}
    out = of(docs.select(*(F.col(f"`{c}`").alias(name) for c, name in inside.items())))
    return out.select(*(F.col(name).alias(c) for c, name in inside.items()))


def _with_text(rows: DataFrame, changed, text) -> DataFrame:
    """text, and n_chars if there is one, replaced where `changed` holds."""
    new = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in rows.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumns(new)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half, as they are.

    Null and empty texts have no toxic passage and stay; repeated rows are scored
    alike. Where labels teach nothing (none, or of one class), all stay.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out())
    return _apart(docs, lambda d: score_toxicity(d, model).where("score < 0.5"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of templates that recur across documents.

    A null text stays null; rows of one id count as one document; rows with a null
    id are left alone. n_chars follows the text where it changes.
    """

    def of(d: DataFrame) -> DataFrame:
        rows = drop_recurring_lines(d.withColumn("__before", F.col("text")))
        changed = F.col("n_dropped") > 0
        return _with_text(rows.withColumn("__kept", F.col("text")).withColumn("text", F.col("__before")), changed, F.col("__kept"))

    return _apart(docs, of)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as it is.

    Null and blank texts are one group; rows with a null id stay; all rows of an id
    stay or go together.
    """
    return _apart(docs, drop_near_duplicates)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of windows that a smaller document has; others keep their text as it is.

    Null and short texts stay as they are, as do rows with a null id; rows of one
    id are judged each by its own text.
    """
    return _apart(docs, lambda d: _with_text(remove_repeats(d), F.col("n_removed") > 0, F.col("kept_text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens.

    Every row is a document of its own; a null or empty text is the end id alone;
    a null id stays null. Other columns are left out.
    """
    pieces = pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The classifier and the packer can't be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
