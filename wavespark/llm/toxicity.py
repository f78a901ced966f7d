"""Toxic passages by maximum-scoring segments of token log-odds.

Training reads a bounded sample of labelled documents. A token's log-odds come
from a chain of Dirichlet priors: the class rate of a word has as its prior mean
the rate of its first five bytes, that of its first four, and so on, up to the
rate over all tokens; so rare words borrow from their stems. Counts live in a
fixed number of hash buckets, so the model has the same size at any scale.

Scoring is narrow. Ruzzo and Tompa's linear scan finds every maximal segment of
log-odds less a drift; with the Karlin-Altschul parameters of non-toxic documents
a segment of score s in n tokens has the expectation K n exp(-lambda s). The log
evidence of the best segment and of every further significant one is added and
mapped to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, materialize, table
from .textbytes import WORD_LIKE, Hasher, chunks, spans

#: Labelled rows a model is fitted on at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 17
#: Bytes of a token that each level looks at; the last is the whole token.
LEVELS = (3, 4, 5, 1 << 30)
STRENGTH, DRIFT, SIGNIFICANT = 12.0, 1.0, 0.01
#: Bound of the parameter K from below.
_LEAST_K = 1e-6
#: The score of every document, at most, where labels teach nothing.
BLIND = 0.25


@dataclass(frozen=True)
class ToxicityModel:
    log_odds: list[np.ndarray]  # of each level, None but for the last, which holds all
    prior: float
    lam: float
    k: float
    slope: float
    intercept: float


def _buckets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, last row + 1, first word of each row, bucket of each word by level)."""
    import pyarrow.compute as pc

    for lo, hi, data, offsets in chunks(pc.utf8_lower(texts)):
        starts, ends, first = spans(data, offsets, WORD_LIKE)
        hasher = Hasher(data)
        levels = [(hasher(starts, np.minimum(ends, starts + n)) & np.uint64(BUCKETS - 1)).astype(np.int64) for n in LEVELS]
        yield lo, hi, first, levels


def _counts(docs: DataFrame) -> DataFrame:
    """level, bucket, and in how many documents of each class it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) == 1
            total = np.zeros((len(LEVELS), BUCKETS, 2), np.int64)
            for lo, _, first, levels in _buckets(b.column("text")):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for i, at in enumerate(levels):
                    once = np.unique(row * BUCKETS + at)
                    np.add.at(total[i], (once % BUCKETS, toxic[lo + once // BUCKETS].astype(np.int64)), 1)
            level, bucket = np.nonzero(total.sum(axis=2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (level, bucket, total[level, bucket, 0], total[level, bucket, 1])], names=["level", "bucket", "neg", "pos"]
            )

    rows = docs.select("text", "toxic").mapInArrow(count, "level bigint, bucket bigint, neg bigint, pos bigint")
    return rows.groupBy("level", "bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def _rates(counts: pd.DataFrame) -> tuple[np.ndarray, float]:
    table_ = np.zeros((len(LEVELS), BUCKETS, 2))
    table_[counts["level"], counts["bucket"], 0] = counts["neg"]
    table_[counts["level"], counts["bucket"], 1] = counts["pos"]
    whole = table_[-1].sum(axis=0)
    return table_, float((whole[1] + 0.5) / (whole.sum() + 1.0))


def _scores(levels: list[np.ndarray], model: ToxicityModel) -> np.ndarray:
    rate = np.full(len(levels[0]), model.prior)
    for at, both in zip(levels, model.log_odds, strict=True):
        c = both[at]
        rate = (c[:, 1] + STRENGTH * rate) / (c.sum(axis=1) + STRENGTH)
    return np.log(rate / (1 - rate)) - np.log(model.prior / (1 - model.prior)) - DRIFT


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one document, by Ruzzo and Tompa.

    A list of disjoint candidates holds for each the sums before (left) and up to its
    end (right), and a link to the nearest earlier one with a smaller left sum. A new
    one joins that candidate if its own right sum is larger; all between go with it.
    A search follows links only, and what it passes is behind the new one's own link,
    so no link is followed twice and the scan is linear.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    starts, ends, lefts, rights, links = [], [], [], [], []
    at = np.flatnonzero(score > 0)
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, j = i, len(starts) - 1
        while j >= 0 and lefts[j] >= left:
            j = links[j]
        while j >= 0 and rights[j] < right:
            start, left, link = starts[j], lefts[j], links[j]
            del starts[j:], ends[j:], lefts[j:], rights[j:], links[j:]
            j = link
        starts.append(start)
        ends.append(i + 1)
        lefts.append(left)
        rights.append(right)
        links.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(starts, ends, lefts, rights, strict=True)]


def _evidence(segments: list, n: int, model: ToxicityModel) -> tuple[float, list]:
    """Log evidence of a document and its significant segments."""
    if not segments or not n:
        return -np.log(model.k * max(n, 1)), []
    log_e = [np.log(model.k * n) - model.lam * s for _, _, s in segments]
    best = int(np.argmin(log_e))
    kept = [(a, b, s, e) for (a, b, s), e in zip(segments, log_e, strict=True) if e < np.log(SIGNIFICANT)]
    return -log_e[best] + sum(-e for i, e in enumerate(log_e) if i != best and e < np.log(SIGNIFICANT)), kept


def _parts(texts: pa.Array, model: ToxicityModel) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, last row + 1, token scores of each) of parts of a batch."""
    for lo, hi, first, levels in _buckets(texts):
        score = _scores(levels, model)
        yield lo, hi, [score[first[i] : first[i + 1]] for i in range(hi - lo)]


def _documents(texts: pa.Array, model: ToxicityModel) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, tokens in _parts(texts, model):
        yield from zip(range(lo, hi), tokens, strict=True)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most `rows` labelled documents for which the condition `train` on doc_id holds.

    Only text and toxic are learned from. Repeated labels of a document count as
    toxic if one of them says so; of several rows of one id the least text counts;
    null labels and null ids are ignored. With no
    labelled document, or with one class only, nothing can be told apart: every score
    is the class rate, but at most BLIND, so that nothing is predicted toxic.
    """
    spark = docs.sparkSession
    sample = (
        labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(train)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    known = materialize(known.select("text", "toxic"), "toxic-train")
    counts, prior = _rates(_counts(known).toPandas())
    model = ToxicityModel(list(counts), min(max(prior, 1e-3), 1 - 1e-3), 1.0, 1.0, 1.0, 0.0)
    sent = spark.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The histogram of token scores of class 0."""
        for b in batches:
            own, total = sent.value, np.zeros(401, np.int64)
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for i, score in _documents(b.column("text"), own):
                if toxic[i] != 1:
                    total += np.bincount(np.clip(np.rint(score * 20) + 200, 0, 400).astype(int), minlength=401)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    hist = known.mapInArrow(moments, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    lam = _decay((hist["at"].to_numpy() - 200) / 20, hist["n"].to_numpy())
    model = ToxicityModel(model.log_odds, model.prior, lam, 1.0, 1.0, 0.0)
    sent2 = spark.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_ = []
            for i, score in _documents(b.column("text"), sent2.value):
                segments = maximal_segments(score)
                least = max(1.0, np.log(max(len(score), 1)) + np.log(_LEAST_K / SIGNIFICANT))  # none below is significant for any k
                rows_.append((i, len(score), [s for _, _, s in segments if s * lam > least]))
            toxic = b.column("toxic").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([toxic[i] for i, _, _ in rows_], pa.int64()), pa.array([n for _, n, _ in rows_], pa.int64()), pa.array([s for _, _, s in rows_], pa.list_(pa.float64()))],
                names=["toxic", "n", "s"],
            )

    seen = known.mapInArrow(best, "toxic bigint, n bigint, s array<double>").toPandas()
    clean = seen[(seen["toxic"] != 1) & (seen["n"] > 0)]
    top = clean["s"].map(lambda s: max(s, default=0.0)).to_numpy(float)
    # n K exp(-lambda M) is exponential with mean 1 where nothing is toxic
    k = len(clean) / max(float((clean["n"].to_numpy() * np.exp(-lam * top)).sum()), 1e-12) if len(clean) else 1.0
    model = ToxicityModel(model.log_odds, model.prior, lam, float(np.clip(k, _LEAST_K, 1e3)), 1.0, 0.0)
    x = np.array([_evidence([(0, 0, v) for v in s], n, model)[0] for s, n in zip(seen["s"], seen["n"], strict=True)])
    slope, intercept = _logistic(x, (seen["toxic"] == 1).to_numpy(float), model.prior)
    return ToxicityModel(model.log_odds, model.prior, lam, model.k, slope, intercept)


def _decay(score: np.ndarray, n: np.ndarray) -> float:
    """The positive lambda with mean exp(lambda score) = 1, by bisection."""
    if not len(score) or not (score > 0).any() or (score * n).sum() >= 0:
        return 1.0
    weight, lo, hi = n / n.sum(), 1e-4, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (weight * np.exp(mid * score)).sum() < 1 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a probability over x, lightly regularized."""
    if not len(x) or y.min() == y.max():
        rate = min(prior, BLIND)
        return 0.0, float(np.log(rate / (1 - rate)))
    x, w = np.clip(x, -30, 60), np.array([0.1, 0.0])
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, a.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.0), float(w[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score (0 to 1) and passages: array of (start, end, score), in tokens, of every significant one.

    A null or empty text has no passage and the score that no evidence gives.
    Rows, repeated or not, are kept as they are; a column of docs that is named
    score or passages is replaced.
    """
    docs = docs.drop("score", "passages")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            for lo, hi, tokens in _parts(b.column("text"), own):  # each part is handed on at once, so no whole batch is held twice
                scores, found = np.zeros(hi - lo), []
                for i, score in enumerate(tokens):
                    x, kept = _evidence(maximal_segments(score), len(score), own)
                    scores[i] = 1 / (1 + np.exp(-np.clip(own.slope * np.clip(x, -30, 60) + own.intercept, -30, 30)))
                    found.append([{"start": s, "end": e, "score": v} for s, e, v, _ in kept])
                columns = b.slice(lo, hi - lo).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(found, passage)], names=[*b.schema.names, "score", "passages"])

    more = T.StructType.fromDDL("score double, passages array<struct<start:int,end:int,score:double>>")
    schema = T.StructType([*docs.schema.fields, *more.fields])
    return docs.mapInArrow(run, schema)


def held_out(col: str = "doc_id") -> Column:
    return fold_of(F.col(col), 5) == 0


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "passages"
    )
