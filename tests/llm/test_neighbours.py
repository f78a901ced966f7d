"""Approximate neighbours against all products: recall, exact scores, ties, copies, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.llm import neighbours as N
from wavespark.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


def write(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return sorted(map(tuple, QUERIES["op12_neighbours"](spark, str(folder)).select("query_id", "rank", "vec_id", "score").collect()))


def expected(rows, k=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    width = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, width - len(v)))) for i, v in rows]
    out = []
    for i, q in rows:
        if i % 20 == 0:
            best = sorted((-(q * v).sum(), j) for j, v in rows if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def recall(got, want):
    want = {(q, v) for q, _, v, _ in want}
    return len({(q, v) for q, _, v, _ in got} & want) / max(1, len(want))


def test_few_rows_are_found_whole_and_odd_rows_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(18)]
    odd = [(20, None), (40, []), (60, [0.0] * 5), (80, [1.0, None, 0.0, 0.0, 0.0]), (100, [float("nan")] * 5), (120, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5)]
    short = [(140, [1.0, 2.0]), (141, [0.5])]
    got, want = write(spark, tmp_path, rows + odd + short), expected(rows + odd + short)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)
    wide = SCHEMA + ", v int, cls int, q int, bucket int, score double"
    assert write(spark, tmp_path, [(*r, 1, 2, 3, 4, 0.5) for r in rows + odd + short], wide) == got
    assert write(spark, tmp_path, []) == [] == write(spark, tmp_path, [(1, [1.0]), (2, [2.0])])
    assert write(spark, tmp_path, [(20, [1.0, 1.0])]) == []


def test_copies_ties_and_repeated_rows(spark, tmp_path):
    """A third of all rows is one vector, another third differs from it by little; ties fall to the smaller id."""
    rng = np.random.default_rng(2)
    one = rng.integers(-3, 4, 8).astype(float).tolist()
    rows = [(i, one) for i in range(300)] + [(i, (np.array(one) + rng.integers(0, 2, 8) / 1024).tolist()) for i in range(300, 600)]
    rows += [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(600, 900)]
    rows += [(40, one)] * 30 + [(41, one)] * 3 + [(60, rows[700][1])]
    got, want = write(spark, tmp_path, rows), expected(rows)
    assert recall(got, want) >= 0.95
    exact = {(q, v): s for q, r, v, s in expected(rows, 2000)}
    by = {}
    for q, r, v, s in got:
        assert 60 in (q, v) or abs(exact[q, v] - s) <= 1e-12 * max(1, abs(s))  # 60 has two vectors
        by.setdefault(q, []).append((r, s, v))
    for q, found in by.items():
        assert q in (40, 60) or [r for r, _, _ in sorted(found)] == list(range(1, 21))
    of_one = [v for q, r, v, _ in got if q == 0]
    assert of_one == [v for q, r, v, _ in want if q == 0]


@pytest.mark.parametrize("kind", ["uniform", "clustered", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 24))
    if kind == "clustered":
        x = rng.standard_normal((150, 24))[rng.integers(0, 150, 6000)] + 0.25 * x
    if kind == "norms":
        x *= np.exp(rng.normal(0, 1.5, (6000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<double>")
    got = N.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    queries = np.arange(0, 6000, 20)
    score = x[queries] @ x.T
    score[np.arange(300), queries] = -np.inf
    want = {(int(q), int(v)) for q, row in zip(queries, np.argsort(-score, axis=1)[:, :20], strict=True) for v in row}
    assert len(got) == 6000 and len({(r.query_id, r.rank) for r in got}) == 6000
    assert len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9
    assert np.allclose([r.score for r in got], [x[r.query_id] @ x[r.vec_id] for r in got], rtol=1e-9)


def test_buckets_are_visited_in_order_of_their_chance():
    rng = np.random.default_rng(4)
    for d, success in ((0.3, 0.9), (1.1, 0.7), (1.4, 0.97)):
        place = rng.normal(0, 3, 3)
        cells = N.likeliest(place, d, 1.5, success)
        edge = lambda j, c: 0.5 * (1 + N._ERF((c - place[j]) * 1.5 / d / 2**0.5))
        chance = lambda cell: np.prod([edge(j, c + 1) - edge(j, c) for j, c in enumerate(cell)])
        own = np.floor(place).astype(int)
        every = sorted((-chance(c) for c in itertools.product(*(range(o - 8, o + 9) for o in own))), key=float)
        got = [-chance(c) for c in cells]
        assert np.allclose(got, every[: len(got)], atol=1e-12) and len({tuple(c) for c in cells}) == len(cells)
        assert -sum(got) >= success > -sum(got[:-1])


def test_a_crowded_bucket_is_split_and_its_queries_dealt(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 100)
    monkeypatch.setattr(N, "QUERIES", 7)
    rng = np.random.default_rng(5)
    x = np.concatenate([1 + 0.01 * rng.standard_normal((900, 6)), rng.standard_normal((600, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<double>")
    got = {(r.query_id, r.vec_id) for r in N.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()}
    score = x[::20] @ x.T
    score[np.arange(75), np.arange(0, 1500, 20)] = -np.inf
    want = {(i * 20, int(v)) for i, row in enumerate(np.argsort(-score, axis=1)[:, :20]) for v in row}
    assert len(got & want) / len(want) >= 0.9
