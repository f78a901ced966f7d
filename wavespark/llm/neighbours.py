"""Approximate nearest neighbours by inner product: multiprobe hashing with p-stable projections.

Vectors are taken apart by norm: those of a band have norms in [M/2, M). With one more
component, sqrt(1 - (|x|/M)^2), x/M has length one, and so has q/|q| with a zero, and
their squared distance is 2 - 2 q.x / (|q| M): the nearest vector has the largest inner
product. A table's hash of a vector is the cells of some Gaussian (2-stable)
projections, and equal hashes are a bucket.

For a query with a known lower bound of its kth score, a vector of that score lies at a
known distance d, and its projection lies around the query's with deviation d. So each
bucket has an estimated chance to hold it, the product of those of its cells. A query
visits its own and the perturbed buckets from the likeliest on, until their chances sum
to the wanted success of the table, in each band that can reach the score. The bound
first comes from a bounded sample, then from what a first, short visit found.

Candidates of all tables are scored exactly, in double precision, on the original
vectors. Equal vectors are one class with its smallest ids, so copies cost nothing. A
bucket with more rows than a block is split, and the queries of a block are dealt to as
many tasks as they need; no row and no visit is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, erf, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .textbytes import mix

#: Tables; width of a cell; chance with which all tables together hold a vector of the kth score; that of the first visit.
TABLES, WIDTH, SUCCESS, FIRST = 3, 1.5, 0.95, 0.3
#: Rows of the sample for first bounds; wanted rows of a bucket; visits per table that functions are chosen for.
SAMPLE, BUCKET, VISITS = 1_024, 512, 2_048
#: Rows and queries that meet in one task, at most about; cells looked at on each side of a query's own.
LEAF, QUERIES, SIDE = 8_192, 16_384, 8
#: Entropy of a Gaussian's cells is log2(_SPREAD deviation / width).
_SPREAD = (2 * np.pi * np.e) ** 0.5
_ERF = np.vectorize(erf, otypes=[float])


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths without overflow before the end; beyond the doubles they are the largest one."""
    most = np.abs(x).max(axis=1, initial=0)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.minimum(np.where(most > 0, most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1)), 0), np.finfo(float).max)


def _band(norm: np.ndarray) -> np.ndarray:
    """b with norm in [2^(b-1), 2^b)."""
    return np.frexp(norm)[1]


@dataclass(frozen=True)
class Hashes:
    """Projections of all tables and the number of functions that each band uses."""

    matrix: np.ndarray  # [tables, width + 1, functions]
    offset: np.ndarray  # [tables, functions]
    functions: dict[int, int]
    cell: float

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        """Projections in cells, [rows, functions]."""
        return (x @ self.matrix[t]) / self.cell + self.offset[t]

    def bucket(self, cells: np.ndarray, band: int, t: int) -> np.ndarray:
        """A number for each row of cells of one band and table."""
        h = np.full(cells.shape[:-1], np.uint64((band + 4096) * TABLES + t))
        for j in range(cells.shape[-1]):
            h = mix(h) + cells[..., j].astype(np.int64).view(np.uint64)
        return mix(h).view(np.int64)

    def buckets_of(self, x: np.ndarray) -> np.ndarray:
        """[rows, tables]: the buckets that vectors lie in."""
        norm = _norms(x)
        band = _band(norm)
        share = np.ldexp(x, -band[:, None])
        whole = np.concatenate([share, np.sqrt(np.maximum(0, 1 - (share**2).sum(axis=1)))[:, None]], axis=1)
        out = np.zeros((len(x), len(self.matrix)), np.int64)
        for b, m in self.functions.items():
            own = np.flatnonzero(band == b)
            for t in range(len(self.matrix)):
                out[own, t] = self.bucket(np.floor(self.places(whole[own], t)[:, :m]).astype(np.int64), b, t)
        return out


def likeliest(place: np.ndarray, d: float, cell: float, success: float) -> np.ndarray:
    """Cells around the place of one query, likeliest first, until their chances sum to `success`: [visits, functions].

    The product of independent chances: the best P of all functions are among the best
    P of the functions so far times the cells of the next; P is doubled until it does.
    """
    own = np.floor(place)
    edges = own[:, None] + np.arange(-SIDE, SIDE + 2) - place[:, None]
    below = 0.5 * (1 + _ERF(edges * (cell / max(d, 1e-6) / 2**0.5)))
    chance = np.diff(below, axis=1)
    order = np.argsort(-chance, axis=1, kind="stable")[:, : int((chance > 1e-6).sum(axis=1).max())]
    chance, shift = np.take_along_axis(chance, order, axis=1), order - SIDE
    count = 256
    while True:
        p, cells = np.ones(1), np.zeros((1, 0), np.int64)
        for j in range(len(place)):
            product = (p[:, None] * chance[j]).ravel()
            if len(product) > count:
                best = np.argpartition(-product, count)[:count]
                best = best[np.argsort(-product[best], kind="stable")]
            else:
                best = np.argsort(-product, kind="stable")
            p, cells = product[best], np.concatenate([cells[best // chance.shape[1]], shift[j][best % chance.shape[1]][:, None]], axis=1)
        total = np.cumsum(p)
        if total[-1] >= success or len(p) < count:
            return (own + cells[: int(np.searchsorted(total, success)) + 1]).astype(np.int64)
        count *= 4


def visits(hashes: Hashes, q: np.ndarray, floor: np.ndarray, success: float) -> tuple[np.ndarray, np.ndarray]:
    """(query number, bucket) of all visits of some queries, whose kth score is `floor` at least."""
    norm = _norms(q)
    unit = np.concatenate([q / norm[:, None], np.zeros((len(q), 1))], axis=1)
    each = 1 - (1 - success) ** (1 / len(hashes.matrix))
    who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(len(hashes.matrix)):
        place = hashes.places(unit, t)
        for b, m in hashes.functions.items():
            with np.errstate(over="ignore", invalid="ignore"):
                share = np.nan_to_num(floor / norm * 2.0**-b, nan=-1.0)
            for i in np.flatnonzero(share <= 1):
                cells = likeliest(place[i, :m], (2 - 2 * max(share[i], -1.0)) ** 0.5, hashes.cell, each)
                who.append(np.full(len(cells), i))
                where.append(hashes.bucket(cells, b, t))
    return np.concatenate(who), np.concatenate(where)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def meet(refs: pa.Table, queries: pa.Table, k: int, width: int) -> pa.Table:
    """(q, cls, first, score): the k best classes of a block in the buckets that each query visits, none below its bound."""
    names = ["q", "cls", "first", "score"]
    if not refs.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
    x, bucket = _matrix(refs["v"], width), refs["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    lists = queries["buckets"].combine_chunks()
    y, floor = _matrix(queries["v"], width), queries["floor"].to_numpy()
    floor = floor - 1e-9 * np.maximum(1e-300, np.abs(floor))
    size = np.diff(lists.offsets.to_numpy())
    visitor, visited = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
    by = np.argsort(visited, kind="stable")
    visitor, visited = visitor[by], visited[by]
    rows, columns = [], []
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    lo, hi = np.searchsorted(visited, bucket[starts], "left"), np.searchsorted(visited, bucket[starts], "right")
    for a, e, i, j in zip(starts, np.append(starts[1:], len(bucket)), lo, hi, strict=True):
        own = order[a:e]
        for c in range(i, j, 1024):
            who = visitor[c : min(c + 1024, j)]
            with np.errstate(over="ignore", invalid="ignore"):
                row, column = np.nonzero(~(y[who] @ x[own].T < floor[who][:, None]))
            rows.append(who[row])
            columns.append(own[column])
    row, column = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *columns])
    # the products again, each summed alike wherever it is computed
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.concatenate([np.zeros(0), *((y[row[c : c + 65536]] * x[column[c : c + 65536]]).sum(axis=1) for c in range(0, len(row), 65536))])
    first, cls = refs["first"].to_numpy(), refs["cls"].to_numpy()
    best = np.lexsort((cls[column], first[column], -score, row))
    row, column, score = row[best], column[best], score[best]
    once = np.append(True, (row[1:] != row[:-1]) | (cls[column[1:]] != cls[column[:-1]]))[: len(row)]  # several tables' buckets may have it
    row, column, score = row[once], column[once], score[once]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table([pa.array(queries["q"].to_numpy()[row[kept]]), pa.array(cls[column[kept]]), pa.array(first[column[kept]]), pa.array(score[kept])], names=names)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) without null ids and null, empty or zero vectors, and those with null or non-finite components."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of each query with rows of other ids.

    vectors: (vec_id bigint, v array<double>), as usable_vectors gives them. Ties go to
    the smaller id. Rows of one id are candidates each; a query id of several vectors
    has a result for each of them. Shorter vectors are filled with zeros. A query finds
    all rows if they are no more than k; no query or no row gives no result.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # classes of equal vectors with their k + 1 smallest ids: any query's k best rows are among those of its k + 1 best classes
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2")]
    ids = materialize(vectors.groupBy(*same, "vec_id").agg(F.count("*").alias("n"), F.first("v").alias("v"), F.max(is_query).alias("asks")), "ids")
    smallest = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = ids.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    entry = F.struct("vec_id", F.least("n", F.lit(k)).alias("n"))
    classes = kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.array_sort(F.collect_list(entry)).alias("ids"))
    asking = ids.where("asks").groupBy("h1", "h2").agg(F.lit(True).alias("asks"))
    classes = materialize(classes.join(asking, ["h1", "h2"], "left").withColumn("cls", F.monotonically_increasing_id()), "classes")
    total, width, n_queries = classes.agg(F.count("*"), F.max(F.size("v")), F.count("asks")).first()
    if not total or not n_queries:
        return empty
    own = F.col("asks").isNotNull()

    sample = _matrix(classes.orderBy(F.xxhash64("cls")).limit(max(64, min(SAMPLE, (1 << 22) // width))).select("v").toArrow()["v"], width)

    def bands(batches):
        for b in batches:
            found, n = np.unique(_band(_norms(_matrix(b.column("v"), width))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n)], names=["band", "n"])

    counts = {r.band: r.n for r in classes.select("v").mapInArrow(bands, "band int, n bigint").groupBy("band").agg(F.sum("n").alias("n")).collect()}  # no more than exponents of doubles
    with np.errstate(over="ignore", invalid="ignore"):
        scores = np.sort(sample @ sample.T, axis=1)[:, ::-1][:, min(k + 1, len(sample) - 1)] / _norms(sample)
    most = max(counts)
    typical = float(np.median(np.sqrt(np.clip(2 - 2 * np.nan_to_num(scores) * 2.0**-most, 0.01, 4))))
    reach = max(1, int(log(VISITS) / log(max(1.2, _SPREAD * typical / WIDTH))))
    functions = {b: max(1, min(reach, int(log2(max(1, n / BUCKET)) / log2(_SPREAD / WIDTH)))) for b, n in sorted(counts.items())}
    rng = np.random.default_rng(12)
    widest = max(functions.values())
    hashes = Hashes(rng.standard_normal((TABLES, width + 1, widest)), rng.random((TABLES, widest)), functions, WIDTH)
    sent, seen = spark.sparkContext.broadcast(hashes), spark.sparkContext.broadcast(sample)

    def index(batches):
        for b in batches:
            at = sent.value.buckets_of(_matrix(b.column("v"), width))
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(at[:, t].copy()), *(b.column(c) for c in ("cls", "first", "v"))], names=["bucket", "cls", "first", "v"])

    rows = classes.select("cls", "first", "v").mapInArrow(index, "bucket bigint, cls bigint, first bigint, v array<double>")
    filled = materialize(rows.groupBy("bucket").agg(F.ceil(F.count("*") / LEAF).alias("parts")), "buckets")
    blocks = ceil(total * TABLES / LEAF)
    block = F.when(F.col("parts") > 1, F.xxhash64("bucket", "part")).otherwise(F.pmod("bucket", F.lit(blocks)))
    split = filled.where("parts > 1").withColumnRenamed("bucket", "large")
    refs = rows.join(split, rows.bucket == split.large, "left").withColumn("part", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))))
    refs = refs.select(block.alias("block"), "bucket", "cls", "first", "v")

    def bounds(batches):
        for b in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                scores = _matrix(b.column("v"), width) @ seen.value.T
            floor = np.sort(scores, axis=1)[:, -k - 1] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), pa.array(np.nan_to_num(floor, nan=-np.inf))], names=["q", "v", "floor"])

    queries = classes.where(own).select(F.col("cls").alias("q"), "v").mapInArrow(bounds, "q bigint, v array<double>, floor double")

    def probes(success: float):
        def run(batches):
            for b in batches:
                q, floor, id_ = _matrix(b.column("v"), width), b.column("floor").to_numpy(), b.column("q").to_numpy()
                for lo in range(0, len(q), 64):
                    who, where = visits(sent.value, q[lo : lo + 64], floor[lo : lo + 64], success)
                    for c in range(0, len(who), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(id_[lo + who[c : c + (1 << 16)]]), pa.array(where[c : c + (1 << 16)])], names=["q", "bucket"])

        return run

    def visit(asked: DataFrame, success: float) -> DataFrame:
        """What queries find in the buckets that hold their kth score with this chance."""
        routed = asked.select("q", "v", "floor").mapInArrow(probes(success), "q bigint, bucket bigint").join(filled, "bucket")
        routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        return met(asked, refs, routed.groupBy("q", block.alias("block")).agg(F.collect_set("bucket").alias("buckets")))

    def met(asked: DataFrame, refs: DataFrame, routed: DataFrame) -> DataFrame:
        """The products of queries with the rows of the blocks that they are routed to; many queries of a block are dealt to tasks."""
        routed = materialize(routed, "visits")
        dealt = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("deals"))
        left = refs.join(dealt, "block").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)))
        right = routed.join(dealt, "block").withColumn("deal", F.pmod(F.xxhash64("q"), "deals")).join(asked.select("q", "v", "floor"), "q")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return meet(a, b, k + 1, width)

        both = left.drop("deals").groupBy("block", "deal").cogroup(right.drop("deals").groupBy("block", "deal"))
        return materialize(both.applyInArrow(run, "q bigint, cls bigint, first bigint, score double"), "found")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
        return found.groupBy("q", "cls", "first").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)

    queries = materialize(queries, "queries")
    first = visit(queries, FIRST)
    kth = best(first).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") > k)
    queries = materialize(queries.join(kth, "q", "left").select("q", "v", F.greatest("floor", F.coalesce("kth", "floor")).alias("floor")), "queries")
    found = materialize(best(first.unionByName(visit(queries, SUCCESS))), "best")
    enough = min(k + 1, total)
    short = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    short = queries.join(short, "q", "left_anti")
    if not short.isEmpty():  # the rest of few rows: these queries meet all, block by block
        short, few = materialize(short.withColumn("floor", F.lit(float("-inf"))), "short"), ceil(total / LEAF)
        every = classes.select(F.pmod(F.xxhash64("cls"), F.lit(few)).alias("block"), F.lit(0).cast("bigint").alias("bucket"), "cls", "first", "v")
        routed = short.select("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(few - 1).cast("bigint"))).alias("block"), F.array(F.lit(0).cast("bigint")).alias("buckets"))
        found = materialize(best(found.drop("place").unionByName(met(short, every, routed))), "best")
    lists = found.join(classes.select("cls", "ids"), "cls").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # k + 1 classes at most
    asked = ids.where("asks").join(classes.where(own).select("h1", "h2", F.col("cls").alias("q")), ["h1", "h2"]).select("q", "n", F.col("vec_id").alias("query_id"))
    asked = asked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    rows = asked.join(lists, "q")
    one = F.transform("found", lambda f: F.flatten(F.transform(f["ids"], lambda i: F.array_repeat(F.struct((-f["score"]).alias("score"), i["vec_id"].alias("vec_id")), i["n"].cast("int")))))
    other = F.slice(F.array_sort(F.filter(F.flatten(one), lambda e: e["vec_id"] != F.col("query_id"))), 1, k)
    rows = rows.select("query_id", F.posexplode(other).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.score")).alias("score"))


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """About twenty nearest other vectors of each row whose vec_id is divisible by 20."""
    vectors = usable_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)
