"""Exact top-k search by inner product with a dual cover tree.

The tree is a table of nodes with parent, centre and covering radius. It is grown on
a bounded sample: a node that stands for more than LEAF rows is split by a net of
centres chosen farthest-first, so its depth grows with the number of rows, until it
has NODES nodes. Every row then descends to a leaf, nearest child by nearest child,
and a node's covering radius is taken over all rows below it, so the bounds hold for
every row, in the sample or not. A leaf beyond LEAF rows is a number of blocks.

Queries are indexed together with the data; the queries of a leaf are a group. For a
query group with centre p and radius r and a node with centre c and radius s no
product exceeds p.c + r|c| + s|p| + r s. A first pass holds each query against one
block, which gives each group its worst kth score. The second descends the tree with
all groups at once and drops the pairs of a group and a node whose bound does not
reach it; only queries are sent on, each once to every block that is left for it,
and a block hands back no product below the query's kth so far. Products are of
whole numbers and exact; bounds have a slack relative to their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows that the tree is grown on, at most; nodes, at most; children of a node; rows of a leaf, about; queries that meet a block at a time.
SAMPLE, NODES, CHILDREN, LEAF, QUERIES = 8_192, 512, 8, 4_096, 1_024
_SLACK = 1e-9
#: Greatest absolute component after scaling for which products of any length are added in 64 bits here.
_LARGE = 1 << 24


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[row, place] = flat
    return out


def net(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers of rows chosen farthest-first: every prefix covers the rest within its last gap."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < size and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    best = np.argmin(d, axis=1)
    return best, np.sqrt(((x - centres[best]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Tree:
    """Nodes from the root (0) on: centre, parent, first child and number of children (0: a leaf)."""

    centre: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.size == 0)

    def path(self, node: int) -> list[int]:
        out = [node]
        while self.parent[out[-1]] >= 0:
            out.append(int(self.parent[out[-1]]))
        return out

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child of each node on the way."""
        at = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.size[at] > 0)
            if not len(open_):
                return at
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                children = np.arange(self.first[node], self.first[node] + self.size[node])
                at[rows] = children[_nearest(x[rows], self.centre[children])[0]]


def grow(points: np.ndarray, rows: int, leaf: int = LEAF, nodes: int = NODES, children: int = CHILDREN) -> Tree:
    """A tree over a sample that stands for `rows` rows: the largest node is split first."""
    centre, parent, first, size, members = [points.mean(axis=0)], [-1], [0], [0], {0: np.arange(len(points))}
    while len(centre) + children <= nodes:
        node = max(members, key=lambda i: len(members[i]))
        own = members[node]
        if len(own) * rows <= leaf * len(points) or len(own) < 2 * children:
            break
        chosen = points[own][net(points[own], children)]
        part = _nearest(points[own], chosen)[0]
        del members[node]
        if len(chosen) == 1:  # all alike: stays a leaf
            if not members:
                break
            continue
        first[node], size[node] = len(centre), len(chosen)
        for i, c in enumerate(chosen):
            members[len(centre)] = own[part == i]
            centre.append(c)
            parent.append(node)
            first.append(0)
            size.append(0)
    return Tree(np.array(centre), np.array(parent), np.array(first), np.array(size))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component; vectors that are null or have null or non-finite components are left out.

    A component beyond the range of a long, or a null id, leaves its row out too.
    """
    x = F.transform(vector_col, lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale))
    rows = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(good)
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _whole(column, width: int) -> np.ndarray:
    """Vectors as rows of exact whole numbers: 64 bits, or Python's where products could be larger."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products: as doubles where those are exact, else in 64 bits, else as Python numbers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return q.astype(float) @ x.T.astype(float)
    if most < 1 << 63:
        return q @ x.T
    return q.astype(object) @ x.T.astype(object)


def _search(refs: pa.Table, queries: pa.Table, k: int, width: int) -> pa.Table:
    """Best k of a block for each query, by the block's own balls against each query's kth score so far."""
    order = np.argsort(refs["vec_id"].to_numpy(), kind="stable")  # so that ties fall to the smaller id
    x, ids = _whole(refs["v"], width)[order], refs["vec_id"].to_numpy()[order]
    near = x.astype(float)
    centres = near[net(near, max(1, int(len(x) ** 0.5) // 4))]
    ball, gap = _nearest(near, centres)
    radius = np.zeros(len(centres))
    np.maximum.at(radius, ball, gap)
    found = []
    for lo in range(0, queries.num_rows, 256):
        part = queries.slice(lo, 256)
        q, own, row_ = _whole(part["v"], width), part["query_id"].to_numpy(), part["row"].to_numpy()
        floor = [-np.inf if f is None else f for f in part["floor"].to_pylist()]
        length = np.linalg.norm(q.astype(float), axis=1)
        bound = q @ centres.T + radius * length[:, None]
        slack = _SLACK * length[:, None] * (np.linalg.norm(centres, axis=1) + radius) + 1
        live = bound + slack >= np.array(floor, float)[:, None]  # queries by balls
        rows = np.flatnonzero(live.any(axis=0)[ball])
        score = _products(q, x[rows])
        dead = (ids[rows][None, :] == own[:, None]) | ~live[:, ball[rows]]
        for i in range(len(own)):
            at = np.flatnonzero(~dead[i])
            best = at[np.argsort(-score[i, at], kind="stable")[:k]]
            found += [(int(row_[i]), int(ids[rows[j]]), int(score[i, j])) for j in best if score[i, j] >= floor[i]]
    kept = [f for f in found if -(1 << 63) <= f[2] < 1 << 63]
    if len(kept) < len(found):
        raise OverflowError("an inner product goes beyond a long")
    columns = zip(*found, strict=True) if found else ((), (), ())
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "vec_id", "score"])


_FOUND = "row bigint, vec_id bigint, score bigint"
_SENT = "row bigint, query_id bigint, v array<bigint>, floor bigint, block bigint"


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with any row of another id.

    vectors: (vec_id bigint, v array<bigint>), as whole_vectors gives them. Ties go
    to the smaller id. Every row counts: rows of one id are candidates each, and
    each query row has its own result; a shorter vector is filled with zeros; fewer
    rows give fewer ranks; no query or no row gives no result.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, width, n_queries = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(is_query)).first()
    if not n_queries or not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    tree = grow(_matrix(sample["v"], width), total)
    sent = spark.sparkContext.broadcast(tree)
    leaves = tree.leaves()
    paths = {int(leaf): tree.path(int(leaf)) for leaf in leaves}
    depth = max(map(len, paths.values()))

    def assign(batches):
        for b in batches:
            x, own = _matrix(b.column("v"), width), sent.value
            leaf = own.descend(x)
            gaps = np.zeros((len(x), depth))  # to the centre of each node on the way, from the leaf up
            for node in np.unique(leaf):
                at = np.flatnonzero(leaf == node)
                for i, up in enumerate(paths[int(node)]):
                    gaps[at, i] = np.sqrt(((x[at] - own.centre[up]) ** 2).sum(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * depth, pa.int32()), pa.array(gaps.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), lists], names=[*b.schema.names, "leaf", "gaps"])

    schema = "row bigint, vec_id bigint, v array<bigint>, leaf bigint, gaps array<double>"
    placed = materialize(rows.select("row", "vec_id", "v").mapInArrow(assign, schema), "placed")
    most = [F.max(F.get("gaps", F.lit(i))).alias(f"r{i}") for i in range(depth)]
    reach = F.max(F.when(is_query, F.get("gaps", F.lit(0)))).alias("reach")
    stats = {r.leaf: r for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), reach, *most).collect()}  # one row a leaf, at most NODES
    radius = np.full(len(tree.parent), -1.0)
    for leaf, r in stats.items():
        for i, node in enumerate(paths[leaf]):
            radius[node] = max(radius[node], r[f"r{i}"])
    # blocks are numbered through: those of a leaf follow one another
    parts = {leaf: -(-r.n // LEAF) for leaf, r in sorted(stats.items())}
    start = dict(zip(parts, np.cumsum([0, *parts.values()])[:-1].tolist(), strict=True))
    entry = lambda of: F.element_at(F.create_map(*[F.lit(int(x)) for p in of.items() for x in p]), F.col("leaf"))
    block = entry(start) + F.pmod(F.xxhash64("row"), entry(parts).cast("bigint"))
    refs = placed.select("vec_id", "v", block.alias("block"))
    queries = placed.where(is_query).select("row", F.col("vec_id").alias("query_id"), "v", F.col("leaf").alias("home"))
    norms = np.linalg.norm(tree.centre, axis=1)

    def meet(routed: DataFrame) -> DataFrame:
        """Every routed query with the rows of its block."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64())] * 3, names=["row", "vec_id", "score"])
            return _search(left, right, k, width)

        return refs.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(run, _FOUND)

    filled = np.array(sorted(stats))

    def first_block(batches):
        for b in batches:
            best = filled[np.argmax(_matrix(b.column("v"), width) @ sent.value.centre[filled].T, axis=1)]
            at = np.array([start[int(c)] + int(i) % parts[int(c)] for i, c in zip(b.column("row").to_numpy(), best, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("query_id"), b.column("v"), pa.nulls(b.num_rows, pa.int64()), pa.array(at)], names=["row", "query_id", "v", "floor", "block"])

    near = meet(queries.mapInArrow(first_block, _SENT))
    kth = near.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = queries.join(kth.select("row", F.when(F.col("n") >= k, F.col("least")).alias("floor")), "row", "left")
    known = materialize(known, "queries")
    worst = {r.home: r.worst for r in known.groupBy("home").agg(F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias("worst")).collect()}
    # both trees at once: pairs of a query group and a node, from the root down, while the bound reaches the group's worst kth score
    alive: dict[int, np.ndarray] = {}
    for home, least in worst.items():
        level, left = np.zeros(1, np.int64), []
        while len(level):
            r = stats[home].reach
            bound = tree.centre[level] @ tree.centre[home] + r * norms[level] + radius[level] * (norms[home] + r)
            slack = _SLACK * (norms[level] + radius[level]) * (norms[home] + r) + 1
            level = level[(radius[level] >= 0) & (bound + slack >= least)]
            left += level[tree.size[level] == 0].tolist()
            level = np.concatenate([np.zeros(0, np.int64), *(np.arange(tree.first[i], tree.first[i] + tree.size[i]) for i in level)])
        alive[home] = np.array(sorted(left), np.int64)

    def route(batches):
        for b in batches:
            x, home = _matrix(b.column("v"), width), b.column("home").to_numpy()
            floor = np.array([-np.inf if f is None else f for f in b.column("floor").to_pylist()], float)
            length = np.linalg.norm(x, axis=1)
            for group in np.unique(home):
                own, nodes = np.flatnonzero(home == group), alive[int(group)]
                bound = x[own] @ sent.value.centre[nodes].T + radius[nodes] * length[own][:, None]
                slack = _SLACK * length[own][:, None] * (norms[nodes] + radius[nodes]) + 1
                row, node = np.nonzero(bound + slack >= floor[own][:, None])
                n = np.array([parts[int(c)] for c in nodes[node]], np.int64)
                to = np.repeat([start[int(c)] for c in nodes[node]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(own[row], n)
                for lo in range(0, len(row), QUERIES):
                    part = b.take(pa.array(row[lo : lo + QUERIES]))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "query_id", "v", "floor")), pa.array(to[lo : lo + QUERIES].astype(np.int64))], names=["row", "query_id", "v", "floor", "block"])

    found = meet(known.select("row", "query_id", "v", "floor", "home").mapInArrow(route, _SENT))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(known.select("row", "query_id"), "row").select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """Each query's five best other vectors: queries are the rows whose vec_id is divisible by 50."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
