"""Approximate nearest neighbours with vantage-point trees, one per shard.

Equal vectors are one point that holds its least ids. Points are dealt over
shards by hash; a shard is a tree in which a node's vantage point parts the
others at their median distance to it. A query keeps its k nearest so far, at
most ``tau`` away, and leaves out a side of a node whose distance bound by the
triangle inequality exceeds ``factor * tau``. Factor 1 is exact search; a
smaller one visits less. All query vectors go to all shards, in blocks of
bounded size.

A query starts at the one leaf it falls into, so that ``tau`` is small before
the tree is walked. A shard's answer depends on the shard, the query and the
factor alone, so reruns agree however the shards are dealt.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duewatch.llm.shared import cut, map_batches

#: Points of a shard, points of a leaf, query vectors of a block, and of a walk through a tree.
SHARD, LEAF, BLOCK, WALK = 4096, 48, 16_384, 1024
#: Production factor: recall on unclustered vectors in 64 dimensions, where pruning is hardest, measures 0.99 and more.
FACTOR = 0.2


# Trees -----------------------------------------------------------------------------------------------------------

class Tree:
    """Nodes in preorder: points ``lo:hi``; an inner node's first point is its vantage point."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.points = ids[order], points[order]
        nodes: list[list[float]] = []  # lo, hi, middle (-1: leaf), largest inner distance, least outer distance, right child
        place = np.arange(len(ids))

        def grow(lo: int, hi: int) -> int:
            me = len(nodes)
            nodes.append([lo, hi, -1, 0.0, 0.0, -1])
            if hi - lo <= leaf:
                return me
            # The point farthest from the first one lies on the rim, where distances differ most.
            rim = lo + int(np.argmax(distances(self.points[place[lo:hi]], self.points[place[lo]])))
            place[lo], place[rim] = place[rim], place[lo]
            d = distances(self.points[place[lo + 1:hi]], self.points[place[lo]])
            by = np.argsort(d, kind="stable")
            place[lo + 1:hi] = place[lo + 1:hi][by]
            mid = lo + 1 + (hi - lo - 1) // 2
            nodes[me][2:5] = [mid, d[by[mid - lo - 2]], d[by[mid - lo - 1]]]
            grow(lo + 1, mid)
            nodes[me][5] = grow(mid, hi)
            return me

        if len(ids):
            grow(0, len(ids))
        self.ids, self.points = self.ids[place], self.points[place]
        self.nodes = np.array(nodes, np.float64).reshape(-1, 6)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, points=self.points, nodes=self.nodes)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            tree.ids, tree.points, tree.nodes = z["ids"], z["points"], z["nodes"]
        return tree


def distances(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences."""
    diff = points - other
    return np.sqrt(np.einsum("...i,...i->...", diff, diff))


class Nearest:
    """The k nearest of each query so far, ties to the smaller id; free places are infinitely far."""

    def __init__(self, n: int, k: int):
        self.far = np.full((n, k), np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def tau(self) -> np.ndarray:
        return self.far[:, -1]

    def add(self, rows: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (``far``, ``ids``: a row for each of ``rows``) that are not there yet."""
        far, ids = np.concatenate([self.far[rows], far], 1), np.concatenate([self.ids[rows], ids], 1)
        by = np.lexsort((ids, far), axis=1)[:, :self.far.shape[1]]
        self.far[rows], self.ids[rows] = np.take_along_axis(far, by, 1), np.take_along_axis(ids, by, 1)


class Walk:
    """Search of one tree for a block of queries, a node at a time for all queries that need it."""

    def __init__(self, tree: Tree, queries: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.factor = tree, queries, factor
        self.found = Nearest(len(queries), k)
        self.home = np.full(len(queries), -1)
        # Distances come from products first; what their rounding could hide is measured again by differences.
        self.square = np.einsum("ij,ij->i", queries, queries)
        self.points_square = np.einsum("ij,ij->i", tree.points, tree.points)
        self.slack = 1e-13 * queries.shape[1] * (self.square + self.points_square.max(initial=0))
        if len(tree.nodes) and len(queries):
            self._start(0, np.arange(len(queries)))
            self._visit(0, np.arange(len(queries)))

    def _leaf(self, lo: int, hi: int, rows: np.ndarray) -> None:
        tree, found = self.tree, self.found
        square = self.square[rows, None] + self.points_square[lo:hi] - 2 * self.queries[rows] @ tree.points[lo:hi].T
        near = square <= (found.tau[rows] ** 2 + self.slack[rows])[:, None]
        q, p = np.nonzero(near)
        if q.size:
            far = np.full(near.shape, np.inf)
            far[q, p] = distances(tree.points[lo + p], self.queries[rows[q]])
            some = np.flatnonzero(near.any(1))
            ids = np.where(near[some], tree.ids[lo:hi], np.iinfo(np.int64).max)
            found.add(rows[some], far[some], ids)

    def _start(self, node: int, rows: np.ndarray) -> None:
        """Each query's own leaf."""
        lo, hi, mid, inner, outer, right = self.tree.nodes[node]
        if mid < 0:
            self.home[rows] = node
            self._leaf(int(lo), int(hi), rows)
            return
        d = distances(self.queries[rows], self.tree.points[int(lo)])
        inside = d < (inner + outer) / 2
        for child, at in ((node + 1, rows[inside]), (int(right), rows[~inside])):
            if at.size:
                self._start(child, at)

    def _visit(self, node: int, rows: np.ndarray) -> None:
        lo, hi, mid, inner, outer, right = self.tree.nodes[node]
        if mid < 0:
            rows = rows[self.home[rows] != node]
            if rows.size:
                self._leaf(int(lo), int(hi), rows)
            return
        d = distances(self.queries[rows], self.tree.points[int(lo)])
        closer = d <= self.found.tau[rows]
        if closer.any():
            self.found.add(rows[closer], d[closer, None], np.full((int(closer.sum()), 1), self.tree.ids[int(lo)]))
        for child, bound in ((node + 1, d - inner), (int(right), outer - d)):
            reach = self.factor * self.found.tau[rows]  # smaller after the first side
            at = rows[~(bound > reach + 1e-12 * (1 + reach))]
            if at.size:
                self._visit(child, at)


def search(tree: Tree, queries: np.ndarray, k: int, factor: float) -> Nearest:
    parts = [Walk(tree, queries[i:i + WALK], k, factor).found for i in range(0, len(queries), WALK)]
    out = Nearest(len(queries), k)
    if parts:
        out.far, out.ids = np.concatenate([p.far for p in parts]), np.concatenate([p.ids for p in parts])
    return out


# Spark -----------------------------------------------------------------------------------------------------------

def points(vectors: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, points): valid rows (id, vec), and distinct vectors (point, ids, vec) with their k + 1 least ids.

    No query needs more ids of equal vectors than that. The least k + 1 are
    taken in each task before the shuffle, so a vector that a third of the
    rows share sends few rows. Rows without id, and vectors that are null,
    zero, or hold a null or non-finite component, take no part, nor does one
    whose length is not that of most (the shorter, if as many).
    """
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = "x is not null and not isnan(x) and abs(x) < double('infinity')"
    rows = rows.where(f"forall(vec, x -> {finite}) and exists(vec, x -> x != 0)").withColumn("dim", F.size("vec"))
    most = rows.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    rows = rows.where(F.col("dim") == (most["dim"] if most else 0)).drop("dim")
    first = Window.partitionBy("vec").orderBy("id")
    least = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    ids = F.sort_array(F.collect_set("id"))
    return rows, cut(least.groupBy("vec").agg(ids.alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "vec"), "points")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def trees(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, tree): written table of packed trees over about ``shard`` points each, dealt by the hash of the id."""
    shards = max(1, -(-found.count() // shard))

    def build(table: pa.Table) -> pa.Table:
        tree = Tree(table["point"].to_numpy(), _matrix(table["vec"]))
        return pa.table({"shard": table["shard"][:1], "tree": pa.array([tree.packed()], pa.binary())})

    dealt = found.select("point", "vec", F.pmod(F.xxhash64("point"), F.lit(shards)).alias("shard"))
    return cut(dealt.groupBy("shard").applyInArrow(build, "shard bigint, tree binary"), "trees")


def nearest_points(forest: DataFrame, queries: DataFrame, k: int, factor: float, block: int = BLOCK) -> DataFrame:
    """(query, point, far): the k nearest points of each query point (point, vec), over all shards.

    A block's query vectors go to the tasks as a broadcast of at most ``block``
    vectors; each task merges its shards' answers before they shuffle.
    """
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("point"), F.lit(blocks)))
    ctx, made = forest.sparkSession.sparkContext, None
    for part in range(blocks):
        rows = dealt.where(F.col("part") == part).select("point", "vec").toArrow()
        sent = ctx.broadcast((rows["point"].to_numpy(), _matrix(rows["vec"]) if rows.num_rows else np.empty((0, 0))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, vecs = sent.value
            best = Nearest(len(names), k)
            for b in batches:
                for packed in b.column("tree"):
                    found = search(Tree.unpacked(packed.as_py()), vecs, k, factor)
                    best.add(np.arange(len(names)), found.far, found.ids)
            q, r = np.nonzero(np.isfinite(best.far))
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(best.ids[q, r]), pa.array(best.far[q, r])],
                                             ["query", "point", "far"])

        answers = map_batches(forest.select("tree"), run, "query bigint, point bigint, far double")
        order = Window.partitionBy("query").orderBy("far", "point")
        answers = cut(answers.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), "nearest")
        sent.destroy()
        made = answers if made is None else made.unionByName(answers)
    return made


def neighbours(vectors: DataFrame, is_query, *, k: int = 10, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK,
               id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest rows of each row for which the condition ``is_query`` on ``id`` holds.

    Score is the Euclidean distance in double precision; ties go to the
    smaller id. A row is no neighbour of a row with its id; repeated rows of an
    id and vector are one. Fewer than k others: all of them. Rows that take no
    part: see :func:`points`. Other columns are not read. An empty table has
    no answers.
    """
    rows, found = points(vectors, k, id_col=id_col, vec_col=vec_col)
    asked = rows.where(is_query).distinct()
    # Distinct first: a vector that many queries share meets its point once.
    at = found.select("point", F.col("vec").alias("v"))
    asked = cut(asked.join(at, F.col("vec") == F.col("v")).select("id", "point", "vec"), "queries")
    near = nearest_points(trees(found, shard), asked.select("point", "vec").dropDuplicates(["point"]), k + 1, factor, block)
    ids = found.select("point", "ids")
    lists = (near.join(ids, "point").select("query", "far", F.explode("ids").alias("id"))
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("near")))
    answer = asked.select(F.col("id").alias("query_id"), F.col("point").alias("query")).join(lists, "query")
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    answer = answer.select("query_id", F.posexplode(mine).alias("at", "n"))
    return answer.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.far").alias("score"))
