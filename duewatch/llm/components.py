"""Connected components by alternating large-star and small-star rounds, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewatch.llm.shared import cut, map_batches, uncut

BLOCK = 1 << 17


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) of each component of the links ``a``, ``b``: as many as there are other nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:a.size], at[a.size:]
    least = np.arange(nodes.size)
    while True:
        lo, hi = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        if np.array_equal(lo, hi):
            break
        np.minimum.at(least, hi, lo)
        while not np.array_equal(least, least[least]):
            least = least[least]
    other = np.flatnonzero(least != np.arange(nodes.size))
    return nodes[other], nodes[least[other]]


def _thinned(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` in blocks of BLOCK links, each as its forest: a family of near copies has many links and few nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def thin() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > BLOCK:
                yield thin()
                held, size = [], 0
        if size:
            yield thin()

    return map_batches(edges.select("a", "b").coalesce(-(-count // BLOCK)), run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of ``links`` (a, b): the smallest id reachable by links.

    Blocks of links are replaced by their forests first, each block by itself;
    the forest of a single block is the result.
    Every round is two equi-joins with a min per node; the mins are combined in
    each task before they shuffle and a hub's edges are split by adaptive
    execution. A round's edges are a written table. Rounds grow with the
    logarithm of the longest chain. Ends must not be null; loops are allowed.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "edges")
    state = _state(edges)
    done = edges.schema["a"].dataType.simpleString() != "bigint"
    while state[0] and not done:
        blocks = -(-state[0] // BLOCK)
        before, edges = edges, cut(_thinned(edges, state[0]), "edges")
        uncut(before)
        state = _state(edges) if blocks > 1 else (0,)
        done = state[0] > BLOCK
    while state[0]:
        # Large star: every larger neighbour of a node is tied to the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        # Small star: a node's smaller neighbours, and itself, are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, edges = edges, cut(small, "edges")
        uncut(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
