"""Prefix trie of conversations by range minima over sorted common-prefix lengths.

Conversations are sorted as sequences of turn digests, so the members of a
prefix stand side by side. In a block of the sorted order, a sparse table holds
the minima of the neighbours' common-prefix lengths (LCPs) over all runs of
2**k places. A candidate prefix, the first d turns of a conversation, searches
its left and its right extent by halving steps on that table, without a stack
and independently of all others; equal extents and depths are one node. Members, leaves
and savings of a subtree are then differences of running sums.

A node that holds the first or last conversation of its block may go on in the
next one. Those edge nodes, two short chains a block, leave the block with
partial values and a digest of their prefix, and are added up by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duewatch.llm.shared import cut, map_batches

WORD = "[^\\x20\\x09-\\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv, turns array<struct<place, digest, words>>): a row per conversation, turns in order.

    Turns are ordered by turn (null first), then role, then text, so ties have
    one order; repeated rows are turns of their own. Null roles and texts are
    empty; rows without a conversation id take no part; other columns are not
    read. Texts stay in the sorting rows, which spill: a conversation's array
    holds 16 bytes and a word count for each turn.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.select("conv", F.row_number().over(order).alias("place"), F.unhex(F.md5(said)).alias("digest"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("turns"))


def with_shared_openings(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c opens as conversation c - c % ``group`` does.

    Its first h = crc32(c) % ``most`` turns are that conversation's first h
    (all if it has fewer, none if there is none); its own turns after its
    first h follow.
    """
    c = F.col("conv")
    heads = convs.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(c.cast("string")) % most).cast("int")
    joined = convs.join(heads, c - c % group == F.col("base"), "left").withColumn("h", h)
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    head = F.expr("slice(coalesce(head, slice(turns, 1, 0)), 1, h)")
    return joined.select("conv", F.concat(head, own).alias("turns"))


# Blocks ----------------------------------------------------------------------------------------------------------

def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of ``values[j : j + 2**k]`` at j."""
    levels = [values]
    while (half := 1 << (len(levels) - 1)) * 2 <= values.size:
        last = levels[-1]
        levels.append(np.minimum(last[:last.size - half], last[half:]))
    return levels


def range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of the values at lo..hi, inclusive, by two overlapping runs."""
    k = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(lo.size, levels[0].dtype)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][lo[at]], levels[level][hi[at] - (1 << int(level)) + 1])
    return out


def extents(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the run around ``at`` in which neighbours share ``depth`` turns or more."""
    left, right = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        level, step = levels[k], 1 << k
        if not level.size:
            continue
        to = left - step
        left = np.where((to >= 0) & (level[np.maximum(to, 0)] >= depth), to, left)
        go = (right < level.size) & (level[np.minimum(right, level.size - 1)] >= depth)
        right = np.where(go, right + step, right)
    return left, right


def common_lengths(digests: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the next one; ``digests``: the turns of all, one after the other."""
    most = np.minimum(sizes[:-1], sizes[1:])
    run = np.cumsum(most) - most
    step = np.arange(int(most.sum())) - np.repeat(run, most)
    same = digests[np.repeat(starts[:-1], most) + step] == digests[np.repeat(starts[1:], most) + step]
    out = most.copy()
    owner = np.repeat(np.arange(most.size), most)
    unlike = np.flatnonzero(~same)
    np.minimum.at(out, owner[unlike], step[unlike])
    return out


FIELDS = {"edge": pa.bool_(), "block": pa.int64(), "key": pa.binary(), "parent_key": pa.binary(), "depth": pa.int64(),
          "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
          "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "words": pa.int64(),
          "side": pa.int32(), "whole": pa.bool_(), "ends": pa.binary(), "first_end": pa.int64()}
SCHEMA = ("edge boolean, block bigint, key binary, parent_key binary, depth bigint, conv_id bigint, parent_conv_id bigint,"
          " n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, words bigint,"
          " side int, whole boolean, ends binary, first_end bigint")


def _chain(digests: np.ndarray) -> list[bytes]:
    """Digests of the prefixes of 0, 1, ... turns."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in digests:
        h.update(d.tobytes())
        out.append(h.copy().digest())
    return out


def block_nodes(block: int, convs: np.ndarray, digests: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Nodes of one block of sorted conversations: whole ones, and partial ones on its two edges."""
    m = convs.size
    starts = np.cumsum(sizes) - sizes
    lcp = common_lengths(digests, starts, sizes)
    levels = sparse_table(lcp)
    at = np.repeat(np.arange(m), sizes)
    depth = np.arange(at.size) - starts[at] + 1
    left, right = extents(levels, at, depth)
    flat = np.flatnonzero(left == at)  # the first member's candidate stands for the node
    node_of = np.zeros(at.size + 1, np.int64)
    node_of[flat] = np.arange(1, flat.size + 1)
    # Nodes in preorder, the root first.
    lo, hi = np.r_[0, left[flat]], np.r_[m - 1, right[flat]]
    deep, last_words = np.r_[0, depth[flat]], np.r_[0, words[flat]]
    above = np.where(depth[flat] > 1, flat - 1, 0)
    above = np.where(depth[flat] > 1, node_of[starts[left[above]] + depth[above] - 1], 0) if flat.size else above
    parent = np.r_[-1, above]
    edge = (lo == 0) | (hi == m - 1)
    n = hi - lo + 1
    children = np.bincount(parent[1:][~edge[1:]], minlength=n.size)
    inside = (~edge).astype(np.int64)
    stop = np.searchsorted(lo, hi, "right")
    total = lambda x: (lambda s: s[stop] - s[np.arange(n.size)])(np.r_[0, np.cumsum(x)])
    leaves = total(inside * (children == 0))
    saved = total(inside * (n - 1) * last_words)
    least = range_min(sparse_table(convs), lo, hi)
    # Members that end at a node are a run of equal sequences at its start.
    equal = np.r_[False, (lcp == sizes[:-1]) & (lcp == sizes[1:])]
    run = np.flatnonzero(~equal)
    run_end = dict(zip(run.tolist(), np.r_[run[1:], m].tolist(), strict=True))
    ends: list[bytes | None] = [None] * n.size
    for x in np.flatnonzero(sizes[lo] == deep).tolist():
        ends[x] = ",".join(map(str, convs[lo[x]:run_end[int(lo[x])]].tolist())).encode()
    first, last = _chain(digests[:sizes[0]]), _chain(digests[starts[-1]:])
    chain = lambda x: (first if lo[x] == 0 else last)
    at_edge = np.flatnonzero(edge).tolist()
    key: list[bytes | None] = [None] * n.size
    for x in at_edge:
        key[x] = chain(x)[deep[x]]
    above_key = [(chain(x)[deep[x] - 1] if x else None) if edge[x] else (key[parent[x]] if edge[parent[x]] else None)
                 for x in range(n.size)]
    up = np.maximum(parent, 0)
    columns = {"edge": edge, "block": np.full(n.size, block), "key": key, "parent_key": above_key, "depth": deep,
               "conv_id": least, "parent_conv_id": pa.array(least[up], mask=edge | edge[up]), "n_convs": n, "n_children": children,
               "n_leaves": leaves, "saved_tokens": saved,
               "ends_sha256": [None if edge[x] else hashlib.sha256(e or b"").hexdigest() for x, e in enumerate(ends)],
               "words": last_words, "side": (lo > 0).astype(np.int32), "whole": (lo == 0) & (hi == m - 1),
               "ends": [e if edge[x] else None for x, e in enumerate(ends)],
               "first_end": pa.array(convs[lo], mask=~edge)}
    return pa.RecordBatch.from_arrays([pa.array(columns[f], kind) if isinstance(columns[f], list) else
                                       (columns[f] if isinstance(columns[f], pa.Array) else pa.array(columns[f])).cast(kind)
                                       for f, kind in FIELDS.items()], list(FIELDS))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    for b in batches:
        if b.num_rows:
            turns = b.column("digests")
            flat = turns.flatten()
            digests = np.frombuffer(b"".join(flat.to_pylist()), "V16") if len(flat) else np.empty(0, "V16")
            yield block_nodes(number, b.column("conv").to_numpy(), digests,
                              b.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                              turns.value_lengths().to_numpy().astype(np.int64))
            number += 1


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's parts, which come in order, comma-joined; a part is held at a time."""
    key, digest = None, None
    for b in batches:
        done = []
        for k, part in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(part)
            else:
                digest.update(b"," + part)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)],
                                             ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])


# Trie ------------------------------------------------------------------------------------------------------------

def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    ``convs`` as from :func:`sequences`, one row for each id. Copies of a
    conversation are sorted by id too, so that a large group of them is dealt
    over many tasks; only the digest of their ids, which can't be split, reads
    the finished lists of a group in one task, a list of a block at a time. A
    block is an Arrow batch, so its memory is bounded but for one conversation. An empty table has no nodes.
    """
    rows = convs.select("conv", F.expr("transform(turns, x -> x.digest)").alias("digests"),
                        F.expr("transform(turns, x -> x.words)").alias("words"))
    ordered = rows.repartitionByRange("digests", "conv").sortWithinPartitions("digests", "conv")
    nodes = cut(map_batches(ordered, _blocks, SCHEMA), "trie-blocks")
    edges = nodes.where("edge")

    whole = edges.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"), F.max("words").alias("words"), F.min("block").alias("owner"))
    whole = cut(whole, "trie-edges")
    kids = whole.where("parent_key is not null").groupBy(F.col("parent_key").alias("of")).agg(F.count("*").alias("kids"))
    whole = (whole.join(kids, F.col("key") == F.col("of"), "left").drop("of")
             .withColumn("n_children", F.expr("inner + coalesce(kids, 0)"))
             .withColumn("own", F.expr("(n_convs - 1) * words"))
             .withColumn("leaf", F.expr("if(n_children = 0, 1L, 0L)")))
    # Each edge node counts once, in the first block that has it; a chain's running sums from its end upwards
    # are what its nodes have below them there.
    in_block = edges.select("block", F.col("key").alias("k"), "side", F.col("depth").alias("d"), F.col("whole").alias("through"))
    in_block = in_block.join(whole.select("key", "owner", "own", "leaf"), F.col("k") == F.col("key")).drop("key")
    below, block = Window.partitionBy("block", "side").orderBy(F.col("d").desc()), Window.partitionBy("block")
    for x in ("own", "leaf"):
        mine = F.when(F.col("owner") == F.col("block"), F.col(x)).otherwise(0)
        in_block = in_block.withColumn(f"{x}_below", F.sum(mine).over(below)
                                       + F.when(F.col("through"), F.sum(F.when(F.col("side") == 1, mine).otherwise(0)).over(block)).otherwise(0))
    sums = in_block.groupBy("k").agg(F.sum("own_below").alias("own_below"), F.sum("leaf_below").alias("leaf_below"))
    listed = (edges.where("ends is not null").select("key", "first_end", "ends").repartition("key")
              .sortWithinPartitions("key", "first_end").drop("first_end"))
    ends = map_batches(listed, _hash_ends, "key binary, ends_sha256 string").withColumnRenamed("key", "e")
    parents = whole.select(F.col("key").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    done = (whole.join(sums, F.col("key") == F.col("k")).join(parents, F.col("parent_key") == F.col("p"), "left")
            .join(ends, F.col("key") == F.col("e"), "left"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    edge_nodes = done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                             F.expr("inner_leaves + leaf_below").alias("n_leaves"),
                             F.expr("inner_saved + own_below").alias("saved_tokens"),
                             F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    # Parents on an edge are met block by block: the root's children are then not all in one task.
    known = (edges.select(F.col("block").alias("b"), F.col("key").alias("k"))
             .join(whole.select("key", F.col("conv_id").alias("of")), F.col("k") == F.col("key")).drop("key"))
    inner = nodes.where("not edge")
    under = (inner.where("parent_key is not null")
             .join(known, (F.col("block") == F.col("b")) & (F.col("parent_key") == F.col("k")))
             .withColumn("parent_conv_id", F.col("of")))
    return edge_nodes.unionByName(under.select(names)).unionByName(inner.where("parent_key is null").select(names))


ORACLE = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                              lambda y, z: xor(y >> 1, CASE WHEN (y & 1) = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)) % 4 AS h
      FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, list({'said': t.said, 'w': t.w} ORDER BY t.c <> h.c - h.c % 20 OR t.p > h.h, t.p) FILTER (t.c IS NOT NULL) AS s
      FROM h LEFT JOIN t ON (t.c = h.c - h.c % 20 AND t.p <= h.h) OR (t.c = h.c AND t.p > h.h) GROUP BY h.c),
m AS (SELECT c, coalesce(s, []) AS s FROM r),
pre AS (SELECT c, s[1:d] AS k, d, len(s) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM m)),
n AS (SELECT k, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(w) AS w,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM pre GROUP BY k),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
up AS (SELECT k[1:a] AS k, sum((n - 1) * w) AS saved, count(*) FILTER (kids = 0) AS leaves
       FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, up.leaves AS n_leaves,
       up.saved::BIGINT AS saved_tokens, f.e AS ends_sha256
FROM f JOIN up USING (k) LEFT JOIN n p ON p.k = f.k[1:f.d - 1] AND f.d > 0
"""
