"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 puts each text's hash into k cells of a fixed-size counting filter and
keeps, as a bit set, the cells that at least two rows fell into. Pass 2 tests
every row against the bit set: a row with some cell to itself is unique and
passes straight through; the others, possibly repeated, are the only ones that
shuffle, and are grouped by their digest, which decides.

Cell counts are combined within each task before they shuffle, and so are the
groups, so a text with a third of all rows costs one row per task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewatch.llm.shared import cut, flag_by_bits, set_bits

FILTER_BITS = 26
HASHES = 2


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, no other letter changed."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _cell(digest: str, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), F.col(digest)), F.lit(1 << bits))


def flag_possible_repeats(rows: DataFrame, digest: str, flag: str, *, bits: int = FILTER_BITS,
                          hashes: int = HASHES, seen: DataFrame | None = None) -> DataFrame:
    """Add boolean ``flag``: false only where no other row has the same ``digest``.

    The filter has 2**bits cells per hash function whatever the input, so the
    broadcast bit sets stay under 2**bits / 4 bytes each (16 MB at 26). With n
    rows a unique row is flagged with probability about (n / 2**bits)**hashes;
    past the filter's size more rows shuffle and the result is the same. ``seen``
    may give the digests of the same rows in a table that is cheaper to read.
    """
    seen = rows if seen is None else seen
    out = rows
    for i in range(hashes):
        shared = (seen.select(_cell(digest, i, bits).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
                  .where("n > 1"))
        out = flag_by_bits(out, set_bits(shared, "c"), _cell(digest, i, bits), f"__hit{i}")
    hits = [F.col(f"__hit{i}") for i in range(hashes)]
    every = hits[0]
    for h in hits[1:]:
        every = every & h
    return out.withColumn(flag, every).drop(*[f"__hit{i}" for i in range(hashes)])


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty; the largest id of equal texts stays (a null id only if all are
    null). Rows repeated with id and text are all marked kept here, and
    :func:`exact_dedup` keeps one of them. An empty table gives no rows; other
    columns are not read. Texts are read once and never shuffle: their digests
    do, if possibly repeated.
    """
    digests = cut(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")),
                  "exact-digests")
    rows = flag_possible_repeats(digests, "sha", "maybe", bits=bits)
    maybe = rows.where("maybe")
    groups = maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = maybe.join(groups, "sha").select("id", "keep_id", "group_size", "sha")
    alone = rows.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                           "sha")
    return alone.unionByName(repeated).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with one whole row of each group of equal texts: that of the largest id.

    All columns are kept, whatever their names. Possibly repeated rows are
    pre-aggregated in each task before they shuffle; the others pass through.
    Between rows of the same id and text the choice is by a digest of the row
    as JSON, so that reruns agree and columns of any type may be there.
    """
    sha = F.sha2(normalised(F.col(text_col)), 256)
    digests = cut(docs.select(sha.alias("sha")), "exact-digests")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("k"), sha.alias("sha"))  # no name can clash
    rows = flag_possible_repeats(rows, "sha", "maybe", bits=bits, seen=digests)
    kept = rows.where("maybe").groupBy("sha").agg(
        F.max_by("row", F.struct("k", F.sha2(F.to_json("row"), 256))).alias("best"))
    return rows.where("not maybe").select("row.*").unionByName(kept.select("best.*"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
