"""Runs by tag without reading the runs' JSON: a table (tag_key, tag_value) → run.

Rows are sorted by tag and time, so that a lookup reads the row groups of its
tags only. They carry the run's status and clustering time, whose extremes over
the runs found bound the read of the runs table by partition and row group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duewatch.functions.jsoncols import tag_elements
from duewatch.sources.runs import write_parquet

TAG_INDEX = "tag_key string, tag_value string, status string, at timestamp, id long"
ORDER = ["tag_key", "tag_value", "at", "id"]


def clustering_time() -> F.Column:
    """What :func:`duewatch.sources.runs.write_runs` clusters a status by."""
    return F.coalesce("completed_at", "deadline", "started_at")


def write_tag_index(runs: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """One row for each distinct tag of each run. A hot tag's rows are split over files by time and id."""
    tags = runs.select("id", "status", clustering_time().alias("at"), F.explode(F.array_distinct(tag_elements("tags"))).alias("t"))
    rows = tags.selectExpr("t.key AS tag_key", "t.value AS tag_value", "status", "at", "id").where("tag_key IS NOT NULL AND tag_value IS NOT NULL")
    ordered = rows.repartitionByRange(*([files] if files else []), *ORDER).sortWithinPartitions(*ORDER)
    write_parquet(ordered, path, mode, lookups=())


def tagged_ids(spark: SparkSession, path: str, pairs: dict[str, str]) -> DataFrame:
    """(id, status, at) of the runs that have every pair.

    The pairs are an OR of equalities, which reaches the index's row groups.
    Ids are counted with partial counts in each task: no key is hot, as a run
    stands once for each pair."""
    if not pairs:
        raise ValueError("no tags to look up")
    hit = F.lit(False)
    for k, v in pairs.items():
        hit = hit | ((F.col("tag_key") == k) & (F.col("tag_value") == v))
    rows = spark.read.schema(TAG_INDEX).parquet(path).where(hit)
    if len(pairs) == 1:
        return rows.select("id", "status", "at")
    found = rows.groupBy("id").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("at").alias("at"))
    return found.where(F.col("n") == len(pairs)).drop("n")


def tagged_runs(runs: DataFrame, path: str, pairs: dict[str, str]) -> DataFrame:
    """The runs that have every pair, all columns; equals the filter on the runs' tags.

    A first look at the index tells which statuses and times the runs are in
    (a row per status); the runs table is read within them, and meets the ids
    by a semi join."""
    ids = tagged_ids(runs.sparkSession, path, pairs)
    bounds = ids.groupBy("status").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    found = runs.where(F.lit(False))
    for b in bounds:  # one branch a status, so that both the partition and the time reach the scan
        found = found.unionByName(runs.where((F.col("status") == b.status) & _clustered_within(F.lit(b.lo), F.lit(b.hi))))
    return found.join(ids.select("id"), "id", "left_semi").select(*runs.columns)


def _clustered_within(lo: F.Column, hi: F.Column) -> F.Column:
    """Bounds on :func:`clustering_time` by plain comparisons, as a coalesce would not reach the scan."""
    out, missing = F.lit(False), F.lit(True)
    for c in ("completed_at", "deadline", "started_at"):
        out = out | (missing & (F.col(c) >= lo) & (F.col(c) <= hi))
        missing = missing & F.col(c).isNull()
    return out
