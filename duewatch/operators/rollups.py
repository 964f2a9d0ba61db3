"""Window rollups from stored partials instead of the whole history.

Finished runs no longer change their outcome, so what a rollup needs of them is
added up once, by finish day, name and tag: per value range the number of runs
by outcome, of durations and their sum (:func:`duewatch.operators.quantiles.ranged`),
and the durations themselves, in order of tag and range. A window reads the ranges of its
whole days, classifies only ACTIVE runs and those of the day it begins in, and
looks into the stored durations for the few ranges that hold a percentile.

Partials are additive. Each batch of finished runs is an epoch of its own, late
ones too; runs that are deleted are taken off again by an epoch with
``sign=-1``. Percentiles, averages and counts equal the direct rollup's.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from duewatch.functions import columns as C
from duewatch.functions.time import to_micros
from duewatch.operators.analytics import (DEFAULT_WINDOW_HOURS, MAX_TAG_ROWS, OUTCOME_SUMS, TAG_KEYS, rollup_columns, tag_impact_order, tagged,
                                          window_hours)
from duewatch.operators.ordering import top_k
from duewatch.operators.quantiles import grouped_stats, range_sql, ranged
from duewatch.sources.epochs import committed, prune, read_epochs, write_epoch

RANGES = ("day date, name string, whole boolean, tag_key string, tag_value string, _b long, _m long, "
          + ", ".join(f"`{n}` {'double' if n == 'dur_sum' else 'long'}" for n in OUTCOME_SUMS))
VALUES = "day date, name string, whole boolean, tag_key string, tag_value string, _b long, dur double, c long"
MICROS_PER_DAY = 86_400_000_000


def _tagged(runs: DataFrame, as_of, *keep: str) -> DataFrame:
    rows = runs.select(*keep, "name", "tags", C.outcome(as_of).alias("outcome"), C.completed_duration().alias("dur"))
    return tagged(rows, *keep, "name", "outcome", "dur")


def add_finished(runs: DataFrame, root: str, epoch: int, sign: int = 1) -> None:
    """Store the partials of finished runs (``sign=-1``: take them off) as one epoch; ACTIVE runs are left out.

    Both writes are aggregates that are combined in each task before they
    shuffle; values are sorted by tag and range, so that a reader skips the row
    groups of other ranges."""
    done = runs.where((F.col("status") != C.ACTIVE) & F.col("completed_at").isNotNull()).withColumn("day", F.to_date("completed_at"))
    rows = _tagged(done, datetime(1970, 1, 1, tzinfo=timezone.utc), "day")  # a finished run's outcome doesn't depend on the instant
    keys = ["day", "name", *TAG_KEYS]
    made = ranged(rows, keys, "dur", OUTCOME_SUMS)
    if sign != 1:
        made = made.select(*keys, "_b", *[(F.col(c) * sign).alias(c) for c in ("_m", *OUTCOME_SUMS)])
    write_epoch(made, f"{root}/ranges", epoch)
    values = (rows.where("dur IS NOT NULL").groupBy(*keys, "dur").agg((F.count("*") * sign).alias("c"))
              .withColumn("_b", F.expr(range_sql("dur"))))
    order = ["day", *TAG_KEYS, "_b"]
    write_epoch(values.select(*keys, "_b", "dur", "c").repartitionByRange(*order).sortWithinPartitions(*order), f"{root}/values", epoch)


def compact(spark: SparkSession, root: str, clean: bool = False) -> int:
    """Add all epochs up into the newest one's successor; ``clean`` deletes what it holds. Returns the new epoch."""
    keys = ["day", "name", *TAG_KEYS, "_b"]
    epochs = committed(spark, f"{root}/ranges")
    new = epochs[-1] + 1
    ranges, values = read_epochs(spark, f"{root}/ranges", RANGES), read_epochs(spark, f"{root}/values", VALUES)
    merged = ranges.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_m", *OUTCOME_SUMS)])
    counted = values.groupBy(*keys, "dur").agg(F.sum("c").alias("c")).where("c <> 0")
    order = ["day", *TAG_KEYS, "_b"]
    write_epoch(counted.repartitionByRange(*order).sortWithinPartitions(*order), f"{root}/values", new)
    write_epoch(merged, f"{root}/ranges", new)
    if clean:
        for table in ("ranges", "values"):
            prune(spark, f"{root}/{table}", epochs[-1])
    return new


def window_rollup(runs: DataFrame, root: str, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None) -> DataFrame:
    """:func:`duewatch.operators.analytics.tag_rollup_with_totals` from stored partials.

    Of ``runs`` only ACTIVE ones and those finished between the window's start
    and the next midnight are read."""
    hours = window_hours(hours)
    spark = runs.sparkSession
    since = to_micros(as_of) - hours * 3_600_000_000
    midnight = -(-since // MICROS_PER_DAY) * MICROS_PER_DAY
    first_day = (datetime(1970, 1, 1) + timedelta(microseconds=midnight)).date()
    by_name = F.lit(True) if name is None else F.col("name") == name
    done = F.col("completed_at")
    active = runs.where(C.is_active() & by_name)
    begun = runs.where((F.col("status") != C.ACTIVE) & (done >= F.timestamp_micros(F.lit(since))) & (done < F.timestamp_micros(F.lit(midnight))) & by_name)
    rows = _tagged(active.unionByName(begun), as_of)
    days = (F.col("day") >= F.lit(first_day)) & by_name
    ranges = read_epochs(spark, f"{root}/ranges", RANGES).where(days)
    values = read_epochs(spark, f"{root}/values", VALUES).where(days)
    cols = [*TAG_KEYS, "_b", "_m", *OUTCOME_SUMS]
    ranges = ranged(rows, TAG_KEYS, "dur", OUTCOME_SUMS).select(cols).unionByName(ranges.select(cols))
    values = rows.where("dur IS NOT NULL").select(*TAG_KEYS, "dur", F.lit(1).cast("long").alias("c")).unionByName(values.select(*TAG_KEYS, "dur", "c"))
    stats = grouped_stats(values, TAG_KEYS, "dur", OUTCOME_SUMS, count="c", ranges=ranges)
    return rollup_columns(stats.where("total > 0"), TAG_KEYS)


def tag_impact(runs: DataFrame, root: str, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None, cap: int = MAX_TAG_ROWS) -> DataFrame:
    """:func:`duewatch.operators.analytics.tag_impact` from stored partials."""
    return top_k(window_rollup(runs, root, as_of, hours, name).where("NOT whole").drop("whole"), tag_impact_order(), cap)


def tag_totals(runs: DataFrame, root: str, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None) -> DataFrame:
    """:func:`duewatch.operators.analytics.tag_totals` from stored partials; no row if the window is empty."""
    return window_rollup(runs, root, as_of, hours, name).where("whole").select(
        "total", "problems", "dur_count", "avg_s", "p50_s", "p90_s", "p99_s")
