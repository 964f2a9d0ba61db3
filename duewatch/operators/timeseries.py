"""Time-series metrics over [start, end) and SLO burn rate.

A run falls in the bucket of its ``started_at``; buckets are aligned to
``start``. Empty buckets are emitted with zero counts and null averages: the
bucket list comes from ``spark.range`` over the (parameter-derived) bucket
count, and the aggregated buckets are joined onto it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from duewatch.functions import columns as C
from duewatch.functions.time import instant, to_micros
from duewatch.operators.analytics import window_hours
from duewatch.operators.filters import RunFilter, apply_filter

UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
PERIOD_PATTERN = re.compile(r"^[0-9]+[smhdw]$")


def period_seconds(period: str) -> int:
    if not PERIOD_PATTERN.match(period or ""):
        raise ValueError(f"period must match ^[0-9]+[smhdw]$: {period!r}")
    n = int(period[:-1])
    if n <= 0:
        raise ValueError("period must be positive")
    return n * UNIT_SECONDS[period[-1]]


def timeseries(runs: DataFrame, start_s: int, end_s: int, period: str | None, as_of,
               flt: RunFilter | None = None) -> DataFrame:
    """Per bucket: start, end, total, avg duration of COMPLETED runs, missed %
    ((MISSED + COMPLETED_LATE) / total · 100), status and deadline-status counts."""
    if end_s <= start_s:
        raise ValueError("end must be after start")
    step = period_seconds(period) if period else end_s - start_s
    n_buckets = -(-(end_s - start_s) // step)
    st_s = F.unix_seconds("started_at")
    # Compare the column itself (not an expression of it) so the range reaches
    # Parquet row-group statistics as a pushed filter.
    st = F.col("started_at")
    scoped = apply_filter(runs, flt, as_of).filter(
        (st >= F.timestamp_seconds(F.lit(start_s))) & (st < F.timestamp_seconds(F.lit(end_s))))
    ds = C.deadline_status(as_of)
    rows = scoped.select(((st_s - F.lit(start_s)) / F.lit(step)).cast("long").alias("bucket"),
                         F.col("status"), ds.alias("ds"), C.completed_duration().alias("dur"))
    agg = rows.groupBy("bucket").agg(
        F.expr("count(1)").alias("total_processes"), F.expr("avg(dur)").alias("_avg"),
        *[F.expr(f"count_if(status = '{v}')").alias(n) for v, n in
          [(C.ACTIVE, "active"), (C.COMPLETED, "completed"), (C.FAILED, "failed")]],
        *[F.expr(f"count_if(ds = '{v}')").alias(n) for v, n in
          [(C.ON_TRACK, "on_track"), (C.MISSED, "missed"), (C.COMPLETED_ON_TIME, "completed_on_time"),
           (C.COMPLETED_LATE, "completed_late")]])
    spark = runs.sparkSession
    buckets = spark.range(n_buckets).withColumnRenamed("id", "bucket")
    j = buckets.join(agg, "bucket", "left")
    counts = ["total_processes", "active", "completed", "failed", "on_track", "missed",
              "completed_on_time", "completed_late"]
    return j.selectExpr(
        f"{start_s} + bucket * {step} AS start",
        f"least({start_s} + (bucket + 1) * {step}, {end_s}) AS `end`",
        *[f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in counts],
        "floor(_avg * 10.0D + 0.5D) / 10.0D AS avg_duration",
        "floor(try_divide(CAST(missed + completed_late AS DOUBLE), CAST(total_processes AS DOUBLE)) * 100.0D * 10.0D"
        " + 0.5D) / 10.0D AS missed_deadline_percentage")


def burn_rate(runs: DataFrame, as_of, hours: int, target: float) -> DataFrame:
    """Per name over the last ``hours``: good = completed on time, bad =
    completed late + still-active runs whose deadline passed in the window;
    error rate = bad / (good + bad); burn rate = error rate / (1 − target).
    A target that leaves no budget (1 or more) or isn't a share is an error."""
    hours = window_hours(hours)
    if not 0 <= target < 1:
        raise ValueError(f"target must be at least 0 and below 1: {target}")
    now = instant(as_of)
    since = F.timestamp_micros(F.lit(to_micros(as_of) - hours * 3_600_000_000))
    dl, ca = F.col("deadline"), F.col("completed_at")
    done_in = (ca >= since) & (ca <= now)
    good, late = done_in & F.expr(C.ON_TIME_SQL), done_in & F.expr(C.LATE_SQL)
    missed = C.is_active() & dl.isNotNull() & (dl >= since) & (dl < now)
    agg = runs.groupBy("name").agg(F.count_if(good).alias("good"), F.count_if(late).alias("late"),
                                   F.count_if(missed).alias("missed"))
    total = F.col("good") + F.col("late") + F.col("missed")
    err = F.try_divide((F.col("late") + F.col("missed")).cast("double"), total.cast("double"))
    return agg.select("name", "good", "late", "missed", total.alias("total"),
                      C.round1(err * 100).alias("error_pct"),
                      C.round1(err / F.lit(1.0 - target)).alias("burn_rate"))
