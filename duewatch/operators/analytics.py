"""Rollups over runs: tag impact, summary, name rollups and the small counts.

All aggregates are single-pass with filtered counts (``count_if``); Spark
plans each as partial (map-side) + final hash aggregation, so the shuffle
carries one row per group per task regardless of how many runs share a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duewatch.functions import columns as C
from duewatch.functions.jsoncols import tag_elements
from duewatch.functions.time import instant, minus_hours
from duewatch.operators.ordering import top_k
from duewatch.operators.quantiles import grouped_stats

MAX_TAG_ROWS = 100
DEFAULT_WINDOW_HOURS = 24


def window_hours(hours: int | None) -> int:
    """Window hours, 1 to 720 (24 if None); others are an error, as in every entry point."""
    if hours is None:
        return DEFAULT_WINDOW_HOURS
    if not 1 <= int(hours) <= 720:
        raise ValueError(f"window hours must be 1 to 720: {hours}")
    return int(hours)


def scope(runs: DataFrame, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None) -> DataFrame:
    """Runs an analytics window looks at: every ACTIVE run, plus finished runs
    whose completion is within the last ``hours`` (bound inclusive).

    Written as two disjoint branches (ACTIVE / not ACTIVE) joined by UNION
    ALL rather than one OR, so each branch's predicate reaches the scan: the
    ACTIVE branch prunes to the ACTIVE status partition, the finished branch
    pushes ``completed_at >= since`` into Parquet row-group statistics."""
    since = minus_hours(as_of, window_hours(hours))
    by_name = F.lit(True) if name is None else (F.col("name") == F.lit(name))
    active = runs.filter(C.is_active() & by_name)
    finished = runs.filter((F.col("status") != C.ACTIVE) & C.completed.isNotNull()
                           & (C.completed >= since) & by_name)
    return active.unionByName(finished)


def duration_stats(d: str) -> list[Column]:
    """count and average, rounded to 0.1, of ``d`` (nulls ignored)."""
    return [F.expr(f"count({d})").alias("dur_count"), C.round1(f"avg({d})").alias("avg_s")]


def _approx(d: str) -> Column:
    return F.expr(f"CAST(percentile_approx({d}, array(0.5D, 0.9D, 0.99D), 10000) AS ARRAY<DOUBLE>)").alias("_q")


def _finish_stats(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "_q"]
    return df.selectExpr(*[f"`{c}`" for c in keep],
                         *[f"floor(_q[{i}] * 10.0D + 0.5D) / 10.0D AS {n}"
                           for i, n in enumerate(["p50_s", "p90_s", "p99_s"])])


_PROBLEMS = "(" + ", ".join(f"'{o}'" for o in C.PROBLEM_OUTCOMES) + ")"


def _classified(runs: DataFrame, as_of, hours: int, name: str | None) -> DataFrame:
    return scope(runs, as_of, hours, name).select(
        F.col("tags"), C.outcome(as_of).alias("outcome"), C.completed_duration().alias("dur"))


_OUTCOMES = {C.OVERDUE: "overdue", C.ON_TRACK: "on_track", C.COMPLETED_LATE: "completed_late",
             C.COMPLETED_ON_TIME: "completed_on_time", C.FAILED: "failed"}
#: What a rollup adds up over (outcome, dur) rows: all that a stored partial needs for counts and averages.
OUTCOME_SUMS = {"total": "1L", **{n: f"if(outcome = '{o}', 1L, 0L)" for o, n in _OUTCOMES.items()}, "dur_sum": "dur"}


def _problems_sql() -> str:
    return " + ".join(_OUTCOMES[o] for o in C.PROBLEM_OUTCOMES)


def rollup_columns(stats: DataFrame, keys: list[str], counts: bool = True) -> DataFrame:
    """Counts, problems, average and percentiles from :func:`grouped_stats` over OUTCOME_SUMS."""
    return _finish_stats(stats.selectExpr(
        *[f"`{k}`" for k in keys], "total", *(_OUTCOMES.values() if counts else []), f"{_problems_sql()} AS problems", "n AS dur_count",
        "floor(try_divide(dur_sum, n) * 10.0D + 0.5D) / 10.0D AS avg_s", "_q"))


_NO_TOTALS = "0L AS total, 0L AS problems, 0L AS dur_count, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("avg_s", "p50_s", "p90_s", "p99_s"))


def _one_row(df: DataFrame) -> DataFrame:
    """An aggregate without keys as one row, of zeros and nulls if nothing was there."""
    spark = df.sparkSession
    none = spark.range(1).selectExpr(*_NO_TOTALS.split(", "))
    return df.unionByName(none).agg(*[F.max(c).alias(c) for c in df.columns])


def tag_totals(runs: DataFrame, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None,
               approx: bool = False) -> DataFrame:
    """Window totals (untagged runs included): total, problems, duration stats.

    Percentiles are exact (:mod:`duewatch.operators.quantiles`) unless
    ``approx`` asks for a sketch in the same pass."""
    s = _classified(runs, as_of, hours, name)
    if approx:
        return _finish_stats(s.agg(F.expr("count(1)").alias("total"),
                                   F.expr(f"count_if(outcome IN {_PROBLEMS})").alias("problems"),
                                   *duration_stats("dur"), _approx("dur")))
    return _one_row(rollup_columns(grouped_stats(s, [], "dur", OUTCOME_SUMS), [], counts=False))


def tag_impact_order() -> list[Column]:
    return [F.col("problems").desc(), F.col("total").desc(),
            F.col("tag_key").asc_nulls_last(), F.col("tag_value").asc_nulls_last()]


def explode_tags(runs: DataFrame, *keep: str) -> DataFrame:
    """One row per tag element (inner: null, empty, non-array tags drop out;
    duplicates are kept)."""
    t = F.explode(tag_elements("tags")).alias("t")
    return runs.select(*keep, t).select(
        *keep, F.col("t.key").alias("tag_key"), F.col("t.value").alias("tag_value"))


def tag_rollup(runs: DataFrame, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None,
               approx: bool = False) -> DataFrame:
    """Uncapped per-(key, value) rollup; percentiles exact unless ``approx``."""
    s = explode_tags(_classified(runs, as_of, hours, name), "outcome", "dur")
    keys = ["tag_key", "tag_value"]
    if approx:
        return _finish_stats(s.groupBy(*keys).agg(
            F.expr("count(1)").alias("total"), *[F.expr(f"count_if(outcome = '{o}')").alias(n) for o, n in _OUTCOMES.items()],
            F.expr(f"count_if(outcome IN {_PROBLEMS})").alias("problems"), *duration_stats("dur"), _approx("dur")))
    return rollup_columns(grouped_stats(s, keys, "dur", OUTCOME_SUMS), keys)


TAG_KEYS = ["whole", "tag_key", "tag_value"]


def tagged(classified: DataFrame, *keep: str) -> DataFrame:
    """A row per tag, and one for the run itself (``whole``, without a tag): ``keep``, ``whole``, ``tag_key``, ``tag_value``."""
    none = F.lit(None).cast("string")
    every = F.array(F.struct(F.lit(True).alias("whole"), none.alias("key"), none.alias("value")))
    tags = F.transform(F.coalesce(tag_elements("tags"), F.array()),
                       lambda t: F.struct(F.lit(False).alias("whole"), t["key"].alias("key"), t["value"].alias("value")))
    rows = classified.select(*keep, F.explode(F.concat(every, tags)).alias("t"))
    return rows.selectExpr(*[f"`{c}`" for c in keep], "t.whole", "t.key AS tag_key", "t.value AS tag_value")


def tag_rollup_with_totals(runs: DataFrame, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None) -> DataFrame:
    """:func:`tag_rollup`, and the window totals as one more group (``whole``): runs are classified once for both."""
    rows = tagged(_classified(runs, as_of, hours, name), "outcome", "dur")
    return rollup_columns(grouped_stats(rows, TAG_KEYS, "dur", OUTCOME_SUMS), TAG_KEYS)


def tag_impact(runs: DataFrame, as_of, hours: int = DEFAULT_WINDOW_HOURS, name: str | None = None,
               cap: int = MAX_TAG_ROWS, approx: bool = False) -> DataFrame:
    """Per-tag outcome breakdown, most problematic first, top ``cap``."""
    return top_k(tag_rollup(runs, as_of, hours, name, approx), tag_impact_order(), cap)


def summary(runs: DataFrame, as_of) -> DataFrame:
    """Headline counts in one pass; the *_24h counts use completed_at >= as_of − 24 h."""
    from duewatch.functions.time import instant_sql, to_micros
    if instant_sql(as_of) is None:
        raise TypeError("summary needs a literal as_of")
    now = instant_sql(as_of)
    day_ago = f"timestamp_micros({to_micros(as_of) - 24 * 3_600_000_000})"
    done = f"status = '{C.COMPLETED}'"
    exprs = {
        "total": "count(1)",
        "active": "count_if(status = 'ACTIVE')",
        "completed": f"count_if({done})",
        "failed": f"count_if(status = '{C.FAILED}')",
        "overdue": f"count_if({C.overdue_sql(now)})",
        "on_track": f"count_if({C.on_track_sql(now)})",
        "completed_on_time": f"count_if({C.ON_TIME_SQL})",
        "completed_late": f"count_if({C.LATE_SQL})",
        "completed_24h": f"count_if({done} AND completed_at >= {day_ago})",
        "completed_on_time_24h": f"count_if({C.ON_TIME_SQL} AND completed_at >= {day_ago})",
        "failed_24h": f"count_if(status = '{C.FAILED}' AND completed_at >= {day_ago})",
    }
    return runs.agg(*[F.expr(e).alias(k) for k, e in exprs.items()])


def name_rollup_order() -> list[Column]:
    return [F.col("total").desc(), F.col("name").asc()]


def name_rollup_all(runs: DataFrame, as_of) -> DataFrame:
    from duewatch.functions.time import instant_sql
    now = instant_sql(as_of)
    if now is None:
        raise TypeError("name rollups need a literal as_of")
    done = f"status = '{C.COMPLETED}'"
    exprs = {
        "total": "count(1)",
        "active": "count_if(status = 'ACTIVE')",
        "failed": f"count_if(status = '{C.FAILED}')",
        "overdue": f"count_if({C.overdue_sql(now)})",
        "completed": f"count_if({done})",
        "completed_on_time": f"count_if({C.ON_TIME_SQL})",
        "completed_late": f"count_if({C.LATE_SQL})",
        "last_started_at": "unix_seconds(max(started_at))",
    }
    return runs.groupBy("name").agg(*[F.expr(e).alias(k) for k, e in exprs.items()])


def name_rollups(runs: DataFrame, as_of, limit: int = 20, offset: int = 0) -> DataFrame:
    """Per-name rollup, busiest first, one page."""
    return top_k(name_rollup_all(runs, as_of), name_rollup_order(), limit, offset)


def distinct_names(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_distinct("name").alias("names"))


def overdue_by_name(runs: DataFrame, as_of, n: int | None = None) -> DataFrame:
    """Overdue runs per name: all names, or the ``n`` with the most, with ``pos``."""
    now = instant(as_of)
    over = runs.filter(C.is_active() & C.deadline.isNotNull() & (C.deadline < now))
    agg = over.groupBy("name").agg(F.count(F.lit(1)).alias("overdue"))
    return agg if n is None else top_k(agg, [F.col("overdue").desc(), F.col("name").asc()], n)


def count_by_status(runs: DataFrame, status: str | None = None) -> DataFrame:
    df = runs if status is None else runs.filter(F.col("status") == status)
    return df.agg(F.count(F.lit(1)).alias("n"))


def backlog(runs: DataFrame, as_of, threshold: float = 0.75) -> DataFrame:
    """Missed / warning notification backlog; warning is 0 when the threshold
    is outside (0, 1)."""
    from duewatch.operators.scans import missed_due, warning_due
    warn = warning_due(as_of, threshold) if 0 < threshold < 1 else F.lit(False)
    return runs.agg(F.count_if(missed_due(as_of)).alias("missed_backlog"),
                    F.count_if(warn).alias("warning_backlog"))


def completion_metrics(runs: DataFrame) -> DataFrame:
    """Per name over COMPLETED runs: count, average seconds, late count."""
    done = runs.filter(F.col("status") == C.COMPLETED)
    secs = (F.unix_micros(C.completed) - F.unix_micros(C.started)) / F.lit(1e6)
    return done.groupBy("name").agg(
        F.count(F.lit(1)).alias("completed"),
        C.round1(F.avg(secs)).alias("avg_seconds"),
        F.expr(f"count_if({C.LATE_SQL})").alias("late"))


def nearest_rank_stats(df: DataFrame, keys: list[str], value: str = "dur") -> DataFrame:
    """count, avg and nearest-rank p50/p90/p99: ``sorted[max(0, ceil(p·n) − 1)]``."""
    got = grouped_stats(df.filter(F.col(value).isNotNull()), keys, value, {"_sum": f"CAST({value} AS DOUBLE)"}, nearest_rank=True)
    return _finish_stats(got.selectExpr(*[f"`{k}`" for k in keys], "n AS dur_count", "floor(_sum / n * 10.0D + 0.5D) / 10.0D AS avg_s", "_q"))


def on_time_rate(done: Column, on_time: Column, empty_value=None) -> Column:
    """``Math.round(on_time / done * 100)``; ``empty_value`` when done is 0."""
    rate = C.round_int(F.try_divide(on_time.cast("double"), done.cast("double")) * F.lit(100.0))
    return F.when(done > 0, rate).otherwise(F.lit(empty_value).cast("long"))


def distribution(summary_df: DataFrame, kind: str) -> DataFrame:
    """Status or deadline-status distribution from a summary row; zero buckets dropped."""
    if kind == "status":
        buckets = ["active", "completed", "failed"]
    elif kind == "deadline":
        buckets = ["on_track", "overdue", "completed_on_time", "completed_late"]
    else:
        raise ValueError(kind)
    long = summary_df.unpivot([], buckets, "bucket", "n")
    return long.filter(F.col("n") > 0)


def tag_catalogue(rollup: DataFrame) -> DataFrame:
    """Group the tag rollup by key: key total, number of values, and the values
    as a JSON array, ordered by total desc then value asc."""
    vals = F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("neg_total"),
                                                F.col("tag_value").alias("value"))))
    return rollup.groupBy("tag_key").agg(
        F.sum("total").cast("long").alias("key_total"),
        F.count(F.lit(1)).alias("value_count"),
        F.to_json(F.transform(vals, lambda s: s["value"])).alias("values"))


def latency_by_tag(rollup: DataFrame, n: int = MAX_TAG_ROWS) -> DataFrame:
    """The ``n`` slowest tags by p90 of the whole rollup (:func:`tag_rollup_with_totals`); flags those slower than the overall p90."""
    # The whole comes first, then the slowest tags: n + 1 rows, so the window below is as small.
    order = [F.col("whole").desc(), F.col("p90_s").desc(), F.col("tag_key").asc(), F.col("tag_value").asc()]
    first = top_k(rollup.filter("whole OR dur_count > 0"), order, n + 1, pos=False)
    overall = F.max(F.when(F.col("whole"), F.col("p90_s"))).over(Window.partitionBy())
    first = first.withColumn("slower_than_overall", F.coalesce(F.col("p90_s") > overall, F.lit(False)))
    return top_k(first.filter("NOT whole"), order[1:], n).select("pos", "tag_key", "tag_value", "dur_count", "p50_s", "p90_s", "p99_s", "slower_than_overall")


def impacted_tags(impact: DataFrame, n: int = 8) -> DataFrame:
    """Share of the worst tag: max(4, round(problems / max_problems · 100)), top n
    with problems; tone red when the tag has overdue runs, else amber."""
    with_problems = impact.filter(F.col("problems") > 0)
    ranked = top_k(with_problems, tag_impact_order(), n, pos=False)
    worst = F.max("problems").over(Window.partitionBy())
    return ranked.select(
        "tag_key", "tag_value", "problems", "total",
        F.greatest(F.lit(4), C.round_int(F.col("problems") / worst * 100)).alias("share"),
        F.when(F.col("overdue") > 0, F.lit("red")).otherwise(F.lit("amber")).alias("tone"),
    ).withColumn("pos", F.row_number().over(Window.orderBy(*tag_impact_order())).cast("long"))
