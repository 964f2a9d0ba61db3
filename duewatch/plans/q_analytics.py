"""Catalogue: tag impact, summary, name rollups and other rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.operators import analytics as A
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register

for _name, _hours, _who in [("tag_impact_24h", 24, None), ("tag_impact_168h", 168, None),
                            ("tag_impact_720h", 720, None), ("tag_impact_name", 720, "building")]:
    def _job(t: Tables, hours=_hours, who=_who):
        return A.tag_impact(t.runs, t.as_of, hours, who)
    register(_name, O.tag_impact_sql(_hours, _who))(_job)


from duewatch.functions import columns as C  # noqa: E402
from duewatch.operators import timeseries as TS  # noqa: E402
from duewatch.operators import windows as WN  # noqa: E402
from duewatch.operators.ordering import top_k  # noqa: E402

AS_OF = O.AS_OF
DAY_S = 86400


@register("tag_impact_totals", O.with_views(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE {O.PROBLEM}) AS problems, {O.stats()} FROM classified",
    O.classified_view(720)))
def tag_totals_q(t: Tables):
    return A.tag_totals(t.runs, t.as_of, 720)


@register("tag_impact_totals_name", O.with_views(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE {O.PROBLEM}) AS problems, {O.stats()} FROM classified",
    O.classified_view(168, "furniture")))
def tag_totals_name_q(t: Tables):
    return A.tag_totals(t.runs, t.as_of, 168, "furniture")


@register("tags_exploded", O.with_views(
    f"SELECT id, e.value ->> 'key' AS tag_key, e.value ->> 'value' AS tag_value FROM "
    f"(SELECT id, unnest(from_json(tags, '[\"JSON\"]')) AS value FROM runs WHERE {O.IS_ARRAY}) e"))
def tags_exploded_q(t: Tables):
    return A.explode_tags(t.runs, "id")


_NR = "percentile_disc({p}) WITHIN GROUP (ORDER BY dur)"


@register("duration_nearest_rank", O.with_views(
    f"SELECT name, count(dur) AS dur_count, {O.round1('avg(dur)')} AS avg_s, "
    + ", ".join(f"{O.round1(_NR.format(p=p))} AS {n}" for p, n in [(0.5, 'p50_s'), (0.9, 'p90_s'), (0.99, 'p99_s')])
    + f" FROM (SELECT name, {O.COMPLETED_DUR} AS dur FROM runs) r WHERE dur IS NOT NULL GROUP BY name"))
def nearest_rank_q(t: Tables):
    d = t.runs.select("name", C.completed_duration().alias("dur"))
    return A.nearest_rank_stats(d, ["name"])


_DAY_AGO = f"{AS_OF} - 24 * {O.HOUR_US}"
SUMMARY_SQL_COLS = f"""count(*) AS total,
  count(*) FILTER (WHERE status = 'ACTIVE') AS active,
  count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF}) AS overdue,
  count(*) FILTER (WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us >= {AS_OF}) AS on_track,
  count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us <= deadline_us) AS completed_on_time,
  count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us > deadline_us) AS completed_late,
  count(*) FILTER (WHERE status = 'COMPLETED' AND completed_us >= {_DAY_AGO}) AS completed_24h,
  count(*) FILTER (WHERE status = 'COMPLETED' AND completed_us >= {_DAY_AGO} AND deadline_us IS NOT NULL AND completed_us <= deadline_us) AS completed_on_time_24h,
  count(*) FILTER (WHERE status = 'FAILED' AND completed_us >= {_DAY_AGO}) AS failed_24h"""
SUMMARY_VIEW = f"summary AS (SELECT {SUMMARY_SQL_COLS} FROM runs)"


@register("summary", O.with_views("SELECT * FROM summary", SUMMARY_VIEW))
def summary_q(t: Tables):
    return A.summary(t.runs, t.as_of)


NAME_ROLLUP_VIEW = f"""name_rollup AS (
  SELECT name, count(*) AS total,
    count(*) FILTER (WHERE status = 'ACTIVE') AS active,
    count(*) FILTER (WHERE status = 'FAILED') AS failed,
    count(*) FILTER (WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF}) AS overdue,
    count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
    count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us <= deadline_us) AS completed_on_time,
    count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us > deadline_us) AS completed_late,
    {O.sec('max(started_us)')} AS last_started_at
  FROM runs GROUP BY name
)"""


@register("name_rollups", O.with_views(O.ordered("name_rollup", "total DESC, name ASC", 2, 0), NAME_ROLLUP_VIEW))
def name_rollups_q(t: Tables):
    return A.name_rollups(t.runs, t.as_of, 2, 0)


@register("name_rollups_page2", O.with_views(O.ordered("name_rollup", "total DESC, name ASC", 2, 2), NAME_ROLLUP_VIEW))
def name_rollups_p2_q(t: Tables):
    return A.name_rollups(t.runs, t.as_of, 2, 2)


@register("distinct_names", O.with_views("SELECT count(DISTINCT name) AS names FROM runs"))
def distinct_names_q(t: Tables):
    return A.distinct_names(t.runs)


@register("overdue_by_name", O.with_views(O.ordered(
    f"(SELECT name, count(*) AS overdue FROM runs WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL "
    f"AND deadline_us < {AS_OF} GROUP BY name) g", "overdue DESC, name ASC", 100)))
def overdue_by_name_q(t: Tables):
    return A.overdue_by_name(t.runs, t.as_of, 100)


@register("active_count", O.with_views("SELECT count(*) AS n FROM runs WHERE status = 'ACTIVE'"))
def active_count_q(t: Tables):
    return A.count_by_status(t.runs, "ACTIVE")


@register("count_all", O.with_views("SELECT count(*) AS n FROM runs"))
def count_all_q(t: Tables):
    return A.count_by_status(t.runs)


@register("list_total", O.with_views(
    "SELECT count(*) AS total FROM runs WHERE name = 'automobile' AND status = 'COMPLETED' "
    "AND deadline_us IS NOT NULL AND completed_us > deadline_us"))
def list_total_q(t: Tables):
    from duewatch.operators.filters import RunFilter, apply_filter
    f = RunFilter(name="automobile", status="COMPLETED", deadline_status="COMPLETED_LATE")
    return apply_filter(t.runs, f, t.as_of).agg(F.count(F.lit(1)).alias("total"))


def _warning_sql(thr: float) -> str:
    return (f"status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us > {AS_OF} AND warned_us IS NULL "
            f"AND deadline_us > started_us AND CAST({AS_OF} AS DOUBLE) >= CAST(started_us AS DOUBLE) + "
            f"CAST(deadline_us - started_us AS DOUBLE) * {float(thr)!r}")


MISSED_SQL = f"status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF} AND notified_us IS NULL"


@register("notification_backlog", O.with_views(
    f"SELECT count(*) FILTER (WHERE {MISSED_SQL}) AS missed_backlog, "
    f"count(*) FILTER (WHERE {_warning_sql(0.75)}) AS warning_backlog FROM runs"))
def backlog_q(t: Tables):
    return A.backlog(t.runs, t.as_of, 0.75)


@register("completion_metrics", O.with_views(
    f"SELECT name, count(*) AS completed, {O.round1('avg((completed_us - started_us) / 1e6)')} AS avg_seconds, "
    "count(*) FILTER (WHERE deadline_us IS NOT NULL AND completed_us > deadline_us) AS late "
    "FROM runs WHERE status = 'COMPLETED' GROUP BY name"))
def completion_metrics_q(t: Tables):
    return A.completion_metrics(t.runs)


def _rate_sql(done: str, on_time: str, empty: str) -> str:
    return f"CASE WHEN {done} > 0 THEN {O.round_int(f'CAST({on_time} AS DOUBLE) / {done} * 100.0')} ELSE {empty} END"


@register("on_time_rate_all", O.with_views(
    f"SELECT {_rate_sql('completed', 'completed_on_time', '100')} AS on_time_rate FROM summary", SUMMARY_VIEW))
def on_time_all_q(t: Tables):
    s = A.summary(t.runs, t.as_of)
    return s.select(A.on_time_rate(F.col("completed"), F.col("completed_on_time"), 100).alias("on_time_rate"))


@register("on_time_rate_24h", O.with_views(
    f"SELECT completed_24h, {_rate_sql('completed_24h', 'completed_on_time_24h', 'CAST(NULL AS BIGINT)')} AS on_time_rate "
    "FROM summary", SUMMARY_VIEW))
def on_time_24h_q(t: Tables):
    s = A.summary(t.runs, t.as_of)
    return s.select("completed_24h",
                    A.on_time_rate(F.col("completed_24h"), F.col("completed_on_time_24h")).alias("on_time_rate"))


@register("on_time_rate_by_name", O.with_views(
    f"SELECT name, overdue + completed_late AS missed, "
    f"{_rate_sql('completed', 'completed_on_time', 'CAST(NULL AS BIGINT)')} AS on_time_rate FROM name_rollup",
    NAME_ROLLUP_VIEW))
def on_time_by_name_q(t: Tables):
    r = A.name_rollup_all(t.runs, t.as_of)
    return r.select("name", (F.col("overdue") + F.col("completed_late")).alias("missed"),
                    A.on_time_rate(F.col("completed"), F.col("completed_on_time")).alias("on_time_rate"))


@register("on_time_rate_period", O.with_views(
    f"SELECT name, count(*) FILTER (WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND {AS_OF} > deadline_us) AS overdue, "
    "count(*) FILTER (WHERE status = 'COMPLETED') AS completed_count, "
    + _rate_sql("count(*) FILTER (WHERE status = 'COMPLETED')",
                "count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us <= deadline_us)",
                "CAST(NULL AS BIGINT)")
    + f" AS on_time_rate FROM runs WHERE {O.scope_where(720)} GROUP BY name"))
def on_time_period_q(t: Tables):
    s = A.scope(t.runs, t.as_of, 720)
    ds = C.deadline_status(t.as_of)
    g = s.groupBy("name").agg(
        F.count_if(ds == C.MISSED).alias("overdue"),
        F.count_if(F.col("status") == C.COMPLETED).alias("completed_count"),
        F.count_if((F.col("status") == C.COMPLETED) & (ds == C.COMPLETED_ON_TIME)).alias("_on_time"))
    return g.select("name", "overdue", "completed_count",
                    A.on_time_rate(F.col("completed_count"), F.col("_on_time")).alias("on_time_rate"))


def _dist_sql(buckets: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{b}' AS bucket, {b} AS n FROM summary" for b in buckets)
    return O.with_views(f"SELECT * FROM ({parts}) d WHERE n > 0", SUMMARY_VIEW)


@register("status_distribution", _dist_sql(["active", "completed", "failed"]))
def status_dist_q(t: Tables):
    return A.distribution(A.summary(t.runs, t.as_of), "status")


@register("deadline_distribution", _dist_sql(["on_track", "overdue", "completed_on_time", "completed_late"]))
def deadline_dist_q(t: Tables):
    return A.distribution(A.summary(t.runs, t.as_of), "deadline")


@register("tag_catalogue", O.with_views(
    "SELECT tag_key, CAST(sum(total) AS BIGINT) AS key_total, count(*) AS value_count, "
    "CAST(to_json(list(tag_value ORDER BY total DESC, tag_value ASC)) AS VARCHAR) AS \"values\" "
    "FROM rollup GROUP BY tag_key",
    O.classified_view(720), O.EXPLODED_VIEW, O.tag_rollup_view()))
def tag_catalogue_q(t: Tables):
    return A.tag_catalogue(A.tag_rollup(t.runs, t.as_of, 720))


@register("impacted_tags", O.with_views(
    "SELECT tag_key, tag_value, problems, total, "
    "greatest(4, " + O.round_int("problems / max(problems) OVER () * 100") + ") AS share, "
    "CASE WHEN overdue > 0 THEN 'red' ELSE 'amber' END AS tone, "
    f"CAST(row_number() OVER (ORDER BY {O.TAG_ORDER}) AS BIGINT) AS pos "
    f"FROM (SELECT * FROM rollup WHERE problems > 0 ORDER BY {O.TAG_ORDER} LIMIT 8) r",
    O.classified_view(720), O.EXPLODED_VIEW, O.tag_rollup_view()))
def impacted_tags_q(t: Tables):
    return A.impacted_tags(A.tag_rollup(t.runs, t.as_of, 720), 8)


# -- windows ------------------------------------------------------------------

_TONE_SQL = ("coalesce(CASE ds WHEN 'ON_TRACK' THEN 'green' WHEN 'MISSED' THEN 'red' "
             "WHEN 'COMPLETED_ON_TIME' THEN 'green' WHEN 'COMPLETED_LATE' THEN 'amber' END, 'neutral')")


@register("recent_strip", O.with_views(
    "SELECT name, CAST(count(*) AS INTEGER) AS runs_shown, "
    "array_to_string(list_concat(list(tone ORDER BY rn DESC), list_resize(['empty'], 8 - count(*), 'empty')), ',') AS strip "
    f"FROM (SELECT name, {_TONE_SQL} AS tone, rn FROM (SELECT *, {O.DEADLINE_STATUS} AS ds, "
    "row_number() OVER (PARTITION BY name ORDER BY started_us DESC, id DESC) AS rn FROM runs) r WHERE rn <= 8) s "
    "GROUP BY name"))
def recent_strip_q(t: Tables):
    return WN.recent_strip(t.runs, t.as_of)


@register("last_run", O.with_views(
    f"SELECT name, id, process_id, status, {O.sec('started_us')} AS started_at, "
    f"{O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')} AS duration FROM "
    "(SELECT *, row_number() OVER (PARTITION BY name ORDER BY started_us DESC, id DESC) AS rn FROM runs) r WHERE rn = 1"))
def last_run_q(t: Tables):
    return WN.last_run(t.runs, t.as_of)


@register("related_runs", O.with_views(
    "SELECT k.id, p.id AS related_id, CAST(row_number() OVER (PARTITION BY k.id ORDER BY p.rn) AS BIGINT) AS related_rank "
    "FROM runs k JOIN (SELECT * FROM (SELECT id, name, process_id, row_number() OVER (PARTITION BY name "
    "ORDER BY started_us DESC, id DESC) AS rn FROM runs) x WHERE rn <= 7) p "
    "ON p.name = k.name AND p.process_id <> k.process_id QUALIFY related_rank <= 6"))
def related_runs_q(t: Tables):
    return WN.related_runs(t.runs, t.runs)


@register("duplicate_active", O.with_views(
    "SELECT name, process_id, count(*) AS active_runs FROM runs WHERE status = 'ACTIVE' "
    "GROUP BY name, process_id HAVING count(*) > 1"))
def duplicate_active_q(t: Tables):
    return WN.duplicate_active(t.runs)


# -- time series ---------------------------------------------------------------

AS_OF_S = int(AS_OF) // 1_000_000


def _ts_sql(start_s: int, end_s: int, step: int) -> str:
    n = -(-(end_s - start_s) // step)
    return O.with_views(
        f"SELECT {start_s} + b.bucket * {step} AS start, least({start_s} + (b.bucket + 1) * {step}, {end_s}) AS \"end\", "
        "coalesce(a.total_processes, 0) AS total_processes, coalesce(a.active, 0) AS active, "
        "coalesce(a.completed, 0) AS completed, coalesce(a.failed, 0) AS failed, coalesce(a.on_track, 0) AS on_track, "
        "coalesce(a.missed, 0) AS missed, coalesce(a.completed_on_time, 0) AS completed_on_time, "
        "coalesce(a.completed_late, 0) AS completed_late, "
        f"{O.round1('a.avg_dur')} AS avg_duration, "
        f"{O.round1('CAST(a.missed + a.completed_late AS DOUBLE) / a.total_processes * 100.0')} AS missed_deadline_percentage "
        f"FROM (SELECT range AS bucket FROM range(0, {n})) b LEFT JOIN ("
        f"SELECT ({O.sec('started_us')} - {start_s}) // {step} AS bucket, count(*) AS total_processes, avg(dur) AS avg_dur, "
        "count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, "
        "count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE ds = 'ON_TRACK') AS on_track, "
        "count(*) FILTER (WHERE ds = 'MISSED') AS missed, count(*) FILTER (WHERE ds = 'COMPLETED_ON_TIME') AS completed_on_time, "
        "count(*) FILTER (WHERE ds = 'COMPLETED_LATE') AS completed_late "
        f"FROM (SELECT *, {O.DEADLINE_STATUS} AS ds, {O.COMPLETED_DUR} AS dur FROM runs) r "
        f"WHERE {O.sec('started_us')} >= {start_s} AND {O.sec('started_us')} < {end_s} GROUP BY 1) a ON a.bucket = b.bucket")


for _name, _start, _step in [("timeseries_1d", AS_OF_S - 30 * DAY_S, "1d"), ("timeseries_1w", AS_OF_S - 26 * 7 * DAY_S, "1w"),
                             ("timeseries_total", AS_OF_S - 365 * DAY_S, None)]:
    def _job(t: Tables, start=_start, step=_step):
        return TS.timeseries(t.runs, start, AS_OF_S, step, t.as_of)
    _step_s = TS.UNIT_SECONDS[_step[-1]] * int(_step[:-1]) if _step else AS_OF_S - _start
    register(_name, _ts_sql(_start, AS_OF_S, _step_s))(_job)


@register("slo_burn_rate", O.with_views(
    "SELECT name, good, late, missed, good + late + missed AS total, "
    f"{O.round1('CAST(late + missed AS DOUBLE) / NULLIF(good + late + missed, 0) * 100')} AS error_pct, "
    f"{O.round1('CAST(late + missed AS DOUBLE) / NULLIF(good + late + missed, 0) / (1.0 - 0.9)')} AS burn_rate FROM ("
    f"SELECT name, count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us >= {AS_OF} - 720 * {O.HOUR_US} "
    f"AND completed_us <= {AS_OF} AND completed_us <= deadline_us) AS good, "
    f"count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us >= {AS_OF} - 720 * {O.HOUR_US} "
    f"AND completed_us <= {AS_OF} AND completed_us > deadline_us) AS late, "
    f"count(*) FILTER (WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us >= {AS_OF} - 720 * {O.HOUR_US} "
    f"AND deadline_us < {AS_OF}) AS missed FROM runs GROUP BY name) g"))
def burn_rate_q(t: Tables):
    return TS.burn_rate(t.runs, t.as_of, 720, 0.9)


# The 720 h tag impact and totals under their former names; exact percentiles have one path now.
register("tag_impact_720h_two_pass", O.tag_impact_sql(720))(
    lambda t: A.tag_impact(t.runs, t.as_of, 720))
register("tag_impact_totals_two_pass", O.with_views(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE {O.PROBLEM}) AS problems, {O.stats()} FROM classified",
    O.classified_view(720)))(lambda t: A.tag_totals(t.runs, t.as_of, 720))
