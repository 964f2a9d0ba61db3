"""Catalogue: metrics, gauges, request rollups and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.functions.time import minus_hours
from duewatch.operators import analytics as A
from duewatch.operators import metrics as M
from duewatch.operators import rules as R
from duewatch.operators import scans as S
from duewatch.operators import windows as WN
from duewatch.operators.lifecycle import decide, operation_results, read_results
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register
from duewatch.plans.q_columns import _http_view
from duewatch.plans.q_lifecycle import CMDS_VIEW, OPERATIONS_SQL
from duewatch.plans.q_scans import _scan_sql
from duewatch.plans.q_analytics import MISSED_SQL, _warning_sql
from duewatch.sources.fixtures import FIXTURE_RULES, fixture_rules

AS_OF = O.AS_OF

LC_SQL = ("SELECT name, count(*) AS created, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, "
          "count(*) FILTER (WHERE status = 'FAILED') AS failed, "
          "count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us IS NOT NULL "
          "AND completed_us <= deadline_us) AS on_time, "
          "count(*) FILTER (WHERE status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us IS NOT NULL "
          "AND completed_us > deadline_us) AS late FROM runs GROUP BY name")
EVENTS_VIEW = ("dl_events AS (SELECT * FROM (" + _scan_sql(_warning_sql(0.75), S.WARNING_EVENT, True, None)
               + ") w UNION ALL SELECT * FROM (" + _scan_sql(MISSED_SQL, S.MISSED_EVENT, False, None) + ") m)")
EV_COUNT_SQL = (f"SELECT name, count(*) FILTER (WHERE event = '{S.MISSED_EVENT}') AS missed_events, "
                f"count(*) FILTER (WHERE event = '{S.WARNING_EVENT}') AS warning_events FROM dl_events GROUP BY name")


@register("lifecycle_counters", O.with_views(LC_SQL))
def lifecycle_counters_q(t: Tables):
    return M.lifecycle_counters(t.runs)


@register("duration_timer", O.with_views(
    "SELECT name, status, count(*) AS count, CAST(sum(ms) AS BIGINT) AS sum_ms, max(ms) AS max_ms FROM "
    "(SELECT name, status, CAST(floor((completed_us - started_us) / 1000.0) AS BIGINT) AS ms FROM runs "
    "WHERE completed_us IS NOT NULL AND status <> 'ACTIVE') r GROUP BY name, status"))
def duration_timer_q(t: Tables):
    return M.duration_timer(t.runs)


@register("event_counters", O.with_views(EV_COUNT_SQL, EVENTS_VIEW))
def event_counters_q(t: Tables):
    return M.event_counters(S.deadline_events(t.runs, t.as_of, 0.75))


@register("slo_on_time", O.with_views(
    "SELECT coalesce(l.name, e.name) AS name, coalesce(l.on_time, 0) AS good, "
    "coalesce(l.on_time, 0) + coalesce(l.late, 0) + coalesce(e.missed_events, 0) AS total, "
    + O.round1("CAST(coalesce(l.on_time, 0) AS DOUBLE) / NULLIF(coalesce(l.on_time, 0) + coalesce(l.late, 0) + coalesce(e.missed_events, 0), 0) * 100")
    + f" AS ratio_pct FROM ({LC_SQL}) l FULL OUTER JOIN ({EV_COUNT_SQL}) e ON l.name = e.name", EVENTS_VIEW))
def slo_q(t: Tables):
    return M.slo_on_time(M.lifecycle_counters(t.runs), S.deadline_events(t.runs, t.as_of, 0.75))


@register("request_rollup", O.with_views(
    f"SELECT method, endpoint, CAST(status AS VARCHAR) AS status, count(*) AS count, {O.round1('sum(duration_ms)')} AS sum_ms, "
    "max(duration_ms) AS max_ms FROM (SELECT method, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, "
    "'/v1/processes/[^/]+/[^/]+', '/v1/processes/{name}/{id}'), '/v1/processes/[^/]+', '/v1/processes/{name}'), "
    "'/swagger-ui/.*', '/swagger-ui/**'), '/swagger/.*', '/swagger/**') AS endpoint, status, duration_ms "
    "FROM http_requests) r GROUP BY ALL", _http_view()))
def request_rollup_q(t: Tables):
    return M.request_rollup(t.http_requests)


_PREV_T = f"{AS_OF} - 30 * 24 * {O.HOUR_US}"
GAUGE_SQL = O.with_views(
    "SELECT coalesce(c.name, p.name) AS name, CAST(coalesce(c.overdue, 0) AS BIGINT) AS overdue, c.name IS NOT NULL AS present "
    f"FROM (SELECT name, count(*) AS overdue FROM runs WHERE started_us <= {_PREV_T} AND (completed_us IS NULL OR completed_us > {_PREV_T}) "
    f"AND deadline_us < {_PREV_T} GROUP BY name) p FULL OUTER JOIN ("
    + O.ordered(f"(SELECT name, count(*) AS overdue FROM runs WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL "
                f"AND deadline_us < {AS_OF} GROUP BY name) g", "overdue DESC, name ASC") + ") c ON c.name = p.name")


def gauge_prev(t: Tables):
    at = minus_hours(t.as_of, 30 * 24)
    r = t.runs
    cond = (F.col("started_at") <= at) & (F.col("completed_at").isNull() | (F.col("completed_at") > at)) & \
           (F.col("deadline") < at)
    return r.filter(cond).groupBy("name").agg(F.count(F.lit(1)).alias("overdue"))


@register("overdue_gauge", GAUGE_SQL)
def overdue_gauge_q(t: Tables):
    return M.overdue_gauge(gauge_prev(t), A.overdue_by_name(t.runs, t.as_of))


def _snapshot_sql() -> str:
    lab = "'process_name=' || name"
    parts = [f"SELECT '{m}' AS metric, {lab} AS labels, CAST({c} AS DOUBLE) AS value FROM lc" for c, m in [
        ("created", "processes_created_total"), ("completed", "processes_completed_total"),
        ("failed", "processes_failed_total"), ("on_time", "processes_completed_on_time_total"),
        ("late", "processes_completed_late_total")]]
    parts += [f"SELECT '{m}' AS metric, {lab} AS labels, CAST({c} AS DOUBLE) AS value FROM ev" for c, m in [
        ("missed_events", "deadline_missed_total"), ("warning_events", "deadline_warning_total")]]
    parts.append(f"SELECT 'processes_overdue_current', {lab}, CAST(overdue AS DOUBLE) FROM (SELECT name, count(*) AS overdue "
                 f"FROM runs WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF} GROUP BY name "
                 ") o")
    parts.append(f"SELECT 'notification_backlog', 'type=missed', CAST(count(*) FILTER (WHERE {MISSED_SQL}) AS DOUBLE) FROM runs")
    parts.append(f"SELECT 'notification_backlog', 'type=warning', CAST(count(*) FILTER (WHERE {_warning_sql(0.75)}) AS DOUBLE) FROM runs")
    parts.append("SELECT 'active_processes_current', '', CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS DOUBLE) FROM runs")
    timer = ("(SELECT name, status, count(*) AS c, sum(ms) AS s, max(ms) AS m FROM (SELECT name, status, "
             "floor((completed_us - started_us) / 1000.0) AS ms FROM runs WHERE completed_us IS NOT NULL AND status <> 'ACTIVE') "
             "GROUP BY ALL)")
    parts += [f"SELECT 'process_duration_ms_{k}', {lab} || ',status=' || status, CAST({c} AS DOUBLE) FROM {timer} t"
              for k, c in (("count", "c"), ("sum", "s"), ("max", "m"))]
    req = ("(SELECT 'method=' || method || ',endpoint=' || regexp_replace(path, '/v1/processes/[^/]+/[^/]+', "
           "'/v1/processes/{name}/{id}') || ',status=' || CAST(status AS VARCHAR) AS l, count(*) AS c, "
           + O.round1("sum(duration_ms)") + " AS s, max(duration_ms) AS m FROM http_requests GROUP BY ALL)")
    parts += [f"SELECT '{k}', l, CAST({c} AS DOUBLE) FROM {req} t" for k, c in (
        ("http_requests_total", "c"), ("http_request_duration_ms_sum", "s"), ("http_request_duration_ms_max", "m"))]
    parts.append("SELECT 'database_operations_total', 'operation=' || operation || ',table=processes,success=' || "
                 f"CAST(success AS VARCHAR), CAST(count(*) AS DOUBLE) FROM ({OPERATIONS_SQL}) o WHERE operation IS NOT NULL GROUP BY operation, success")
    return O.with_views(" UNION ALL ".join(parts), EVENTS_VIEW, f"lc AS ({LC_SQL})", f"ev AS (SELECT n.name, "
                        f"coalesce(e.missed_events, 0) AS missed_events, coalesce(e.warning_events, 0) AS warning_events "
                        f"FROM (SELECT DISTINCT name FROM runs) n LEFT JOIN ({EV_COUNT_SQL}) e ON e.name = n.name)", _http_view(), CMDS_VIEW)


@register("metrics_snapshot", _snapshot_sql())
def metrics_snapshot_q(t: Tables):
    ops = operation_results(decide(t.commands)).unionByName(read_results(t.http_requests))
    return M.metrics_snapshot(t.runs, t.as_of, 0.75, ops, t.http_requests)


WINDOWS_VIEW = """req_windows AS (
  SELECT CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) * 60 - k * 60 AS window_start, status, duration_ms
  FROM http_requests, (SELECT range AS k FROM range(0, 5)) ks
),
win AS (
  SELECT window_start, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors,
         quantile_cont(duration_ms, 0.95) AS p95
  FROM req_windows GROUP BY window_start
)"""


@register("request_p95_window", O.with_views(
    f"SELECT window_start, requests, {O.round1_tolerant('p95')} AS p95_ms, p95 > 1000.0 AS latency_alert FROM win",
    _http_view(), WINDOWS_VIEW))
def request_p95_q(t: Tables):
    return M.request_alerts(t.http_requests).select("window_start", "requests", "p95_ms", "latency_alert")


@register("request_error_ratio_window", O.with_views(
    f"SELECT window_start, requests, errors, {O.round1('CAST(errors AS DOUBLE) / requests * 100')} AS error_pct, "
    "CAST(errors AS DOUBLE) / requests > 0.05 AS error_alert FROM win", _http_view(), WINDOWS_VIEW))
def request_error_q(t: Tables):
    return M.request_alerts(t.http_requests).select("window_start", "requests", "errors", "error_pct", "error_alert")


@register("alert_sustained", O.with_views(
    "SELECT alert, since, \"until\", samples FROM (SELECT alert, grp, min(window_start) AS since, max(window_start) AS \"until\", "
    "count(*) AS samples FROM (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY alert ORDER BY window_start "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (SELECT *, (NOT fired) OR coalesce(window_start - "
    "lag(window_start) OVER (PARTITION BY alert ORDER BY window_start) > 60, false) AS brk FROM ("
    "SELECT 'latency' AS alert, window_start, p95 > 1000.0 AS fired FROM win UNION ALL "
    "SELECT 'errors', window_start, CAST(errors AS DOUBLE) / requests > 0.05 FROM win) s) b) g WHERE NOT brk OR fired "
    "GROUP BY alert, grp) e WHERE \"until\" - since >= CASE alert WHEN 'errors' THEN 120 ELSE 300 END", _http_view(), WINDOWS_VIEW))
def alert_sustained_q(t: Tables):
    samples = M.alert_samples(M.request_alerts(t.http_requests))
    return WN.sustained(samples, ["alert"], "ts", F.col("fired"), M.alert_hold_seconds(F.col("alert")), max_gap_seconds=60)


def _rules_sql() -> str:
    vals = []
    for rid, et, tt, tv, names, tags, ch in FIXTURE_RULES:
        n = "[" + ", ".join(f"'{x}'" for x in names) + "]::VARCHAR[]"
        tg = ("MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tags.items()) + "}") if tags else "MAP {}::MAP(VARCHAR, VARCHAR)"
        c = "[" + ", ".join(f"'{x}'" for x in ch) + "]"
        vals.append(f"SELECT '{rid}' AS rule_id, '{et}' AS event_type, '{tt}' AS threshold_type, "
                    f"CAST({tv} AS DOUBLE) AS threshold_value, {n} AS target_names, {tg} AS target_tags, {c} AS channel_ids")
    return "rules AS (" + " UNION ALL ".join(vals) + ")"


def _tag_has(k: str, v: str) -> str:
    return (f"(CASE WHEN {O.IS_ARRAY} THEN list_contains(list_transform(from_json(tags, '[\"JSON\"]'), "
            f"lambda x: (x ->> 'key') = {k} AND (x ->> 'value') = {v}), true) ELSE false END)")


@register("notification_rule_match", O.with_views(
    "SELECT rule_id, id, event_type, unnest(channel_ids) AS channel_id FROM ("
    "SELECT r.*, q.* EXCLUDE (event_type) FROM (SELECT *, CASE WHEN status = 'ACTIVE' AND deadline_us IS NOT NULL AND "
    f"deadline_us > {AS_OF} THEN '{R.APPROACHING}' WHEN status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF} "
    f"THEN '{R.BREACHED}' WHEN status = 'COMPLETED' THEN '{R.COMPLETED_EVENT}' END AS event_type, "
    f"{O.sec('started_us')} AS st, {O.sec('deadline_us')} AS dl, {O.sec('completed_us')} AS ca, {O.sec(AS_OF)} AS now_s "
    "FROM runs) r JOIN rules q ON q.event_type = r.event_type) j WHERE coalesce(CASE "
    f"WHEN event_type = '{R.APPROACHING}' THEN CASE WHEN threshold_type = 'percent' THEN CAST(now_s - st AS DOUBLE) >= "
    "CAST(dl - st AS DOUBLE) * threshold_value / 100.0 ELSE CAST(dl - now_s AS DOUBLE) <= threshold_value END "
    f"WHEN event_type = '{R.BREACHED}' THEN CASE WHEN threshold_type = 'percent' THEN CAST(now_s - dl AS DOUBLE) >= "
    "CAST(dl - st AS DOUBLE) * threshold_value / 100.0 ELSE CAST(now_s - dl AS DOUBLE) >= threshold_value END "
    "ELSE CASE WHEN threshold_type = 'percent' THEN coalesce(CAST(ca - st AS DOUBLE) >= CAST(dl - st AS DOUBLE) * "
    "threshold_value / 100.0, true) ELSE CAST(ca - st AS DOUBLE) >= threshold_value END END, false) "
    "AND ((len(target_names) = 0 AND cardinality(target_tags) = 0) OR list_contains(target_names, name) OR "
    "(cardinality(target_tags) > 0 AND list_bool_and(list_transform(map_entries(target_tags), lambda e: "
    + _tag_has("e.key", "e.value") + "))))", _rules_sql()))
def rule_match_q(t: Tables):
    return R.match_rules(t.runs, fixture_rules(t.spark), t.as_of)
