"""Catalogue: batch twins of streaming operators, and rows for operators that other queries use inside
(SURVEY §2.K5, K7, K8, B11, B24, C13, C14, D7, J5)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from duewatch.functions import jsoncols as J
from duewatch.operators import filters as FL
from duewatch.operators import lifecycle as LC
from duewatch.operators import listing as L
from duewatch.operators import metrics as M
from duewatch.operators import scans as S
from duewatch.operators import windows as WN
from duewatch.operators.ordering import top_k
from duewatch.operators.scans import MISSED_EVENT, WARNING_EVENT
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register
from duewatch.plans.q_lifecycle import CMDS_VIEW
from duewatch.plans.q_metrics import EV_COUNT_SQL, EVENTS_VIEW
from duewatch.streaming.counters import stream_counters
from duewatch.streaming.deadlines import deadline_events_batch
from duewatch.streaming.runs import outbox_batch


_SQL = f"""
SELECT name, process_id, run_seq, ev.event AS event, ev.fire AS fire_at_ms FROM (
  SELECT name, process_id, seq AS run_seq, end_ms,
         unnest([{{'event': '{WARNING_EVENT}', 'fire': warn_ms}}, {{'event': '{MISSED_EVENT}', 'fire': dl_ms}}]) AS ev
  FROM (
    SELECT *, CASE WHEN dl_ms > st_ms THEN st_ms + CAST(floor((dl_ms - st_ms) * CAST(0.75 AS DOUBLE)) AS BIGINT) END AS warn_ms
    FROM (
      SELECT *, CAST(floor(ts_us / 1000.0) AS BIGINT) AS st_ms, CAST(floor(deadline_us / 1000.0) AS BIGINT) AS dl_ms,
             lead(CAST(floor(ts_us / 1000.0) AS BIGINT)) OVER (PARTITION BY name, process_id, lvl ORDER BY seq) AS end_ms
      FROM (SELECT *, CASE WHEN kind = 'create' THEN rows_after ELSE rows_before END AS lvl
            FROM decisions WHERE reason IS NULL) a
    ) b WHERE kind = 'create' AND deadline_us IS NOT NULL
  ) c
) d WHERE ev.fire IS NOT NULL AND (end_ms IS NULL OR end_ms > ev.fire)"""


@register("stream_deadline_events", O.with_views(_SQL, CMDS_VIEW))
def stream_deadline_events_q(t: Tables):
    return deadline_events_batch(t.commands, 0.75)


_HISTORY_VIEW = """history AS (
  SELECT * FROM (
    SELECT *, lead(struct_pack(kind := kind, ts_us := ts_us, status := status)) OVER (PARTITION BY name, process_id, lvl ORDER BY seq) AS e
    FROM (SELECT *, CASE WHEN kind = 'create' THEN rows_after ELSE rows_before END AS lvl FROM decisions WHERE reason IS NULL) a
  ) b WHERE kind = 'create'
)"""
_DONE = "e.kind = 'complete'"


@register("lifecycle_history", O.with_views(
    f"SELECT seq AS id, name, process_id, CASE WHEN {_DONE} THEN e.status ELSE 'ACTIVE' END AS status, {O.sec('ts_us')} AS started_at, "
    f"CASE WHEN {_DONE} THEN {O.sec('e.ts_us')} END AS completed_at, {O.sec('deadline_us')} AS deadline, tags, context, e.kind AS ended_by, "
    f"{O.sec('e.ts_us')} AS ended_at FROM history", CMDS_VIEW, _HISTORY_VIEW))
def lifecycle_history_q(t: Tables):
    h = LC.run_history(LC.decide(t.commands))
    times = ("started_at", "completed_at", "deadline", "ended_at")
    return h.select("id", "name", "process_id", "status", *[F.unix_seconds(c).alias(c) for c in times], "tags", "context", "ended_by")


@register("lifecycle_log_counters", O.with_views(
    "SELECT name, count(*) AS created, " + ", ".join(
        f"count(*) FILTER (WHERE {_DONE} AND {cond}) AS {c}" for c, cond in {
            "completed": "e.status = 'COMPLETED'", "failed": "e.status = 'FAILED'",
            "on_time": "e.status = 'COMPLETED' AND e.ts_us <= deadline_us", "late": "e.status = 'COMPLETED' AND e.ts_us > deadline_us"}.items())
    + " FROM history GROUP BY name", CMDS_VIEW, _HISTORY_VIEW))
def lifecycle_log_counters_q(t: Tables):
    return M.lifecycle_counters(LC.run_history(LC.decide(t.commands)))


@register("lifecycle_log_timers", O.with_views(
    "SELECT name, e.status AS status, count(*) AS count, CAST(sum(CAST(floor((e.ts_us - ts_us) / 1000.0) AS BIGINT)) AS BIGINT) AS sum_ms, "
    "max(CAST(floor((e.ts_us - ts_us) / 1000.0) AS BIGINT)) AS max_ms "
    f"FROM history WHERE {_DONE} GROUP BY name, e.status", CMDS_VIEW, _HISTORY_VIEW))
def lifecycle_log_timers_q(t: Tables):
    return M.duration_timer(LC.run_history(LC.decide(t.commands)))


def _stream_payload(event: str, remaining: str | None) -> str:
    fields = [f"'event', '{event}'", "'name', f.name", "'id', f.process_id", f"'started_at', {O.sec('c.ts_us')}",
              f"'deadline', {O.sec('c.deadline_us')}", *([f"'seconds_remaining', {remaining}"] if remaining else []),
              "'tags', json(c.tags)", "'context', json(c.context)",
              "'url', 'https://status.example.com/?process=' || url_encode(f.name) || '/' || url_encode(f.process_id)"]
    return f"CAST(json_object({', '.join(fields)}) AS VARCHAR)"


_FIRED = "CAST(floor(f.fire_at_ms / 1000.0) AS BIGINT)"


@register("stream_outbox", O.with_views(
    f"SELECT f.run_seq AS id, f.event, f.name, f.process_id, CASE WHEN f.event = '{WARNING_EVENT}' "
    f"THEN {_stream_payload(WARNING_EVENT, O.sec('c.deadline_us') + ' - ' + _FIRED)} ELSE {_stream_payload(MISSED_EVENT, None)} END AS payload, "
    f"{_FIRED} AS emitted_at, md5(CAST(f.run_seq AS VARCHAR) || '|' || f.event) AS event_key FROM ({_SQL}) f JOIN all_cmds c ON c.seq = f.run_seq",
    CMDS_VIEW))
def stream_outbox_q(t: Tables):
    return outbox_batch(t.commands, 0.75, "https://status.example.com/")


@register("stream_counters", O.with_views(EV_COUNT_SQL, EVENTS_VIEW))
def stream_counters_q(t: Tables):
    return stream_counters(S.deadline_events(t.runs, t.as_of, 0.75))


@register("gauge_snapshot", O.with_views(
    f"SELECT name, count(*) FILTER (WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {O.AS_OF}) AS overdue, "
    "count(*) FILTER (WHERE status = 'ACTIVE') AS active FROM runs GROUP BY name"))
def gauge_snapshot_q(t: Tables):
    earlier = M.gauge_snapshot(t.runs, t.as_of - timedelta(days=30))
    return M.gauge_snapshot(t.runs, t.as_of, earlier)


@register("context_to_json", O.with_views(
    "SELECT id, CAST(CASE WHEN id % 4 = 1 THEN json_object('customer', context ->> 'customer', 'nested', context ->> 'nested', 'ok', context ->> 'ok', "
    "'ratio', context ->> 'ratio') ELSE json_object('customer', context ->> 'customer') END AS VARCHAR) AS context_json FROM runs"))
def context_to_json_q(t: Tables):
    return t.runs.select("id", J.context_to_json(J.parse_context("context")).alias("context_json"))


@register("normalized_response", O.with_views(
    f"SELECT process_id AS id, CASE WHEN id % 2 = 0 AND {O.IS_TAGS} THEN tags ELSE '[]' END AS tags_json, "
    "CASE WHEN id % 3 = 0 THEN context ->> 'customer' END AS customer FROM runs"))
def normalized_response_q(t: Tables):
    r = L.run_response(t.runs.withColumnRenamed("id", "run"), t.as_of, "run")
    partial = r.withColumn("tags", F.when(F.col("run") % 2 == 0, F.col("tags"))) \
               .withColumn("context", F.when(F.col("run") % 3 == 0, F.col("context")))
    return L.normalize(partial).select("id", F.to_json("tags").alias("tags_json"),
                                       F.try_variant_get("context", "$.customer", "string").alias("customer"))


@register("approaching_first50", O.with_views(O.ordered(
    f"runs WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us <= {O.AS_OF} + 24 * {O.HOUR_US}",
    "deadline_us, id", 50, cols="id")))
def approaching_first_q(t: Tables):
    return top_k(FL.approaching(t.runs, t.as_of, 24), [F.col("deadline"), F.col("id")], 50).select("id", "pos")


@register("active_newest50", O.with_views(O.ordered("runs WHERE status = 'ACTIVE'", "started_us DESC, id DESC", 50, cols="id")))
def active_newest_q(t: Tables):
    return top_k(FL.active_runs(t.runs), [F.col("started_at").desc(), F.col("id").desc()], 50).select("id", "pos")


# Two exports merged without care: runs of every tenth id come twice, and some statuses are outside the domain.
@register("duplicate_active_merged", O.with_views(
    "SELECT name, process_id, count(*) AS active_runs FROM (SELECT * FROM runs UNION ALL SELECT * FROM runs WHERE id % 10 = 0) m "
    "WHERE status = 'ACTIVE' GROUP BY name, process_id HAVING count(*) > 1"))
def duplicate_active_merged_q(t: Tables):
    return WN.duplicate_active(t.runs.unionByName(t.runs.where("id % 10 = 0")))


@register("status_violations_merged", O.with_views(
    "SELECT id, CASE WHEN id % 211 = 0 THEN 'PAUSED' END AS status FROM runs WHERE id % 211 = 0 OR id % 223 = 0"))
def status_violations_merged_q(t: Tables):
    merged = t.runs.withColumn("status", F.when(F.col("id") % 211 == 0, "PAUSED")
                               .when(F.col("id") % 223 == 0, F.lit(None)).otherwise(F.col("status")))
    return LC.status_violations(merged).select("id", "status")
