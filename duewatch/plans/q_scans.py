"""Catalogue: deadline scans, marking, outbox and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.operators import scans as S
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register
from duewatch.plans.q_analytics import MISSED_SQL, _warning_sql
from duewatch.sources.outbox import outbox_rows

AS_OF = O.AS_OF


def _payload_sql(event: str, warning: bool, url: str | None = None) -> str:
    def raw(c):
        return (f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN NULL WHEN json_valid({c}) THEN json({c}) "
                f"ELSE to_json({c}) END")
    parts = [f"'event', '{event}'", "'name', name", "'id', process_id",
             f"'started_at', {O.sec('started_us')}", f"'deadline', {O.sec('deadline_us')}"]
    if warning:
        parts.append(f"'seconds_remaining', {O.sec('deadline_us')} - {O.sec(AS_OF)}")
    parts += [f"'tags', {raw('tags')}", f"'context', {raw('context')}"]
    if url:
        parts.append(f"'url', '{url.rstrip('/')}/?process=' || url_encode(name) || '/' || url_encode(process_id)")
    return "CAST(json_object(" + ", ".join(parts) + ") AS VARCHAR)"


def _scan_sql(where: str, event: str, warning: bool, batch: int | None) -> str:
    sr = f"{O.sec('deadline_us')} - {O.sec(AS_OF)}" if warning else "CAST(NULL AS BIGINT)"
    cols = (f"id, name, process_id, '{event}' AS event, {O.sec('deadline_us')} AS deadline, {sr} AS seconds_remaining, "
            f"{_payload_sql(event, warning)} AS payload")
    if batch is None:
        return f"SELECT {cols} FROM runs WHERE {where}"
    return O.ordered(f"runs WHERE {where}", "deadline_us ASC, id ASC", batch, cols=cols)


@register("missed_scan", O.with_views(_scan_sql(MISSED_SQL, S.MISSED_EVENT, False, 500)))
def missed_scan_q(t: Tables):
    return S.missed_scan(t.runs, t.as_of, 500)


@register("missed_scan_batch", O.with_views(_scan_sql(MISSED_SQL, S.MISSED_EVENT, False, 25)))
def missed_scan_batch_q(t: Tables):
    return S.missed_scan(t.runs, t.as_of, 25)


@register("warning_scan", O.with_views(_scan_sql(_warning_sql(0.75), S.WARNING_EVENT, True, 500)))
def warning_scan_q(t: Tables):
    return S.warning_scan(t.runs, t.as_of, 0.75, 500)


@register("warning_scan_50", O.with_views(_scan_sql(_warning_sql(0.5), S.WARNING_EVENT, True, 500)))
def warning_scan_50_q(t: Tables):
    return S.warning_scan(t.runs, t.as_of, 0.5, 500)


@register("warning_scan_off", O.with_views(_scan_sql("false", S.WARNING_EVENT, True, 500)))
def warning_scan_off_q(t: Tables):
    return S.warning_scan(t.runs, t.as_of, 1.0, 500)


@register("deadline_events", O.with_views(
    f"SELECT * FROM ({_scan_sql(_warning_sql(0.75), S.WARNING_EVENT, True, None)}) w "
    f"UNION ALL SELECT * FROM ({_scan_sql(MISSED_SQL, S.MISSED_EVENT, False, None)}) m"))
def deadline_events_q(t: Tables):
    return S.deadline_events(t.runs, t.as_of, 0.75)


def _mark_sql(col_us: str, where: str) -> str:
    return O.with_views(
        f"SELECT id, {O.sec(f'CASE WHEN hit THEN {AS_OF} ELSE {col_us} END')} AS marked_at, "
        f"{O.sec(f'CASE WHEN hit THEN {AS_OF} ELSE updated_us END')} AS updated_at FROM "
        f"(SELECT r.*, b.id IS NOT NULL AS hit FROM runs r LEFT JOIN "
        f"(SELECT id FROM runs WHERE {where} ORDER BY deadline_us, id LIMIT 500) b ON r.id = b.id) x")


@register("mark_notified", _mark_sql("notified_us", MISSED_SQL))
def mark_notified_q(t: Tables):
    batch = S.missed_scan(t.runs, t.as_of, 500).select("id")
    m = S.mark(t.runs, batch, "deadline_notified_at", t.as_of)
    return m.select("id", F.unix_seconds("deadline_notified_at").alias("marked_at"),
                    F.unix_seconds("updated_at").alias("updated_at"))


@register("mark_warned", _mark_sql("warned_us", _warning_sql(0.75)))
def mark_warned_q(t: Tables):
    batch = S.warning_scan(t.runs, t.as_of, 0.75, 500).select("id")
    m = S.mark(t.runs, batch, "deadline_warned_at", t.as_of)
    return m.select("id", F.unix_seconds("deadline_warned_at").alias("marked_at"),
                    F.unix_seconds("updated_at").alias("updated_at"))


ATTEMPTS_VIEW = """attempts AS (
  SELECT user_id AS scan_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos,
         event_id AS run_id, event_type IN ('signup', 'purchase') AS delivered
  FROM events
)"""


@register("delivery_circuit_breaker", O.with_views(
    "SELECT scan_id, pos, run_id, stop IS NOT NULL AS tripped FROM ("
    "SELECT *, min(CASE WHEN streak >= 5 THEN pos END) OVER (PARTITION BY scan_id) AS stop FROM ("
    "SELECT *, sum(CASE WHEN delivered THEN 0 ELSE 1 END) OVER (PARTITION BY scan_id, island ORDER BY pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM ("
    "SELECT *, sum(CASE WHEN delivered THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM attempts) a) b) c "
    "WHERE delivered AND (stop IS NULL OR pos < stop)", ATTEMPTS_VIEW))
def circuit_breaker_q(t: Tables):
    return S.circuit_breaker(t.delivery_attempts)


def _outbox_sql() -> str:
    ev = (f"SELECT * FROM ({_scan_sql(_warning_sql(0.75), S.WARNING_EVENT, True, None)}) w "
          f"UNION ALL SELECT * FROM ({_scan_sql(MISSED_SQL, S.MISSED_EVENT, False, None)}) m")
    return (f"SELECT id, event, name, process_id, payload, {O.sec(AS_OF)} AS emitted_at, "
            "md5(CAST(id AS VARCHAR) || '|' || event) AS event_key FROM (" + ev + ") e")


@register("notification_outbox", O.with_views(_outbox_sql()))
def outbox_q(t: Tables):
    return outbox_rows(S.deadline_events(t.runs, t.as_of, 0.75), t.as_of)


# Acknowledgements of the fixture: the deliverer has confirmed these (id, event) pairs.
@register("pending_deliveries", O.with_views(
    f"SELECT e.id, e.event FROM ({_outbox_sql()}) e WHERE NOT (e.id % 5 < 2 AND e.event = '{S.MISSED_EVENT}' "
    f"OR e.id % 7 = 0 AND e.event = '{S.WARNING_EVENT}')"))
def pending_q(t: Tables):
    out = outbox_rows(S.deadline_events(t.runs, t.as_of, 0.75), t.as_of)
    acks = out.where(((F.col("id") % 5 < 2) & (F.col("event") == S.MISSED_EVENT))
                     | ((F.col("id") % 7 == 0) & (F.col("event") == S.WARNING_EVENT))).select("id", "event")
    return S.pending_deliveries(out, acks).select("id", "event")


def _pass_sql(enabled: bool) -> str:
    events = (f"SELECT * FROM ({_scan_sql(_warning_sql(0.75), S.WARNING_EVENT, True, 500)}) w "
              f"UNION ALL SELECT * FROM ({_scan_sql(MISSED_SQL, S.MISSED_EVENT, False, 500)}) m")
    if not enabled:
        return O.with_views(f"SELECT id, event, {O.sec(AS_OF)} AS marked_at FROM ({events}) e")
    return O.with_views(
        f"SELECT id, event, {O.sec(AS_OF)} AS marked_at FROM (SELECT *, min(CASE WHEN streak >= 5 THEN pos END) OVER "
        "(PARTITION BY event) AS stop FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event, island "
        "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM (SELECT *, sum(CASE WHEN ok THEN 1 "
        "ELSE 0 END) OVER (PARTITION BY event ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM "
        f"(SELECT *, id % 2 = 0 AS ok FROM ({events}) e) a) b) c) d WHERE ok AND (stop IS NULL OR pos < stop)")


@register("deadline_pass", _pass_sql(True))
def deadline_pass_q(t: Tables):
    # The fixture's deliverer gets even ids through.
    through = S.deadline_events(t.runs, t.as_of, 0.75).where("id % 2 = 0").select("id", "event")
    return S.deadline_pass(t.runs, through, t.as_of)


@register("deadline_pass_disabled", _pass_sql(False))
def deadline_pass_disabled_q(t: Tables):
    return S.deadline_pass(t.runs, t.runs.limit(0).select("id"), t.as_of, enabled=False)
