"""Catalogue: request ingest, validation and the lifecycle fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.operators import lifecycle as LC
from duewatch.operators.metrics import operation_counters
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register
from duewatch.plans.q_columns import _http_view
from duewatch.sources.fixtures import ODD_BODIES, ODD_COMPLETES, ODD_EVERY
from duewatch.sources.requests import parse_complete_requests, parse_create_requests

HOUR_US = O.HOUR_US


def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + "]"


# The twin gets the same raw bodies and reads them with DuckDB's own JSON functions, which refuse text behind a value.
_PLAIN = "('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN', 'NULL')"
CREATE_REQ_VIEW = f"""create_raw AS (
  SELECT event_id AS request_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS received_s,
         CASE WHEN event_type = 'view' AND user_id % 4 = 1 THEN ' ' WHEN event_type = 'view' AND user_id % 4 = 3 THEN chr(9)
              WHEN event_type = 'purchase' AND event_id % 37 = 0 THEN 'purchase' || chr(10) ELSE event_type END AS name,
         CASE WHEN event_type = 'click' AND user_id % 13 = 0 THEN '{{broken'
              WHEN event_type = 'purchase' AND event_id % {ODD_EVERY} < {len(ODD_BODIES)}
              THEN replace({_sql_list(ODD_BODIES)}[event_id % {ODD_EVERY} + 1], '{{id}}', CAST(event_id AS VARCHAR))
              ELSE '{{"id":"' || CASE WHEN event_type = 'click' THEN 'u' ELSE 'user-' END || CAST(user_id AS VARCHAR) || '","deadline":'
                   || CAST(received_s + (CAST(floor(value * 60) AS BIGINT) - 600) AS VARCHAR) || ',"tags":['
                   || CASE WHEN event_type = 'error' THEN '{{"key":"k","value":" "}},' ELSE '' END
                   || '{{"key":"k","value":"' || (props ->> 'k') || '"}}],"context":{{"event":' || CAST(event_id AS VARCHAR) || '}}}}' END AS body
  FROM events
),
create_json AS (
  SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM create_raw
),
create_ok AS (
  SELECT *, coalesce(json_type(j) = 'OBJECT'
      AND coalesce(json_type(j, '$.id') IN {_PLAIN}, true)
      AND coalesce(json_type(j, '$.deadline') IN ('BIGINT', 'UBIGINT', 'NULL') AND try_cast(j ->> '$.deadline' AS BIGINT) IS NOT NULL
                   OR json_type(j, '$.deadline') = 'NULL'
                   OR json_type(j, '$.deadline') = 'VARCHAR' AND regexp_full_match(j ->> '$.deadline', '-?[0-9]{{1,19}}'), true)
      AND coalesce(json_type(j, '$.context') IN ('OBJECT', 'NULL'), true)
      AND coalesce(json_type(j, '$.tags') = 'NULL' OR json_type(j, '$.tags') = 'ARRAY' AND len(list_filter(CAST(json_extract(j, '$.tags[*]') AS JSON[]),
           lambda t: json_type(t) <> 'NULL' AND NOT (json_type(t) = 'OBJECT' AND coalesce(json_type(t, '$.key') IN {_PLAIN}, true)
                     AND coalesce(json_type(t, '$.value') IN {_PLAIN}, true)))) = 0, true), false) AS ok
  FROM create_json
),
create_req AS (
  SELECT request_id, name, received_s, NOT ok AS unreadable, CASE WHEN ok THEN j ->> '$.id' END AS id,
         CASE WHEN ok THEN try_cast(j ->> '$.deadline' AS BIGINT) END AS deadline,
         CASE WHEN ok AND json_type(j, '$.tags') = 'ARRAY' THEN list_transform(CAST(json_extract(j, '$.tags[*]') AS JSON[]),
              lambda t: {{'key': t ->> '$.key', 'value': t ->> '$.value'}}) END AS tags,
         CASE WHEN ok THEN j ->> '$.context.event' END AS context_event
  FROM create_ok
)"""


@register("ingest_create_requests", O.with_views(
    "SELECT request_id, name, id, deadline, CAST(len(tags) AS INTEGER) AS tag_count, tags[-1].value AS last_tag_value, "
    "CAST(context_event AS VARCHAR) AS context_event, unreadable FROM create_req", CREATE_REQ_VIEW))
def ingest_create_q(t: Tables):
    r = parse_create_requests(t.create_requests)
    return r.select("request_id", "name", "id", "deadline", F.size("tags").alias("tag_count"),
                    F.element_at("tags", -1)["value"].alias("last_tag_value"),
                    F.col("context")["event"].alias("context_event"), "unreadable")


COMPLETE_VIEW = f"""complete_raw AS (
  SELECT event_id AS request_id, 'user-' || CAST(user_id AS VARCHAR) AS process_id,
         CASE WHEN event_id % 29 = 0 THEN {_sql_list(ODD_COMPLETES)}[(event_id // 29) % {len(ODD_COMPLETES)} + 1]
              WHEN user_id % 17 = 0 THEN '{{broken' WHEN user_id % 19 = 0 THEN '"completed"' WHEN user_id % 23 = 0 THEN '{{"status":"DONE"}}'
              WHEN event_type = 'purchase' THEN '{{"status":"COMPLETED"}}' WHEN event_type = 'error' THEN '{{"status":"FAILED"}}'
              WHEN event_type = 'view' THEN '{{"status":"ACTIVE"}}' END AS body
  FROM events WHERE event_type <> 'signup'
),
complete_req AS (
  SELECT request_id, process_id, NOT ok AS unreadable, CASE WHEN ok THEN coalesce(j ->> '$.status', 'COMPLETED') END AS status
  FROM (SELECT *, body IS NULL OR trim(body) = '' OR coalesce(json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.status') IN ('VARCHAR', 'NULL'), true), false) AS ok
        FROM (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM complete_raw) r) r
)"""


@register("ingest_complete_requests", O.with_views("SELECT request_id, process_id, status, unreadable FROM complete_req",
                                                   COMPLETE_VIEW))
def ingest_complete_q(t: Tables):
    return parse_complete_requests(t.complete_requests).select("request_id", "process_id", "status", "unreadable")


def _blank(c: str) -> str:
    return f"({c} IS NULL OR regexp_full_match({c}, '[\\x00-\\x20]*'))"


def _first_bad_tag_sql(checks: list[tuple[str, str]]) -> str:
    case = "CASE " + " ".join(f"WHEN {cond} THEN '{r}'" for cond, r in checks) + " END"
    return f"list_filter(list_transform(tags, lambda t: {case}), lambda r: r IS NOT NULL)[1]"


_CREATE_TAG = _first_bad_tag_sql([
    (_blank("t.key"), "tag_key_blank"), (_blank("t.value"), "tag_value_blank"),
    ("length(t.key) > 50", "tag_key_too_long"), ("length(t.value) > 100", "tag_value_too_long")])


@register("validate_create", O.with_views(
    f"SELECT request_id, reason, CASE WHEN reason IS NOT NULL THEN 400 END AS code FROM ("
    f"SELECT request_id, CASE WHEN unreadable THEN 'body_unreadable' WHEN {_blank('name')} THEN 'name_blank' "
    "WHEN length(name) > 100 THEN 'name_too_long' "
    f"WHEN {_blank('id')} THEN 'id_blank' WHEN length(id) > 50 THEN 'id_too_long' "
    "WHEN deadline IS NOT NULL AND deadline <= 0 THEN 'deadline_not_positive' "
    "WHEN deadline IS NOT NULL AND deadline < received_s - 60 THEN 'deadline_in_past' "
    f"WHEN tags IS NOT NULL AND len(tags) > 20 THEN 'too_many_tags' ELSE {_CREATE_TAG} END AS reason "
    "FROM create_req) v", CREATE_REQ_VIEW))
def validate_create_q(t: Tables):
    r = parse_create_requests(t.create_requests)
    reason = LC.validate_create(r)
    return r.select("request_id", reason.alias("reason"), LC.error_code(reason).alias("code"))


_EDGE_TAG = _first_bad_tag_sql([
    (f"{_blank('t.key')} OR length(t.key) > 50", "tag_key_invalid"),
    (f"{_blank('t.value')} OR length(t.value) > 100", "tag_value_invalid")])


@register("validate_edge", O.with_views(
    f"SELECT request_id, CASE WHEN {_blank('name')} THEN 'name_required' "
    "WHEN length(name) < 1 OR length(name) > 100 THEN 'name_length' "
    "WHEN NOT regexp_full_match(name, '[a-zA-Z0-9_-]+') THEN 'name_pattern' "
    f"WHEN {_blank('id')} THEN 'id_required' WHEN length(id) < 3 OR length(id) > 50 THEN 'id_length' "
    f"WHEN deadline IS NOT NULL AND deadline < 0 THEN 'deadline_negative' ELSE {_EDGE_TAG} END AS reason "
    "FROM create_req", CREATE_REQ_VIEW))
def validate_edge_q(t: Tables):
    r = parse_create_requests(t.create_requests)
    return r.select("request_id", LC.validate_edge(r).alias("reason"))


@register("validate_complete", O.with_views(
    "SELECT request_id, CASE WHEN unreadable THEN 'body_unreadable' WHEN status = 'ACTIVE' THEN 'status_active' "
    "WHEN status NOT IN ('COMPLETED', 'FAILED') THEN 'status_invalid' END AS reason FROM complete_req", COMPLETE_VIEW))
def validate_complete_q(t: Tables):
    r = parse_complete_requests(t.complete_requests)
    return r.select("request_id", LC.validate_complete(F.col("status"), F.col("unreadable")).alias("reason"))


@register("validate_lookup", O.with_views(
    f"SELECT request_id, CASE WHEN {_blank('name')} THEN 'name_blank' WHEN length(name) > 100 THEN 'name_too_long' "
    f"WHEN {_blank('id')} THEN 'id_blank' WHEN length(id) > 50 THEN 'id_too_long' END AS reason FROM create_req",
    CREATE_REQ_VIEW))
def validate_lookup_q(t: Tables):
    r = parse_create_requests(t.create_requests)
    return r.select("request_id", LC.validate_lookup(F.col("name"), F.col("id")).alias("reason"))


@register("status_violations", O.with_views(
    "SELECT id, status FROM runs WHERE status IS NULL OR status NOT IN ('ACTIVE', 'COMPLETED', 'FAILED')"))
def status_violations_q(t: Tables):
    return LC.status_violations(t.runs).select("id", "status")


CMDS_VIEW = f"""all_cmds AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, CASE WHEN user_id % 3 = 0 THEN 'trial' ELSE 'journey' END AS name,
         'user-' || CAST(user_id AS VARCHAR) AS process_id,
         CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type IN ('purchase', 'error') THEN 'complete'
              WHEN event_type = 'view' AND user_id % 5 = 0 THEN 'delete'
              WHEN event_type = 'click' AND user_id % 11 = 0 THEN 'pause' END AS kind,
         CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status,
         CASE WHEN event_type = 'signup' THEN epoch_us(ts) + 6 * {HOUR_US} END AS deadline_us,
         CASE WHEN event_type = 'signup' THEN '[{{"key":"k","value":"' || (props ->> 'k') || '"}}]' END AS tags,
         CASE WHEN event_type = 'signup' THEN '{{"event":' || CAST(event_id AS VARCHAR) || '}}' END AS context
  FROM events
),
cmds AS (SELECT * FROM all_cmds WHERE kind IN ('create', 'complete', 'delete')),
d1 AS (
  SELECT *, coalesce(lag(kind) OVER (PARTITION BY name, process_id ORDER BY seq) = 'create', false) AS active FROM cmds
),
d2 AS (
  SELECT *, sum(CASE WHEN kind = 'create' AND NOT active THEN 1 WHEN kind = 'delete' THEN -1 ELSE 0 END)
         OVER (PARTITION BY name, process_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d1
),
d3 AS (
  SELECT *, cum - least(0, min(cum) OVER (PARTITION BY name, process_id ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS rows_after FROM d2
),
decisions AS (
  SELECT *, coalesce(lag(rows_after) OVER (PARTITION BY name, process_id ORDER BY seq), 0) AS rows_before,
         CASE WHEN kind = 'create' AND active THEN 'already_exists'
              WHEN kind = 'complete' AND NOT active AND coalesce(lag(rows_after) OVER (PARTITION BY name, process_id ORDER BY seq), 0) = 0 THEN 'not_found'
              WHEN kind = 'complete' AND NOT active THEN 'already_completed'
              WHEN kind = 'delete' AND coalesce(lag(rows_after) OVER (PARTITION BY name, process_id ORDER BY seq), 0) = 0 THEN 'not_found' END AS reason
  FROM d3
)"""


@register("lifecycle_decisions", O.with_views(
    "SELECT seq, name, process_id, kind, active AS active_before, CAST(rows_before AS BIGINT) AS rows_before, "
    "CAST(rows_after AS BIGINT) AS rows_after, reason IS NULL AS accepted, reason, "
    "CASE WHEN reason IN ('already_exists', 'already_completed') THEN 409 WHEN reason = 'not_found' THEN 404 "
    "WHEN kind = 'create' THEN 201 WHEN kind = 'complete' THEN 200 ELSE 204 END AS code FROM decisions "
    "UNION ALL SELECT seq, name, process_id, kind, NULL, NULL, NULL, false, 'unknown_command', 400 FROM all_cmds WHERE kind = 'pause'",
    CMDS_VIEW))
def lifecycle_decisions_q(t: Tables):
    d = LC.decide(t.commands)
    return d.select("seq", "name", "process_id", "kind", "active_before", "rows_before", "rows_after",
                    "accepted", "reason", "code")


@register("lifecycle_runs", O.with_views(
    "SELECT c.seq AS id, c.process_id, c.name, CASE WHEN f.seq IS NULL THEN 'ACTIVE' ELSE f.status END AS status, "
    f"{O.sec('c.ts_us')} AS started_at, {O.sec('f.ts_us')} AS completed_at, {O.sec('c.deadline_us')} AS deadline, "
    "c.tags, c.context FROM decisions c LEFT JOIN LATERAL (SELECT * FROM decisions n WHERE n.name = c.name AND n.process_id = c.process_id "
    "AND n.seq > c.seq AND n.kind <> 'create' ORDER BY n.seq LIMIT 1) f ON f.kind = 'complete' "
    "WHERE c.kind = 'create' AND c.reason IS NULL AND NOT EXISTS (SELECT 1 FROM decisions l WHERE l.reason IS NULL "
    "AND l.name = c.name AND l.process_id = c.process_id AND l.seq > c.seq AND l.kind IN ('create', 'delete') "
    "AND (CASE WHEN l.kind = 'create' THEN l.rows_after ELSE l.rows_before END) = c.rows_after)", CMDS_VIEW))
def lifecycle_runs_q(t: Tables):
    _, runs = LC.fold_commands(t.commands)
    return runs.select("id", "process_id", "name", "status", F.unix_seconds("started_at").alias("started_at"),
                       F.unix_seconds("completed_at").alias("completed_at"),
                       F.unix_seconds("deadline").alias("deadline"), "tags", "context")


OPERATIONS_SQL = (
    "SELECT CASE WHEN kind = 'create' THEN 'create' WHEN kind = 'complete' AND reason IS NULL THEN 'update' "
    "WHEN kind = 'delete' AND reason IS NULL THEN 'delete' END AS operation, "
    "CASE WHEN kind = 'create' THEN reason IS NULL ELSE true END AS success FROM decisions "
    "UNION ALL SELECT 'read', status < 500 FROM http_requests WHERE method = 'GET'")


@register("operation_counters", O.with_views(
    f"SELECT operation, 'processes' AS \"table\", success, count(*) AS count FROM ({OPERATIONS_SQL}) o "
    "WHERE operation IS NOT NULL GROUP BY ALL", CMDS_VIEW, _http_view()))
def operation_counters_q(t: Tables):
    d = LC.decide(t.commands)
    return operation_counters(LC.operation_results(d).unionByName(LC.read_results(t.http_requests)))
