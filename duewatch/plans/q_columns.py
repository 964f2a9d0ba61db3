"""Catalogue: per-run projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.functions import columns as C
from duewatch.functions import jsoncols as J
from duewatch.functions import text as X
from duewatch.operators.listing import run_response
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register
from duewatch.sources.runs import upgrade_runs

AS_OF = O.AS_OF
TAGS_JSON_SQL = f"CASE WHEN {O.IS_TAGS} THEN tags ELSE '[]' END"
PUBLIC_URL = "https://deadlines.example.test/app/"


def _sql(select: str, frm: str = "runs", *views: str) -> str:
    return O.with_views(f"SELECT {select} FROM {frm}", *views)


# -- A1 / A7 -------------------------------------------------------------------

@register("runs_scan", _sql(
    f"id, process_id, name, status, {O.sec('started_us')} AS started_at, {O.sec('completed_us')} AS completed_at, "
    f"{O.sec('deadline_us')} AS deadline, tags, context, {O.sec('notified_us')} AS deadline_notified_at, "
    f"{O.sec('warned_us')} AS deadline_warned_at"))
def runs_scan(t: Tables):
    r = t.runs
    return r.select("id", "process_id", "name", "status",
                    *[F.unix_seconds(c).alias(c) for c in ("started_at", "completed_at", "deadline")],
                    "tags", "context",
                    *[F.unix_seconds(c).alias(c) for c in ("deadline_notified_at", "deadline_warned_at")])


@register("runs_upgrade", _sql(
    "id, CAST(NULL AS BIGINT) AS namespace_id, CAST(NULL AS BIGINT) AS deadline_notified_at, "
    "CAST(NULL AS BIGINT) AS deadline_warned_at, status"))
def runs_upgrade(t: Tables):
    # A V2-era frame: the three later columns are absent and come back null.
    old = t.runs.drop("namespace_id", "deadline_notified_at", "deadline_warned_at")
    up = upgrade_runs(old)
    return up.select("id", "namespace_id", F.unix_seconds("deadline_notified_at").alias("deadline_notified_at"),
                     F.unix_seconds("deadline_warned_at").alias("deadline_warned_at"), "status")


# -- B1 – B17 ------------------------------------------------------------------

@register("run_response", _sql(
    f"process_id AS id, name, status, {O.DEADLINE_STATUS} AS deadline_status, "
    f"{O.sec('started_us')} AS started_at, {O.sec('completed_us')} AS completed_at, {O.sec('deadline_us')} AS deadline, "
    f"{O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')} AS duration, "
    f"{TAGS_JSON_SQL} AS tags_json, context ->> 'customer' AS context_customer, context AS context_json, "
    "json_type(context, '$.ok') AS ok_type, CAST(context ->> '$.ratio' AS DOUBLE) AS ratio"))
def run_response_q(t: Tables):
    r = run_response(t.runs, t.as_of)
    return r.select("id", "name", "status", "deadline_status", "started_at", "completed_at", "deadline",
                    "duration", F.to_json("tags").alias("tags_json"),
                    F.try_variant_get("context", "$.customer", "string").alias("context_customer"), F.to_json("context").alias("context_json"),
                    F.schema_of_variant(F.try_variant_get("context", "$.ok", "variant")).alias("ok_type"),
                    F.try_variant_get("context", "$.ratio", "double").alias("ratio"))


@register("deadline_status", _sql(f"id, {O.DEADLINE_STATUS} AS deadline_status"))
def deadline_status_q(t: Tables):
    return t.runs.select("id", C.deadline_status(t.as_of).alias("deadline_status"))


@register("outcome_classify", _sql(f"id, {O.OUTCOME} AS outcome"))
def outcome_q(t: Tables):
    return t.runs.select("id", C.outcome(t.as_of).alias("outcome"))


@register("run_duration", _sql(
    f"id, {O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')} AS duration, "
    f"{O.COMPLETED_DUR} AS completed_duration"))
def run_duration_q(t: Tables):
    return t.runs.select("id", C.duration_s(t.as_of).alias("duration"),
                         C.completed_duration().alias("completed_duration"))


@register("is_overdue", _sql(
    f"id, coalesce(status = 'ACTIVE' AND deadline_us IS NOT NULL AND {AS_OF} > deadline_us, false) AS is_overdue"))
def is_overdue_q(t: Tables):
    return t.runs.select("id", C.is_overdue(t.as_of).alias("is_overdue"))


@register("parse_tags", _sql(
    f"id, CAST(CASE WHEN {O.IS_TAGS} THEN json_array_length(tags) ELSE 0 END AS INTEGER) AS tag_count, "
    f"{TAGS_JSON_SQL} AS tags_json, CASE WHEN {O.IS_TAGS} THEN tags -> '$[0]' ->> 'key' END AS first_key"))
def parse_tags_q(t: Tables):
    tags = J.parse_tags("tags")
    return t.runs.select("id", F.size(tags).alias("tag_count"), F.to_json(tags).alias("tags_json"),
                         F.get(tags, 0)["key"].alias("first_key"))


@register("tags_to_json", _sql(
    f"id, CASE WHEN {O.IS_TAGS} AND json_array_length(tags) > 0 THEN tags END AS tags_json"))
def tags_to_json_q(t: Tables):
    return t.runs.select("id", J.tags_to_json(J.parse_tags("tags")).alias("tags_json"))


@register("parse_context", _sql(
    "id, CAST(CASE WHEN json_valid(context) AND json_type(context) = 'OBJECT' "
    "THEN len(json_keys(context)) ELSE 0 END AS INTEGER) AS context_keys, context ->> 'customer' AS customer"))
def parse_context_q(t: Tables):
    ctx = J.parse_context("context")
    return t.runs.select("id", F.size(ctx).alias("context_keys"), ctx["customer"].alias("customer"))


@register("attr_counts", _sql(
    f"id, CAST(CASE WHEN {O.IS_TAGS} THEN json_array_length(tags) ELSE 0 END AS INTEGER) AS tag_count, "
    "CAST(CASE WHEN json_valid(context) AND json_type(context) = 'OBJECT' "
    "THEN len(json_keys(context)) ELSE 0 END AS INTEGER) AS context_key_count"))
def attr_counts_q(t: Tables):
    return t.runs.select("id", J.tag_count("tags").alias("tag_count"),
                         J.context_key_count("context").alias("context_key_count"))


@register("deep_link", _sql(
    f"id, '{PUBLIC_URL.rstrip('/')}/?process=' || url_encode(name) || '/' || url_encode(process_id) AS url"))
def deep_link_q(t: Tables):
    return t.runs.select("id", X.process_url(PUBLIC_URL).alias("url"))


_BUDGET_SQL = (
    f"CASE WHEN deadline_us IS NOT NULL AND {O.sec('deadline_us')} <> {O.sec('started_us')} THEN "
    f"{O.round1(f'least(120.0, greatest(0, {O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')}) / CAST({O.sec('deadline_us')} - {O.sec('started_us')} AS DOUBLE) * 100.0)')} "
    f"WHEN {O.sec('deadline_us')} = {O.sec('started_us')} AND {O.sec(f'coalesce(completed_us, {AS_OF})')} > {O.sec('started_us')} "
    "THEN 120.0 END")


@register("deadline_budget_used", _sql(
    f"id, {_BUDGET_SQL} AS budget_used, coalesce(({_BUDGET_SQL}) > 100, false) AS over_budget"))
def budget_q(t: Tables):
    pct = C.round1(C.budget_used(t.as_of))
    return t.runs.select("id", pct.alias("budget_used"), F.coalesce(pct > 100, F.lit(False)).alias("over_budget"))


def _fmt_duration_sql(s: str) -> str:
    def two(major, u1, minor, u2):
        return (f"CASE WHEN ({minor}) <> 0 THEN CAST({major} AS VARCHAR) || '{u1} ' || CAST({minor} AS VARCHAR) || '{u2}' "
                f"ELSE CAST({major} AS VARCHAR) || '{u1}' END")
    return (f"CASE WHEN {s} IS NULL THEN '—' WHEN {s} < 60 THEN CAST({s} AS VARCHAR) || 's' "
            f"WHEN {s} < 3600 THEN {two(f'({s}) // 60', 'm', f'({s}) % 60', 's')} "
            f"WHEN {s} < 86400 THEN {two(f'({s}) // 3600', 'h', f'(({s}) % 3600) // 60', 'm')} "
            f"ELSE {two(f'({s}) // 86400', 'd', f'(({s}) % 86400) // 3600', 'h')} END")


def _fmt_relative_sql(ts: str) -> str:
    d = f"({O.sec(AS_OF)} - {ts})"
    a = f"abs{d}"
    val = (f"CASE WHEN {a} < 60 THEN {a} WHEN {a} < 3600 THEN {a} // 60 WHEN {a} < 86400 THEN {a} // 3600 "
           f"ELSE {a} // 86400 END")
    unit = f"CASE WHEN {a} < 60 THEN 's' WHEN {a} < 3600 THEN 'm' WHEN {a} < 86400 THEN 'h' ELSE 'd' END"
    return (f"CASE WHEN {d} >= 0 THEN CAST({val} AS VARCHAR) || {unit} || ' ago' "
            f"ELSE 'in ' || CAST({val} AS VARCHAR) || {unit} END")


def _tone_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STATUS_TONE.items())
    return f"coalesce(CASE {col} {whens} END, 'neutral')"


@register("run_display", O.with_views(
    "SELECT id, " + _fmt_duration_sql("dur") + " AS duration_text, "
    + _fmt_relative_sql(O.sec("started_us")) + " AS started_relative, "
    + f"CASE WHEN started_us IS NULL THEN '—' ELSE strftime(make_timestamp(started_us), '%Y-%m-%d %H:%M') || ' UTC' END AS started_absolute, "
    + f"CASE WHEN completed_us IS NULL THEN '—' ELSE strftime(make_timestamp(completed_us), '%Y-%m-%d %H:%M') || ' UTC' END AS completed_absolute, "
    + _tone_sql("status") + " AS status_tone, " + _tone_sql("ds") + " AS deadline_tone "
    + f"FROM (SELECT *, {O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')} AS dur, "
    + f"{O.DEADLINE_STATUS} AS ds FROM runs) r"))
def run_display_q(t: Tables):
    r = t.runs
    dur = C.duration_s(t.as_of)
    return r.select(
        "id", X.fmt_duration(dur).alias("duration_text"),
        X.fmt_relative(F.unix_seconds("started_at"), t.as_of).alias("started_relative"),
        X.fmt_absolute(F.unix_seconds("started_at")).alias("started_absolute"),
        X.fmt_absolute(F.unix_seconds("completed_at")).alias("completed_absolute"),
        X.status_tone("status").alias("status_tone"),
        X.status_tone(C.deadline_status(t.as_of)).alias("deadline_tone"))


# -- B25 / B26 over the request log --------------------------------------------

def _http_view() -> str:
    return """http_requests AS (
  SELECT ts, CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS method,
         '/v1/processes/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path,
         CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status,
         value * 10 AS duration_ms, event_id, user_id, event_type
  FROM events
)"""


def _sanitize_sql(col: str) -> str:
    out = col
    for pattern, repl in X.PATH_REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{repl}')"
    return (f"CASE WHEN {col} IS NULL THEN 'unknown' WHEN length({out}) > 100 THEN substr({out}, 1, 100) || '...' "
            f"ELSE {out} END")


# A path variant per request exercises every rewrite and the length cut.
def _path_variant_spark():
    et, eid = F.col("event_type"), F.col("event_id").cast("string")
    return (F.when(et == "view", F.concat(F.lit("/v1/processes/"), eid))
            .when(et == "click", F.concat(F.lit("/swagger-ui/index/"), eid))
            .when(et == "error", F.concat(F.lit("/swagger/"), eid, F.lit("/"), F.repeat(F.lit("x"), 120)))
            .otherwise(F.col("path")))


def _path_variant_sql() -> str:
    return ("CASE WHEN event_type = 'view' THEN '/v1/processes/' || CAST(event_id AS VARCHAR) "
            "WHEN event_type = 'click' THEN '/swagger-ui/index/' || CAST(event_id AS VARCHAR) "
            "WHEN event_type = 'error' THEN '/swagger/' || CAST(event_id AS VARCHAR) || '/' || repeat('x', 120) "
            "ELSE path END")


@register("sanitize_path", O.with_views(
    f"SELECT event_id, p AS path, {_sanitize_sql('p')} AS sanitized FROM "
    f"(SELECT event_id, {_path_variant_sql()} AS p FROM http_requests) q", _http_view()))
def sanitize_path_q(t: Tables):
    ev = t.table("events")
    req = ev.select("event_id", "event_type",
                    F.concat(F.lit("/v1/processes/"), F.col("event_type"), F.lit("/"),
                             F.col("event_id").cast("string")).alias("path"))
    p = _path_variant_spark()
    return req.select("event_id", p.alias("path"), X.sanitize_path(p).alias("sanitized"))


def _tag_filter_text_spark():
    k = F.get_json_object(F.col("props"), "$.k")
    return F.concat(F.lit(" k:"), k, F.lit(",bad, region:"), F.col("event_type"),
                    F.lit(" , :empty,k: "), F.col("user_id").cast("string"), F.lit(",url:http://x"))


def _tag_filter_text_sql() -> str:
    return ("' k:' || (props ->> 'k') || ',bad, region:' || event_type || ' , :empty,k: ' "
            "|| CAST(user_id AS VARCHAR) || ',url:http://x'")


@register("parse_tag_filters", O.with_views(
    "SELECT event_id, CAST(len(list_distinct(list_transform(kv, lambda x: x[1]))) AS INTEGER) AS n_keys, "
    "list_filter(kv, lambda x: x[1] = 'k')[-1][2] AS k_value, "
    "list_filter(kv, lambda x: x[1] = 'region')[-1][2] AS region_value, "
    "list_filter(kv, lambda x: x[1] = 'url')[-1][2] AS url_value "
    "FROM (SELECT event_id, list_filter(list_transform(list_filter(list_transform(string_split(txt, ','), lambda x: trim(x)), "
    "lambda x: x <> '' AND contains(x, ':')), lambda x: [trim(split_part(x, ':', 1)), trim(substr(x, strpos(x, ':') + 1))]), "
    "lambda x: x[1] <> '') AS kv FROM (SELECT event_id, " + _tag_filter_text_sql() + " AS txt FROM events) a) b"))
def parse_tag_filters_q(t: Tables):
    ev = t.table("events")
    m = X.parse_tag_filter_col(_tag_filter_text_spark())
    return ev.select("event_id", m.alias("m")).select(
        "event_id", F.coalesce(F.size(F.map_keys("m")), F.lit(0)).alias("n_keys"),
        F.col("m")["k"].alias("k_value"), F.col("m")["region"].alias("region_value"),
        F.col("m")["url"].alias("url_value"))
