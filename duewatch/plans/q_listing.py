"""Catalogue: sorting, paging and list."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.operators import analytics as A
from duewatch.operators import listing as L
from duewatch.operators.filters import RunFilter
from duewatch.operators.ordering import top_k
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register

AS_OF = O.AS_OF

SQL_SORT_EXPR = {"started_at": "started_us", "completed_at": "completed_us", "deadline": "deadline_us",
                 "name": "name", "status": "status", "duration": f"(coalesce(completed_us, {AS_OF}) - started_us)"}


def _sql_order(key: str, direction: str) -> str:
    d = "ASC" if direction.lower() == "asc" else "DESC"
    return f"{SQL_SORT_EXPR[key]} {d} NULLS LAST, id DESC"


def _sorted_page_sql(key: str, direction: str, limit: int = 20, offset: int = 0, where: str = "true") -> str:
    return O.with_views(O.ordered(f"runs WHERE {where}", _sql_order(key, direction), limit, offset, cols="id"))


SORTS = {
    "sort_started_at": ("started_at", "desc"),
    "sort_completed_at": ("completed_at", "desc"),
    "sort_deadline_asc": ("deadline", "asc"),
    "sort_deadline_desc": ("deadline", "desc"),
    "sort_name": ("name", "asc"),
    "sort_status": ("status", "desc"),
    "sort_duration": ("duration", "desc"),
}

for _name, (_key, _dir) in SORTS.items():
    def _job(t: Tables, key=_key, direction=_dir):
        return L.page(t.runs, L.sort_columns(key, direction, t.as_of), 20, 0).select("id", "pos")
    register(_name, _sorted_page_sql(_key, _dir))(_job)


@register("sort_multi", O.with_views(O.ordered(
    "runs", "status ASC NULLS LAST, deadline_us DESC NULLS LAST, id DESC", 20, cols="id")))
def sort_multi_q(t: Tables):
    return L.page(t.runs, L.sort_multi("status:asc,deadline:desc", t.as_of), 20, 0).select("id", "pos")


_RESP_SQL = (f"process_id AS id, name, status, {O.DEADLINE_STATUS} AS deadline_status, "
             f"{O.sec('started_us')} AS started_at, {O.sec('completed_us')} AS completed_at, "
             f"{O.sec('deadline_us')} AS deadline, "
             f"{O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')} AS duration, "
             f"CASE WHEN {O.IS_TAGS} THEN tags ELSE '[]' END AS tags_json, context ->> 'customer' AS context_customer")


def _list_sql(order: str, limit: int, offset: int, where: str = "true") -> str:
    page = O.ordered(f"runs WHERE {where}", order, limit, offset, cols=_RESP_SQL)
    return O.with_views(f"SELECT p.*, t.total FROM ({page}) p, (SELECT count(*) AS total FROM runs WHERE {where}) t")


def _listed(t: Tables, flt: RunFilter, limit: int, offset: int):
    got = L.list_runs(t.runs, flt, t.as_of, limit, offset)
    return got.select(*[c for c in got.columns if c not in ("tags", "context")], F.to_json("tags").alias("tags_json"),
                      F.try_variant_get("context", "$.customer", "string").alias("context_customer"))


@register("list_page1", _list_sql(_sql_order("started_at", "desc"), 20, 0))
def list_page1_q(t: Tables):
    return _listed(t, RunFilter(), 20, 0)


@register("list_past_end", O.with_views(
    "SELECT CAST(NULL AS BIGINT) AS pos, " + ", ".join(f"CAST(NULL AS {k}) AS {c}" for c, k in (
        ("id", "VARCHAR"), ("name", "VARCHAR"), ("status", "VARCHAR"), ("deadline_status", "VARCHAR"), ("started_at", "BIGINT"),
        ("completed_at", "BIGINT"), ("deadline", "BIGINT"), ("duration", "BIGINT"), ("tags_json", "VARCHAR"), ("context_customer", "VARCHAR")))
    + ", count(*) AS total FROM runs WHERE status = 'ACTIVE'"))
def list_past_end_q(t: Tables):
    return _listed(t, RunFilter(status="ACTIVE"), 20, 10_000_000)


@register("list_page2", _list_sql(_sql_order("started_at", "desc"), 20, 20))
def list_page2_q(t: Tables):
    return _listed(t, RunFilter(), 20, 20)


_LIST_FILTER = RunFilter(status="ACTIVE", sort_by="deadline", sort_dir="asc")


@register("list_runs", _list_sql(_sql_order("deadline", "asc"), 50, 0, "status = 'ACTIVE'"))
def list_runs_q(t: Tables):
    return _listed(t, _LIST_FILTER, 50, 0)


@register("page_info", O.with_views(
    "SELECT total, CAST(50 AS BIGINT) AS \"limit\", CAST(100 AS BIGINT) AS \"offset\", "
    "CAST(greatest(0, least(50, total - 100)) AS BIGINT) AS rows, 100 + greatest(0, least(50, total - 100)) < total AS has_more "
    "FROM (SELECT count(*) AS total FROM runs WHERE status = 'ACTIVE') c"))
def page_info_q(t: Tables):
    return L.page_info(t.runs, RunFilter(status="ACTIVE"), t.as_of, 50, 100)


@register("recent_activity", O.with_views(O.ordered(
    "runs", "started_us DESC, id DESC", 10, cols=f"id, name, status, {O.sec('started_us')} AS started_at")))
def recent_activity_q(t: Tables):
    r = top_k(t.runs, L.sort_columns("started_at", "desc", t.as_of), 10)
    return r.select("id", "name", "status", F.unix_seconds("started_at").alias("started_at"), "pos")


@register("latency_by_tag", O.with_views(
    O.ordered("(SELECT r.*, coalesce(r.p90_s > t.p90_s, false) AS slower_than_overall FROM "
              "rollup r, "
              f"(SELECT {O.stats()} FROM classified) t WHERE r.dur_count > 0) x",
              "p90_s DESC, tag_key ASC, tag_value ASC", 100,
              cols="tag_key, tag_value, dur_count, p50_s, p90_s, p99_s, slower_than_overall"),
    O.classified_view(720), O.EXPLODED_VIEW, O.tag_rollup_view()))
def latency_by_tag_q(t: Tables):
    return A.latency_by_tag(A.tag_rollup_with_totals(t.runs, t.as_of, 720))


@register("list_sorted_multi", _list_sql("status ASC NULLS LAST, deadline_us DESC NULLS LAST, id DESC", 30, 0, "name = 'building'"))
def list_sorted_multi_q(t: Tables):
    return _listed(t, RunFilter(name="building", sort_by="status:asc,deadline:desc"), 30, 0)


@register("page_by_number", O.with_views(O.ordered("runs", "started_us DESC NULLS LAST, id DESC", 25, 50, cols="id")))
def page_by_number_q(t: Tables):
    limit, offset = L.page_by_number(3, 25)
    return L.page(t.runs, L.sort_columns("started_at", "desc", t.as_of), limit, offset).select("id", "pos")


@register("keyset_page_deadline", O.with_views(O.ordered(
    f"runs WHERE name = 'building' AND (deadline_us > {AS_OF} - 30 * {O.DAY_US} OR (deadline_us = {AS_OF} - 30 * {O.DAY_US} AND id < 5000) OR deadline_us IS NULL)",
    "deadline_us ASC NULLS LAST, id DESC", 50, cols="id")))
def keyset_page_deadline_q(t: Tables):
    from duewatch.functions.time import minus_hours
    flt = RunFilter(name="building", sort_by="deadline", sort_dir="asc")
    return L.keyset_page(t.runs, flt, t.as_of, (minus_hours(t.as_of, 30 * 24), 5000), 50).select("id", "pos")


@register("keyset_page", O.with_views(O.ordered(
    f"runs WHERE started_us < {AS_OF} - 400 * {O.DAY_US}", "started_us DESC, id DESC", 20, cols="id")))
def keyset_page_q(t: Tables):
    from duewatch.functions.time import minus_hours
    return L.keyset_page(t.runs, None, t.as_of, (minus_hours(t.as_of, 400 * 24), -1), 20).select("id", "pos")


@register("name_rollups_info", O.with_views(
    "SELECT total, CAST(2 AS BIGINT) AS \"limit\", CAST(2 AS BIGINT) AS \"offset\", "
    "CAST(greatest(0, least(2, total - 2)) AS BIGINT) AS rows, 2 + greatest(0, least(2, total - 2)) < total AS has_more "
    "FROM (SELECT count(DISTINCT name) AS total FROM runs) n"))
def name_rollups_info_q(t: Tables):
    return L.paging(A.distinct_names(t.runs).withColumnRenamed("names", "total"), 2, 2)
