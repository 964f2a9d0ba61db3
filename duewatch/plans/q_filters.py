"""Catalogue: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewatch.functions import columns as C
from duewatch.operators import analytics as A
from duewatch.operators import filters as FL
from duewatch.operators.filters import RunFilter
from duewatch.plans import oracle as O
from duewatch.plans.catalog import Tables, register

AS_OF = O.AS_OF
MIN_US = 60_000_000


def _ids(where: str, extra_cols: str = "") -> str:
    return O.with_views(f"SELECT id{extra_cols} FROM runs WHERE {where}")


def _tag_sql(k: str, v: str) -> str:
    return (f"(CASE WHEN {O.IS_ARRAY} THEN list_contains(list_transform(from_json(tags, '[\"JSON\"]'), "
            f"lambda e: (e ->> 'key') = '{k}' AND (e ->> 'value') = '{v}'), true) ELSE false END)")


def _ds_sql(v: str) -> str:
    return {
        "MISSED": f"status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us < {AS_OF}",
        "ON_TRACK": f"status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us >= {AS_OF}",
        "COMPLETED_ON_TIME": "status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us <= deadline_us",
        "COMPLETED_LATE": "status = 'COMPLETED' AND deadline_us IS NOT NULL AND completed_us > deadline_us",
    }[v]


def _filter_job(flt: RunFilter):
    def job(t: Tables):
        return FL.apply_filter(t.runs, flt, t.as_of).select("id")
    return job


SIMPLE = {
    "filter_name": (RunFilter(name="building"), "name = 'building'"),
    "filter_id": (RunFilter(process_id="run-4242"), "process_id = 'run-4242'"),
    "filter_status": (RunFilter(status="FAILED"), "status = 'FAILED'"),
    "filter_one_tag": (RunFilter(tags={"country": "NATION_7"}), _tag_sql("country", "NATION_7")),
    "filter_multi_tag": (RunFilter(tags={"region": "ASIA", "priority": "1-URGENT"}),
                         _tag_sql("region", "ASIA") + " AND " + _tag_sql("priority", "1-URGENT")),
    # A value that belongs to another key must not match.
    "filter_crossed_tag": (RunFilter(tags={"country": "ASIA"}), _tag_sql("country", "ASIA")),
    "filter_deadline_before": (RunFilter(deadline_before=900_000_000), "deadline_us < 900000000000000"),
    "filter_deadline_after": (RunFilter(deadline_after=990_000_000), "deadline_us > 990000000000000"),
    "filter_missed": (RunFilter(deadline_status="MISSED"), _ds_sql("MISSED")),
    "filter_on_track": (RunFilter(deadline_status="ON_TRACK"), _ds_sql("ON_TRACK")),
    "filter_completed_on_time": (RunFilter(deadline_status="COMPLETED_ON_TIME"), _ds_sql("COMPLETED_ON_TIME")),
    "filter_completed_late": (RunFilter(deadline_status="COMPLETED_LATE"), _ds_sql("COMPLETED_LATE")),
    "filter_running_min": (RunFilter(running_min=60 * 24 * 100),
                           f"status = 'ACTIVE' AND started_us <= {AS_OF} - CAST({60 * 24 * 100} AS BIGINT) * {MIN_US}"),
    "filter_ran_at_least": (RunFilter(ran_at_least=200 * 86400),
                            f"{O.sec(f'coalesce(completed_us, {AS_OF})')} - {O.sec('started_us')} >= {200 * 86400}"),
    "filter_combined": (
        RunFilter(name="building", status="COMPLETED", tags={"priority": "2-HIGH"},
                  deadline_after=800_000_000, deadline_status="COMPLETED_LATE"),
        "name = 'building' AND status = 'COMPLETED' AND " + _tag_sql("priority", "2-HIGH")
        + " AND deadline_us > 800000000000000 AND " + _ds_sql("COMPLETED_LATE")),
}

for _name, (_flt, _where) in SIMPLE.items():
    register(_name, _ids(_where))(_filter_job(_flt))


@register("get_run", O.with_views(
    "SELECT id, process_id, name, status FROM runs WHERE name = 'household' AND process_id = 'run-4242' "
    "ORDER BY started_us DESC, id DESC LIMIT 1"))
def get_run_q(t: Tables):
    return FL.get_run(t.runs, "household", "run-4242").select("id", "process_id", "name", "status")


@register("exists_active", O.with_views(
    "SELECT k.name, k.process_id FROM (SELECT DISTINCT name, process_id FROM runs) k "
    "WHERE EXISTS (SELECT 1 FROM runs r WHERE r.status = 'ACTIVE' AND r.name = k.name AND r.process_id = k.process_id)"))
def exists_active_q(t: Tables):
    keys = t.runs.select("name", "process_id").distinct()
    return FL.exists_active(t.runs, keys)


for _name, _hours, _who in [("scope_24h", 24, None), ("scope_720h", 720, None), ("scope_name", 168, "machinery")]:
    def _job(t: Tables, hours=_hours, who=_who):
        return A.scope(t.runs, t.as_of, hours, who).select("id")
    register(_name, _ids(O.scope_where(_hours, _who)))(_job)


@register("approaching_24h", O.with_views(
    f"SELECT id, {O.sec('deadline_us')} AS deadline, {O.round1(f'(deadline_us - {AS_OF}) / 3.6e9')} AS hours_remaining "
    f"FROM runs WHERE status = 'ACTIVE' AND deadline_us IS NOT NULL AND deadline_us <= {AS_OF} + 24 * {O.HOUR_US} "
    "ORDER BY deadline_us, id"))
def approaching_q(t: Tables):
    a = FL.approaching(t.runs, t.as_of, 24).orderBy("deadline", "id")
    return a.select("id", F.unix_seconds("deadline").alias("deadline"),
                    C.round1("hours_remaining").alias("hours_remaining"))


@register("active_runs", O.with_views(
    f"SELECT id, {O.sec('started_us')} AS started_at FROM runs WHERE status = 'ACTIVE' ORDER BY started_us DESC, id DESC"))
def active_runs_q(t: Tables):
    a = FL.active_runs(t.runs).orderBy(F.col("started_at").desc(), F.col("id").desc())
    return a.select("id", F.unix_seconds("started_at").alias("started_at"))
