"""Row filters over runs.

Each predicate is a ``Column``; :func:`apply_filter` AND-composes only the
supplied ones, so Catalyst sees plain comparisons it can push into the Parquet
scan (name, process_id, status, deadline, started_at). Tag containment reads
JSON text and is evaluated after the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from duewatch.functions import columns as C
from duewatch.functions.jsoncols import has_tag, tag_elements
from duewatch.functions.time import instant_sql, minus_hours
from duewatch.operators.ordering import top_k


def by_name(v: str) -> Column:
    return F.col("name") == F.lit(v)


def by_id(v: str) -> Column:
    return F.col("process_id") == F.lit(v)


def by_status(v: str) -> Column:
    return F.col("status") == F.lit(v)


def has_tags(pairs: dict[str, str]) -> Column:
    """Every pair must sit in one tag element; null/non-array tags never match.

    The JSON is parsed once per row (the parse appears once, outside any
    lambda): all wanted pairs are present iff intersecting the run's distinct
    elements with the (distinct) wanted pairs keeps all of them."""
    if len(pairs) == 1:
        (k, v), = pairs.items()
        return has_tag(k, v)
    wanted = F.array(*[F.struct(F.lit(k).cast("string").alias("key"), F.lit(v).cast("string").alias("value"))
                       for k, v in pairs.items()])
    parsed = tag_elements("tags")
    return F.coalesce(F.size(F.array_intersect(parsed, wanted)) == F.lit(len(pairs)), F.lit(False))


def deadline_before(epoch_s: int) -> Column:
    return C.deadline < F.timestamp_seconds(F.lit(epoch_s))


def deadline_after(epoch_s: int) -> Column:
    return C.deadline > F.timestamp_seconds(F.lit(epoch_s))


def by_deadline_status(v: str, as_of) -> Column:
    if v in (C.MISSED, C.ON_TRACK):
        now = instant_sql(as_of)
        if now is None:
            raise TypeError("a filter by deadline status needs a literal as_of")
        return F.expr(C.overdue_sql(now) if v == C.MISSED else C.on_track_sql(now))
    if v in (C.COMPLETED_ON_TIME, C.COMPLETED_LATE):
        return F.expr(C.ON_TIME_SQL if v == C.COMPLETED_ON_TIME else C.LATE_SQL)
    raise ValueError(f"unknown deadline status {v!r}")


def running_min(minutes: int, as_of) -> Column:
    """ACTIVE and started at least ``minutes`` before as_of."""
    return C.is_active() & (C.started <= minus_hours(as_of, minutes / 60.0))


def ran_at_least(seconds: int, as_of) -> Column:
    """Whole-second duration (live for ACTIVE) of at least ``seconds``."""
    return C.duration_s(as_of) >= F.lit(seconds)


@dataclass
class RunFilter:
    name: str | None = None
    process_id: str | None = None
    status: str | None = None
    tags: dict[str, str] | None = None
    deadline_before: int | None = None
    deadline_after: int | None = None
    deadline_status: str | None = None
    running_min: int | None = None
    ran_at_least: int | None = None
    sort_by: str | None = None
    sort_dir: str | None = None
    extra: list[Column] = field(default_factory=list)

    def predicates(self, as_of) -> list[Column]:
        out = []
        if self.name is not None:
            out.append(by_name(self.name))
        if self.process_id is not None:
            out.append(by_id(self.process_id))
        if self.status is not None:
            out.append(by_status(self.status))
        if self.tags:
            out.append(has_tags(self.tags))
        if self.deadline_before is not None:
            out.append(deadline_before(self.deadline_before))
        if self.deadline_after is not None:
            out.append(deadline_after(self.deadline_after))
        if self.deadline_status is not None:
            out.append(by_deadline_status(self.deadline_status, as_of))
        if self.running_min is not None:
            out.append(running_min(self.running_min, as_of))
        if self.ran_at_least is not None:
            out.append(ran_at_least(self.ran_at_least, as_of))
        return out + list(self.extra)


def apply_filter(runs: DataFrame, flt: RunFilter | None, as_of) -> DataFrame:
    preds = flt.predicates(as_of) if flt else []
    return runs.filter(reduce(and_, preds)) if preds else runs


def get_run(runs: DataFrame, name: str, process_id: str) -> DataFrame:
    """The run for (name, process_id): newest by (started_at, id). An ACTIVE run,
    when one exists, is always the newest."""
    match = runs.filter(by_name(name) & by_id(process_id))
    return top_k(match, [C.started.desc(), F.col("id").desc()], 1, pos=False)


def exists_active(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys (name, process_id) that have an ACTIVE run (a semi join)."""
    active = runs.filter(C.is_active()).select("name", "process_id")
    return keys.join(active, ["name", "process_id"], "left_semi")


def approaching(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """ACTIVE runs with a deadline before as_of + hours (overdue ones included),
    soonest first, with hours remaining."""
    horizon = minus_hours(as_of, -hours)
    hit = runs.filter(C.is_active() & C.deadline.isNotNull() & (C.deadline <= horizon))
    return hit.withColumn("hours_remaining", C.hours_remaining(as_of))


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(C.is_active())
