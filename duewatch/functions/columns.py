"""Classification and duration columns over a ``runs`` row.

Three taxonomies live side by side and differ on purpose:

* ``deadline_status`` — per-run response field; null without a deadline and
  for FAILED runs.
* ``outcome`` — used by the tag rollups; every run gets one (an ACTIVE run
  without a deadline is ON_TRACK, a finished one is COMPLETED_ON_TIME).
* the summary buckets, which all require a deadline (see operators.analytics).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duewatch.functions.time import instant, instant_sql

ACTIVE, COMPLETED, FAILED = "ACTIVE", "COMPLETED", "FAILED"

MISSED, ON_TRACK = "MISSED", "ON_TRACK"
COMPLETED_ON_TIME, COMPLETED_LATE = "COMPLETED_ON_TIME", "COMPLETED_LATE"
OVERDUE = "OVERDUE"
PROBLEM_OUTCOMES = (OVERDUE, COMPLETED_LATE, FAILED)

_LAZY_COLUMNS = {"status": "status", "started": "started_at", "completed": "completed_at", "deadline": "deadline"}


def __getattr__(name: str) -> Column:
    # Column handles need an active session, so they are built on access.
    if name in _LAZY_COLUMNS:
        return F.col(_LAZY_COLUMNS[name])
    raise AttributeError(name)


def is_active() -> Column:
    return F.expr("status = 'ACTIVE'")


# Column builders below are written as SQL expression text: one JVM call per
# expression instead of one per node keeps driver-side planning cheap. When
# ``as_of`` is a Column the text form is not possible and Column code is used.

def _now(as_of) -> str | None:
    return instant_sql(as_of)


#: The summary buckets, as SQL text: completed runs with a deadline, by whether they met it.
ON_TIME_SQL = f"status = '{COMPLETED}' AND deadline IS NOT NULL AND completed_at <= deadline"
LATE_SQL = f"status = '{COMPLETED}' AND deadline IS NOT NULL AND completed_at > deadline"


def overdue_sql(now: str) -> str:
    """ACTIVE runs whose deadline is before ``now`` (SQL text); at the very instant they are on track."""
    return f"status = '{ACTIVE}' AND deadline IS NOT NULL AND deadline < {now}"


def on_track_sql(now: str) -> str:
    return f"status = '{ACTIVE}' AND deadline IS NOT NULL AND deadline >= {now}"


def deadline_status(as_of) -> Column:
    """MISSED / ON_TRACK for ACTIVE (equality is ON_TRACK); COMPLETED_ON_TIME /
    COMPLETED_LATE for COMPLETED with a completion time (equality is on time);
    null otherwise, FAILED included."""
    now = _now(as_of)
    if now is None:
        n = instant(as_of)
        return (F.when(F.col("deadline").isNull(), F.lit(None).cast("string"))
                .when(is_active(), F.when(n > F.col("deadline"), F.lit(MISSED)).otherwise(F.lit(ON_TRACK)))
                .when((F.col("status") == COMPLETED) & F.col("completed_at").isNotNull(),
                      F.when(F.col("completed_at") <= F.col("deadline"), F.lit(COMPLETED_ON_TIME))
                       .otherwise(F.lit(COMPLETED_LATE))))
    return F.expr(f"""CASE WHEN deadline IS NULL THEN CAST(NULL AS STRING)
        WHEN status = 'ACTIVE' THEN CASE WHEN {now} > deadline THEN '{MISSED}' ELSE '{ON_TRACK}' END
        WHEN status = '{COMPLETED}' AND completed_at IS NOT NULL THEN
             CASE WHEN completed_at <= deadline THEN '{COMPLETED_ON_TIME}' ELSE '{COMPLETED_LATE}' END END""")


def outcome(as_of) -> Column:
    """Tag-analytics outcome; never null."""
    now = _now(as_of)
    if now is None:
        n = instant(as_of)
        return (F.when(is_active() & F.col("deadline").isNotNull() & (F.col("deadline") < n), F.lit(OVERDUE))
                .when(is_active(), F.lit(ON_TRACK))
                .when(F.col("status") == FAILED, F.lit(FAILED))
                .when(F.col("deadline").isNotNull() & (F.col("completed_at") > F.col("deadline")), F.lit(COMPLETED_LATE))
                .otherwise(F.lit(COMPLETED_ON_TIME)))
    return F.expr(f"""CASE WHEN status = 'ACTIVE' AND deadline IS NOT NULL AND deadline < {now} THEN '{OVERDUE}'
        WHEN status = 'ACTIVE' THEN '{ON_TRACK}'
        WHEN status = '{FAILED}' THEN '{FAILED}'
        WHEN deadline IS NOT NULL AND completed_at > deadline THEN '{COMPLETED_LATE}'
        ELSE '{COMPLETED_ON_TIME}' END""")


def duration_s(as_of) -> Column:
    """Whole-second live duration: floor(end) - floor(start), end defaulting to as_of."""
    now = _now(as_of)
    if now is None:
        end = F.coalesce(F.col("completed_at"), instant(as_of))
        return F.when(F.col("started_at").isNotNull(), F.unix_seconds(end) - F.unix_seconds(F.col("started_at")))
    return F.expr(f"CASE WHEN started_at IS NOT NULL THEN "
                  f"unix_seconds(coalesce(completed_at, {now})) - unix_seconds(started_at) END")


def completed_duration() -> Column:
    """Fractional seconds start→completion, only for COMPLETED runs."""
    return F.expr(f"CASE WHEN status = '{COMPLETED}' AND started_at IS NOT NULL AND completed_at IS NOT NULL "
                  "THEN (unix_micros(completed_at) - unix_micros(started_at)) / 1e6 END")


def duration_ms_truncated() -> Column:
    """Milliseconds start→completion truncated, as a timer records it."""
    return F.expr("CAST(floor((unix_micros(completed_at) - unix_micros(started_at)) / 1000) AS BIGINT)")


def is_overdue(as_of) -> Column:
    now = _now(as_of)
    if now is None:
        return F.coalesce(is_active() & F.col("deadline").isNotNull() & (instant(as_of) > F.col("deadline")),
                          F.lit(False))
    return F.expr(f"coalesce({overdue_sql(now)}, false)")


def seconds_remaining(as_of) -> Column:
    return F.unix_seconds(F.col("deadline")) - F.unix_seconds(instant(as_of))


def hours_remaining(as_of) -> Column:
    return (F.unix_micros(F.col("deadline")) - F.unix_micros(instant(as_of))) / F.lit(3.6e9)


def round1(col) -> Column:
    """Half-up rounding to one decimal, like Java ``Math.round(x * 10) / 10``.
    A string argument is a column name or SQL expression text."""
    if isinstance(col, str):
        return F.expr(f"floor(({col}) * 10.0D + 0.5D) / 10.0D")
    return F.floor(col * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def round1_tolerant(col) -> Column:
    """Half-up to one decimal, treating values within 1e-8 below a tie as the
    tie. For interpolated statistics whose last bits depend on the formula."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(10.0) + F.lit(0.5 + 1e-7)) / F.lit(10.0)


def round_int(col) -> Column:
    """Java/JS ``Math.round`` to a whole number (ties toward +inf)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c + F.lit(0.5)).cast("long")


def budget_used(as_of) -> Column:
    """Deadline budget used in percent on whole seconds:
    ``min(120, max(0, end − start) / (deadline − start) · 100)``, end defaulting
    to as_of; null without a deadline. A budget of zero is 120 once time has
    passed and null before."""
    end = F.unix_seconds(F.coalesce(F.col("completed_at"), instant(as_of)))
    st, dl = F.unix_seconds(F.col("started_at")), F.unix_seconds(F.col("deadline"))
    pct = F.try_divide(F.greatest(F.lit(0), end - st).cast("double"), (dl - st).cast("double")) * F.lit(100.0)
    return (F.when(F.col("deadline").isNotNull() & (dl != st), F.least(F.lit(120.0), pct))
            .when((dl == st) & (end > st), F.lit(120.0)))
