"""Deadline scans, marking, the notification outbox and delivery bookkeeping
(SURVEY §2.K3–K6, D2, F3, B13–B16).

The reference polls every 60 s: select a batch of overdue (or nearly due)
unmarked runs, deliver one webhook each, then mark the delivered ones. Here a
scan is one batch job at an explicit ``as_of``; delivery is re-aimed at an
append-only outbox keyed by (run id, event), so a re-run after a failure
writes the same keys again instead of sending twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duewatch.functions import columns as C
from duewatch.functions.jsoncols import whole_json_sql
from duewatch.functions.text import process_url
from duewatch.functions.time import instant, instant_sql
from duewatch.operators.ordering import top_k

DEFAULT_BATCH = 500
DEFAULT_THRESHOLD = 0.75
MAX_CONSECUTIVE_FAILURES = 5
MISSED_EVENT = "process.deadline_missed"
WARNING_EVENT = "process.deadline_warning"


def missed_due(as_of) -> Column:
    """ACTIVE, deadline strictly before as_of, not yet notified."""
    now = instant_sql(as_of)
    if now is None:
        return (C.is_active() & F.col("deadline").isNotNull() & (F.col("deadline") < instant(as_of))
                & F.col("deadline_notified_at").isNull())
    return F.expr(f"status = 'ACTIVE' AND deadline IS NOT NULL AND deadline < {now} "
                  "AND deadline_notified_at IS NULL")


def warning_due(as_of, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """ACTIVE, deadline strictly after as_of and after start, not yet warned,
    and at least ``threshold`` of the start→deadline budget used."""
    now = instant_sql(as_of)
    if now is not None:
        return F.expr(
            f"status = 'ACTIVE' AND deadline IS NOT NULL AND deadline > {now} AND deadline_warned_at IS NULL "
            f"AND deadline > started_at AND CAST(unix_micros({now}) AS DOUBLE) >= CAST(unix_micros(started_at) AS DOUBLE)"
            f" + CAST(unix_micros(deadline) - unix_micros(started_at) AS DOUBLE) * {float(threshold)!r}D")
    now_us = F.unix_micros(instant(as_of))
    st_us, dl_us = F.unix_micros(F.col("started_at")), F.unix_micros(F.col("deadline"))
    crossed = now_us.cast("double") >= st_us.cast("double") + (dl_us - st_us).cast("double") * F.lit(float(threshold))
    return (C.is_active() & F.col("deadline").isNotNull() & (F.col("deadline") > instant(as_of))
            & F.col("deadline_warned_at").isNull() & (F.col("deadline") > F.col("started_at")) & crossed)


def _json_or_raw_sql(col: str) -> str:
    """Valid JSON as a nested value, anything else as its raw string.

    Variant objects render their keys sorted; tag objects are written
    key-before-value, so the order is unchanged for them."""
    return f"CASE WHEN NOT {col} RLIKE '^[\\\\x00-\\\\x20]*$' THEN coalesce({whole_json_sql(col)}, CAST({col} AS VARIANT)) END"


def _sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def event_payload(df: DataFrame, event: str, as_of=None, public_url: str | None = None, now: str | None = None) -> Column:
    """The webhook body as JSON text: event, name, id, started_at, deadline,
    [seconds_remaining], tags, context, [url]. Null fields are written as null.
    Built as one SQL expression (one JVM call). ``now`` names a timestamp
    column to count the remaining seconds from, in place of ``as_of``."""
    fields = [("event", _sql_str(event)), ("name", "name"), ("id", "process_id"),
              ("started_at", "unix_seconds(started_at)"), ("deadline", "unix_seconds(deadline)")]
    if event == WARNING_EVENT:
        now = now or instant_sql(as_of)
        if now is None:
            raise TypeError("warning payloads need a literal as_of, or the name of a column")
        fields.append(("seconds_remaining", f"unix_seconds(deadline) - unix_seconds({now})"))
    fields += [("tags", _json_or_raw_sql("tags")), ("context", _json_or_raw_sql("context"))]
    if public_url and public_url.strip():
        base = _sql_str(public_url.rstrip("/") + "/?process=")
        fields.append(("url", f"CASE WHEN name IS NOT NULL AND process_id IS NOT NULL THEN "
                              f"concat({base}, url_encode(name), '/', url_encode(process_id)) END"))
    body = ", ".join(f"'{k}', {v}" for k, v in fields)
    return F.expr(f"to_json(named_struct({body}), map('ignoreNullFields', 'false'))")


def _scan_order() -> list[Column]:
    # The reference orders by deadline only; id makes the batch deterministic.
    return [F.col("deadline").asc(), F.col("id").asc()]


def _picked(due: DataFrame, batch: int | None) -> tuple[DataFrame, list[str]]:
    return (due, []) if batch is None else (top_k(due, _scan_order(), batch), ["pos"])


def missed_scan(runs: DataFrame, as_of, batch: int | None = DEFAULT_BATCH, public_url: str | None = None) -> DataFrame:
    """One missed-deadline pass: the earliest ``batch`` overdue, unnotified runs
    with their ``pos``, or all of them without if ``batch`` is None."""
    picked, pos = _picked(runs.filter(missed_due(as_of)), batch)
    return picked.select(
        *pos, "id", "name", "process_id", F.lit(MISSED_EVENT).alias("event"),
        F.unix_seconds("deadline").alias("deadline"),
        F.lit(None).cast("long").alias("seconds_remaining"),
        event_payload(picked, MISSED_EVENT, as_of, public_url).alias("payload"))


def warning_scan(runs: DataFrame, as_of, threshold: float = DEFAULT_THRESHOLD, batch: int | None = DEFAULT_BATCH,
                 public_url: str | None = None) -> DataFrame:
    """One warning pass; empty when the threshold is outside (0, 1)."""
    if not (0 < threshold < 1):
        due = runs.filter(F.lit(False))
    else:
        due = runs.filter(warning_due(as_of, threshold))
    picked, pos = _picked(due, batch)
    return picked.select(
        *pos, "id", "name", "process_id", F.lit(WARNING_EVENT).alias("event"),
        F.unix_seconds("deadline").alias("deadline"),
        C.seconds_remaining(as_of).alias("seconds_remaining"),
        event_payload(picked, WARNING_EVENT, as_of, public_url).alias("payload"))


def deadline_events(runs: DataFrame, as_of, threshold: float = DEFAULT_THRESHOLD,
                    batch: int | None = None) -> DataFrame:
    """Warning then missed events at one instant, as one event log: every due
    run, unless ``batch`` bounds each pass as a delivery does."""
    return warning_scan(runs, as_of, threshold, batch).unionByName(missed_scan(runs, as_of, batch))


def mark(runs: DataFrame, ids: DataFrame, column: str, at) -> DataFrame:
    """Set ``column`` (and bump updated_at) on runs whose id is in ``ids``.

    A left join on id; ``ids`` is one scan batch (bounded by the batch size),
    so Spark broadcasts it under its size threshold and runs stay in place."""
    hit = ids.select(F.col("id").alias("_mid")).distinct().withColumn("_hit", F.lit(True))
    joined = runs.join(hit, runs["id"] == hit["_mid"], "left")
    ts = instant(at)
    flagged = F.coalesce(F.col("_hit"), F.lit(False))
    out = joined.withColumn(column, F.when(flagged, ts).otherwise(F.col(column))) \
                .withColumn("updated_at", F.when(flagged, ts).otherwise(F.col("updated_at")))
    return out.drop("_mid", "_hit")


def circuit_breaker(attempts: DataFrame, limit: int = MAX_CONSECUTIVE_FAILURES, chunk: int = 1 << 16) -> DataFrame:
    """Which delivered attempts get marked when a pass stops after ``limit``
    consecutive failures (a success resets the count).

    ``attempts``: scan_id, pos (1, 2, … within the scan), run_id, delivered.
    The failure streak at a row is ``pos − (position of the last success at or
    before it)``; that position is a running max, computed per (scan, pos chunk)
    and carried across chunks by the max of the earlier chunks (a per-chunk
    summary). The pass stops at the smallest position whose streak reaches
    ``limit`` (a per-scan ``min``, partially aggregated), and delivered rows
    before it are marked. No step needs a whole scan in one task."""
    kc = ["scan_id", "_chunk"]
    a = attempts.selectExpr("*", f"CAST(floor(pos / {int(chunk)}) AS BIGINT) AS _chunk")
    a = a.selectExpr("*", "max(CASE WHEN delivered THEN pos END) OVER (PARTITION BY scan_id, _chunk ORDER BY pos "
                          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _lmax")
    prev = (attempts.selectExpr("scan_id", f"CAST(floor(pos / {int(chunk)}) AS BIGINT) AS _chunk",
                                "CASE WHEN delivered THEN pos END AS _ok")
            .groupBy(*kc).agg(F.expr("max(_ok)").alias("_cmax"))
            .selectExpr(*kc, "max(_cmax) OVER (PARTITION BY scan_id ORDER BY _chunk "
                             "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _pmax"))
    a = a.join(prev, kc).selectExpr(
        "scan_id", "pos", "run_id", "delivered",
        "CASE WHEN delivered THEN 0 ELSE pos - coalesce(greatest(_lmax, _pmax), 0) END AS _streak")
    stops = a.groupBy("scan_id").agg(F.expr(f"min(CASE WHEN _streak >= {int(limit)} THEN pos END)").alias("_stop"))
    marked = a.filter("delivered").join(stops, "scan_id")
    return marked.filter("_stop IS NULL OR pos < _stop").selectExpr("scan_id", "pos", "run_id",
                                                                     "_stop IS NOT NULL AS tripped")


def deadline_pass(runs: DataFrame, delivered: DataFrame, as_of, threshold: float = DEFAULT_THRESHOLD,
                  batch: int = DEFAULT_BATCH, enabled: bool = True) -> DataFrame:
    """One pass: the warning batch, then the missed batch, each delivered in
    order until MAX_CONSECUTIVE_FAILURES in a row fail; returns the marks (id,
    event, marked_at) of what was delivered. With delivery disabled every event
    of the batches is marked. ``delivered`` (id, event) lists what the
    deliverer got through. Marks are appended to a table; :func:`unmarked`
    leaves out what it holds, so runs need not be rewritten."""
    events = deadline_events(runs, as_of, threshold, batch)
    at = F.unix_seconds(instant(as_of)).alias("marked_at")
    if not enabled:
        return events.select("id", "event", at)
    ok = delivered.select("id", "event", F.lit(True).alias("_ok")).distinct()
    attempts = events.join(ok, ["id", "event"], "left").select(
        F.col("event").alias("scan_id"), "pos", F.col("id").alias("run_id"), F.coalesce("_ok", F.lit(False)).alias("delivered"))
    return circuit_breaker(attempts).select(F.col("run_id").alias("id"), F.col("scan_id").alias("event"), at)


def unmarked(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Events (id, event, …) that the marks table doesn't hold."""
    return events.join(marks.select("id", "event"), ["id", "event"], "left_anti")


def pending_deliveries(outbox: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Outbox events without an acknowledgement: they are retried next pass."""
    return outbox.join(acknowledged.select("id", "event"), ["id", "event"], "left_anti")
