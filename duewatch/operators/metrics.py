"""Metric rollups, re-aimed from a scrape registry to DataFrames (SURVEY
§2.E14–E19, D5, A6). Counters become grouped counts over runs, events and
command results; gauges become snapshots joined to the previous snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duewatch.functions import columns as C
from duewatch.functions.text import sanitize_path
from duewatch.operators.quantiles import grouped_stats
from duewatch.operators.scans import MISSED_EVENT, WARNING_EVENT

#: How long each alert's condition holds before it counts, in seconds.
ALERT_HOLD = {"latency": 300, "errors": 120}


def alert_hold_seconds(alert):
    expr = None
    for name, seconds in ALERT_HOLD.items():
        expr = F.when(alert == name, seconds) if expr is None else expr.when(alert == name, seconds)
    return expr


def lifecycle_counters(runs: DataFrame) -> DataFrame:
    """created / completed / failed / completed on time / late per name."""
    return runs.groupBy("name").agg(F.expr("count(1)").alias("created"), *ended_counts())


def ended_counts() -> list[Column]:
    """Counts of ended runs by outcome: completed, failed, on time, late."""
    conds = {"completed": f"status = '{C.COMPLETED}'", "failed": f"status = '{C.FAILED}'", "on_time": C.ON_TIME_SQL, "late": C.LATE_SQL}
    return [F.expr(f"count_if({cond})").alias(name) for name, cond in conds.items()]


def duration_timer(runs: DataFrame) -> DataFrame:
    """Per (name, status) of finished runs: count, total and max duration in
    whole milliseconds (truncated)."""
    done = runs.filter(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
                       & (F.col("status") != C.ACTIVE))
    ms = C.duration_ms_truncated()
    return done.groupBy("name", "status").agg(
        F.count(F.lit(1)).alias("count"), F.sum(ms).cast("long").alias("sum_ms"), F.max(ms).alias("max_ms"))


def event_counters(events: DataFrame) -> DataFrame:
    """Per name: deadline-missed and deadline-warning events processed."""
    e = F.col("event")
    return events.groupBy("name").agg(F.count_if(e == MISSED_EVENT).alias("missed_events"),
                                      F.count_if(e == WARNING_EVENT).alias("warning_events"))


def operation_counters(results: DataFrame) -> DataFrame:
    """Database-operation counter by (operation, table, success) from command
    results (columns ``operation``, ``success``; null operation → no count)."""
    r = results.filter(F.col("operation").isNotNull())
    return r.groupBy("operation", F.lit("processes").alias("table"), "success").agg(
        F.count(F.lit(1)).alias("count"))


def request_rollup(requests: DataFrame) -> DataFrame:
    """HTTP requests by (method, sanitized path, status): count, total and max ms."""
    def known(c):
        return F.coalesce(c, F.lit("unknown"))
    r = requests.select(known(F.col("method")).alias("method"), known(sanitize_path("path")).alias("endpoint"),
                        known(F.col("status").cast("string")).alias("status"), "duration_ms")
    return r.groupBy("method", "endpoint", "status").agg(
        F.count(F.lit(1)).alias("count"), C.round1(F.sum("duration_ms")).alias("sum_ms"),
        F.max("duration_ms").alias("max_ms"))


def slo_on_time(counters: DataFrame, events: DataFrame) -> DataFrame:
    """good = on time; total = on time + late + missed events, per name.
    A run that was reported missed and later finished late counts in both."""
    ev = event_counters(events)
    j = counters.join(ev, "name", "full_outer")
    on_time = F.coalesce(F.col("on_time"), F.lit(0))
    total = on_time + F.coalesce(F.col("late"), F.lit(0)) + F.coalesce(F.col("missed_events"), F.lit(0))
    return j.select("name", on_time.alias("good"), total.alias("total"),
                    C.round1(F.try_divide(on_time.cast("double"), total.cast("double")) * 100).alias("ratio_pct"))


def overdue_gauge(prev: DataFrame, cur: DataFrame, cap: int | None = None) -> DataFrame:
    """Carry a per-name gauge forward: names absent now are reset to 0. With
    ``cap`` (for a registry that bounds its series), the reset series are
    dropped when there are more series than that."""
    p = prev.select("name", F.col("overdue").alias("_prev"))
    c = cur.select("name", F.col("overdue").alias("_cur"))
    out = p.join(c, "name", "full_outer").select(
        "name", F.coalesce(F.col("_cur"), F.lit(0)).cast("long").alias("overdue"),
        F.col("_cur").isNotNull().alias("present"))
    if cap is None:
        return out
    series = out.agg(F.count(F.lit(1)).alias("_series"))
    # ``series`` is a single row, so the cross join only attaches one column.
    keep = (F.col("_series") <= cap) | F.col("present") | (F.col("overdue") != 0)
    return out.crossJoin(series).filter(keep).drop("_series")


def gauge_snapshot(runs: DataFrame, as_of, prev: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Gauges per name at an instant (name, overdue, active); names of ``prev`` that are not overdue now are reset to 0."""
    from duewatch.operators.analytics import overdue_by_name
    cur = overdue_by_name(runs, as_of).select("name", "overdue")
    active = runs.where(F.col("status") == C.ACTIVE).groupBy("name").agg(F.count("*").alias("active"))
    none = F.lit(0).cast("long")
    return (overdue_gauge(cur.limit(0) if prev is None else prev, cur, cap).select("name", "overdue").join(active, "name", "full_outer")
            .select("name", F.coalesce("overdue", none).alias("overdue"), F.coalesce("active", none).alias("active")))


# Exported metric name per column of the per-name aggregate.
NAME_METRICS = {"created": "processes_created_total", "completed": "processes_completed_total",
                "failed": "processes_failed_total", "on_time": "processes_completed_on_time_total",
                "late": "processes_completed_late_total", "missed_events": "deadline_missed_total",
                "warning_events": "deadline_warning_total"}


def name_aggregate(runs: DataFrame, as_of, threshold: float = 0.75) -> DataFrame:
    """All per-name counters and gauges in one pass over the runs: lifecycle
    counters, due events, overdue and active runs."""
    from duewatch.operators.scans import missed_due, warning_due
    warn = warning_due(as_of, threshold) if 0 < threshold < 1 else F.lit(False)
    return runs.groupBy("name").agg(
        F.expr("count(1)").alias("created"), *ended_counts(), F.count_if(missed_due(as_of)).alias("missed_events"),
        F.count_if(warn).alias("warning_events"), F.count_if(C.is_overdue(as_of)).alias("overdue"),
        F.count_if(C.is_active()).alias("active"))


def _rows(df: DataFrame, labels: Column, values: dict[str, Column]) -> DataFrame:
    """(metric, labels, value): one row of ``df`` gives one per entry of ``values``."""
    items = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select(labels.alias("labels"), F.explode(items).alias("m")).select("m.metric", "labels", "m.value")


def metrics_snapshot(runs: DataFrame, as_of, threshold: float = 0.75, operations: DataFrame | None = None,
                     requests: DataFrame | None = None) -> DataFrame:
    """Long-form metrics (metric, labels, value): lifecycle and event counters,
    overdue, active and backlog gauges, duration timers, and, where given,
    database operations (operation, success) and HTTP requests. ``labels`` is
    ``k=v`` pairs joined by ``,``. Runs are aggregated once by (name, status)
    for the timers and once by name for all else."""
    def labels(**cols) -> Column:
        return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("unknown")))
                                  for k, c in cols.items()])
    agg = name_aggregate(runs, as_of, threshold)
    out = _rows(agg, labels(process_name=F.col("name")), {m: F.col(c) for c, m in NAME_METRICS.items()})
    over = agg.filter("overdue > 0").select(F.lit("processes_overdue_current").alias("metric"),
                                            labels(process_name=F.col("name")).alias("labels"),
                                            F.col("overdue").cast("double").alias("value"))
    whole = agg.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("active", "missed_events", "warning_events")])
    out = out.unionByName(over).unionByName(_rows(whole, F.lit(""), {"active_processes_current": F.col("active")}))
    for kind in ("missed", "warning"):
        out = out.unionByName(_rows(whole, F.lit(f"type={kind}"), {"notification_backlog": F.col(f"{kind}_events")}))
    timers = duration_timer(runs)
    out = out.unionByName(_rows(timers, labels(process_name=F.col("name"), status=F.col("status")), {
        "process_duration_ms_count": F.col("count"), "process_duration_ms_sum": F.col("sum_ms"),
        "process_duration_ms_max": F.col("max_ms")}))
    if operations is not None:
        ops = operation_counters(operations)
        out = out.unionByName(_rows(ops, labels(operation=F.col("operation"), table=F.col("table"), success=F.col("success")),
                                    {"database_operations_total": F.col("count")}))
    if requests is not None:
        req = request_rollup(requests)
        out = out.unionByName(_rows(req, labels(method=F.col("method"), endpoint=F.col("endpoint"), status=F.col("status")), {
            "http_requests_total": F.col("count"), "http_request_duration_ms_sum": F.col("sum_ms"),
            "http_request_duration_ms_max": F.col("max_ms")}))
    return out


def request_alerts(requests: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                   p95_ms: float = 1000.0, error_ratio: float = 0.05) -> DataFrame:
    """Sliding-window request health: p95 latency and 5xx share per window,
    with the two alert conditions."""
    w = F.window("ts", window, slide)
    rows = requests.select(F.unix_seconds(w["start"]).alias("window_start"), "status", "duration_ms")
    agg = grouped_stats(rows, ["window_start"], "duration_ms", {"requests": "1L", "errors": "if(status >= 500, 1L, 0L)"}, [0.95])
    agg = agg.withColumn("_p95", F.col("_q")[0])
    return agg.select(
        "window_start", "requests", "errors",
        C.round1_tolerant("_p95").alias("p95_ms"),
        C.round1(F.col("errors") / F.col("requests") * 100).alias("error_pct"),
        (F.col("_p95") > p95_ms).alias("latency_alert"),
        (F.col("errors") / F.col("requests") > error_ratio).alias("error_alert"))


#: Upper bounds, in ms, of the duration bins that a stream keeps per window.
DURATION_BINS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def request_alerts_binned(requests: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                          p95_ms: float = 1000.0, error_ratio: float = 0.05) -> DataFrame:
    """:func:`request_alerts` for streams: state is one count per duration bin.

    p95 is interpolated within its bin (the last bin's is its lower bound), so
    it is exact to the bin; the latency alert is exact for a ``p95_ms`` that is
    a bin's bound."""
    d = F.col("duration_ms")
    agg = requests.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.count(d).alias("_n"), *[F.count_if(d <= b).alias(f"_b{b}") for b in DURATION_BINS])
    rank = F.lit(0.95) * F.col("_n")
    p95, below, low = None, F.lit(0), 0
    for b in DURATION_BINS:
        upto = F.col(f"_b{b}")
        at = F.lit(float(low)) + (rank - below) / (upto - below) * (b - low)
        hit = (F.col("_n") > 0) & (upto >= rank)
        p95 = F.when(hit, at) if p95 is None else p95.when(hit, at)
        below, low = upto, b
    p95 = p95.when(F.col("_n") > 0, F.lit(float(low)))
    late = F.coalesce((F.col(f"_b{int(p95_ms)}") < rank), F.lit(False)) if int(p95_ms) in DURATION_BINS else p95 > p95_ms
    return agg.select(
        F.unix_seconds("w.start").alias("window_start"), "requests", "errors",
        C.round1_tolerant(p95).alias("p95_ms"),
        C.round1(F.col("errors") / F.col("requests") * 100).alias("error_pct"),
        late.alias("latency_alert"), (F.col("errors") / F.col("requests") > error_ratio).alias("error_alert"))


#: Size of the quantile sketch: its rank error is below 0.5 % with 99 % confidence, and none below so many values.
SKETCH_K = 800
SKETCH_RANK_ERROR = 0.005


def request_alerts_sketched(requests: DataFrame, window: str = "5 minutes", slide: str = "1 minute", p95_ms: float = 1000.0,
                            error_ratio: float = 0.05, k: int = SKETCH_K, closed_at: bool = False) -> DataFrame:
    """:func:`request_alerts` for streams, with a mergeable quantile sketch as a window's state.

    ``p95_ms`` is the value whose rank is within :data:`SKETCH_RANK_ERROR` of
    0.95. The latency alert is exact: p95 lies between two neighbouring values,
    and which side of the limit they are on follows from the number of values
    above it, the greatest not above it and the least above it. State per
    window: the sketch (some KB) and six numbers. ``closed_at`` adds the
    window's last instant, which carries the watermark to a next operator."""
    d, over = F.col("duration_ms").cast("double"), F.col("duration_ms") > p95_ms
    agg = requests.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.count(d).alias("_n"),
        F.count_if(over).alias("_over"), F.max(F.when(~over, d)).alias("_below"), F.min(F.when(over, d)).alias("_above"),
        F.kll_sketch_agg_double(d, F.lit(k)).alias("_sketch"))
    at = "(0.95D * (_n - 1))"
    lo, hi = f"CAST(floor({at}) AS BIGINT)", f"CAST(ceil({at}) AS BIGINT)"
    first_over = "(_n - _over)"  # place of the first value above the limit, from 0
    late = (f"CASE WHEN _over = 0 OR _n = 0 THEN false WHEN {lo} >= {first_over} THEN true WHEN {hi} < {first_over} THEN false "
            f"ELSE ({hi} - {at}) * _below + ({at} - {lo}) * _above > {float(p95_ms)!r}D END")
    p95 = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.95)))
    return agg.select(
        *([F.window_time("w").alias("closed_at")] if closed_at else []),
        F.unix_seconds("w.start").alias("window_start"), "requests", "errors", C.round1_tolerant(p95).alias("p95_ms"),
        C.round1(F.col("errors") / F.col("requests") * 100).alias("error_pct"), F.expr(late).alias("latency_alert"),
        (F.col("errors") / F.col("requests") > error_ratio).alias("error_alert"))


def alert_samples(alerts: DataFrame) -> DataFrame:
    """(alert, ts, fired): each window's two conditions as samples at its start; ``closed_at`` is kept if there."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("alert"), F.col(c).alias("fired"))
                               for k, c in (("latency", "latency_alert"), ("errors", "error_alert"))]))
    kept = [c for c in ("closed_at",) if c in alerts.columns]
    return alerts.select(*kept, F.timestamp_seconds("window_start").alias("ts"), both.alias("s")).select(*kept, "ts", "s.*")
