"""Validation and the lifecycle fold of create / complete /
delete commands into runs (§2.K1), as DataFrame jobs.

The fold needs no per-key state machine. Over the valid commands of a key in
``seq`` order:

* an ACTIVE run exists before a command ⇔ the previous command is a create
  (an accepted create leaves one; a rejected one means one already existed;
  a complete or delete always leaves none);
* the number of stored rows is a walk that steps +1 on accepted creates and
  −1 on deletes, held at zero: ``after = cum − min(0, running min cum)``.

Running sums are computed per (key, seq chunk) and stitched with per-chunk
offsets, so one very busy key is spread over many tasks instead of one. The
final table is an aggregation per (key, level): the last create/delete at a
level decides whether a run lives there, the last accepted complete at that
level finishes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duewatch.functions.text import blank, utf16_length


CREATE, COMPLETE, DELETE = "create", "complete", "delete"
DEFAULT_CHUNK = 1 << 20
KEY = ["name", "process_id"]

# HTTP status per decision.
CODE_CREATED, CODE_OK, CODE_DELETED = 201, 200, 204
CODE_BAD_REQUEST, CODE_NOT_FOUND, CODE_CONFLICT = 400, 404, 409
NAME_PATTERN = r"\A[a-zA-Z0-9_-]+\z"  # the whole name: $ would let a final line feed pass


# -- validation -----------------------------------------------------------------

def _first(*rules: tuple[Column, str]) -> Column:
    expr = None
    for cond, reason in rules:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr


def _first_bad_tag(tags: Column, checks) -> Column:
    """Reason of the first tag (in order) failing any check, checks in order."""
    def reason(t):
        return _first(*[(fn(t), r) for fn, r in checks])
    return F.get(F.filter(F.transform(F.coalesce(tags, F.array()), reason), lambda r: r.isNotNull()), 0)


def validate_create(reqs: DataFrame, now: Column | None = None) -> Column:
    """Service rules, first failing wins; ``now`` defaults to ``received_at``."""
    now_s = F.unix_seconds(now if now is not None else F.col("received_at"))
    name, pid, dl, tags = F.col("name"), F.col("id"), F.col("deadline"), F.col("tags")
    tag_reason = _first_bad_tag(tags, [
        (lambda t: blank(t["key"]), "tag_key_blank"),
        (lambda t: blank(t["value"]), "tag_value_blank"),
        (lambda t: utf16_length(t["key"]) > 50, "tag_key_too_long"),
        (lambda t: utf16_length(t["value"]) > 100, "tag_value_too_long"),
    ])
    unreadable = F.col("unreadable") if "unreadable" in reqs.columns else F.lit(False)
    return (F.when(unreadable, F.lit("body_unreadable"))
            .when(blank(name), F.lit("name_blank"))
            .when(utf16_length(name) > 100, F.lit("name_too_long"))
            .when(blank(pid), F.lit("id_blank"))
            .when(utf16_length(pid) > 50, F.lit("id_too_long"))
            .when(dl.isNotNull() & (dl <= 0), F.lit("deadline_not_positive"))
            .when(dl.isNotNull() & (dl < now_s - 60), F.lit("deadline_in_past"))
            .when(tags.isNotNull() & (F.size(tags) > 20), F.lit("too_many_tags"))
            .otherwise(tag_reason))


def validate_edge(reqs: DataFrame) -> Column:
    """Request-shape rules checked before the service rules (first failing)."""
    name, pid, dl, tags = F.col("name"), F.col("id"), F.col("deadline"), F.col("tags")
    tag_reason = _first_bad_tag(tags, [
        (lambda t: blank(t["key"]) | (utf16_length(t["key"]) > 50), "tag_key_invalid"),
        (lambda t: blank(t["value"]) | (utf16_length(t["value"]) > 100), "tag_value_invalid"),
    ])
    return (F.when(blank(name), F.lit("name_required"))
            .when((utf16_length(name) < 1) | (utf16_length(name) > 100), F.lit("name_length"))
            .when(~name.rlike(NAME_PATTERN), F.lit("name_pattern"))
            .when(blank(pid), F.lit("id_required"))
            .when((utf16_length(pid) < 3) | (utf16_length(pid) > 50), F.lit("id_length"))
            .when(dl.isNotNull() & (dl < 0), F.lit("deadline_negative"))
            .otherwise(tag_reason))


def validate_complete(status: Column, unreadable: Column | None = None) -> Column:
    """A body that can't be read, a run that would stay ACTIVE, or a status outside the domain."""
    return (F.when(F.lit(False) if unreadable is None else unreadable, F.lit("body_unreadable"))
            .when(status == "ACTIVE", F.lit("status_active"))
            .when(~status.isin("COMPLETED", "FAILED"), F.lit("status_invalid")))


def validate_lookup(name: Column, pid: Column) -> Column:
    return (F.when(blank(name), F.lit("name_blank"))
            .when(utf16_length(name) > 100, F.lit("name_too_long"))
            .when(blank(pid), F.lit("id_blank"))
            .when(utf16_length(pid) > 50, F.lit("id_too_long")))


def status_violations(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isNull() | ~F.col("status").isin("ACTIVE", "COMPLETED", "FAILED"))


def error_code(reason: Column) -> Column:
    """HTTP class of a rejection reason."""
    return (F.when(reason.isin("already_exists", "already_completed"), F.lit(CODE_CONFLICT))
            .when(reason == "not_found", F.lit(CODE_NOT_FOUND))
            .when(reason.isNotNull(), F.lit(CODE_BAD_REQUEST)))


# -- fold -----------------------------------------------------------------------

def decide(cmds: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Accept or reject each command. ``cmds``: seq, ts, name, process_id,
    kind, status, deadline, and further columns that are kept (already
    validated). Another kind than the three is rejected and changes nothing;
    its ``active_before`` and row counts are null. Adds ``active_before``,
    ``rows_before``, ``rows_after``, ``accepted``, ``reason``, ``code``.

    A shuffle on (key, seq chunk) computes everything local to a chunk; only
    the first row of a chunk depends on earlier chunks, through the previous
    chunk's last kind. Per-chunk summaries (one row per key and chunk) are
    stitched per key and joined back on the same columns. The summary is an
    aggregate over the same scan, so the scan and its shuffle are planned
    twice; narrow command columns are all that the summary side reads."""
    known = F.coalesce(F.col("kind").isin(CREATE, COMPLETE, DELETE), F.lit(False))
    unknown = cmds.filter(~known)
    cmds = cmds.filter(known)
    kc = KEY + ["_chunk"]
    w = "PARTITION BY name, process_id, _chunk ORDER BY seq"
    run = w + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    wk = "PARTITION BY name, process_id ORDER BY _chunk"
    before_k = wk + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def step(k: str, active: str) -> str:
        return f"CASE WHEN {k} = '{CREATE}' AND NOT ({active}) THEN 1 WHEN {k} = '{DELETE}' THEN -1 ELSE 0 END"

    c = cmds.selectExpr("*", f"CAST(floor(seq / {int(chunk)}) AS BIGINT) AS _chunk")
    c = c.selectExpr("*", f"lag(kind) OVER ({w}) AS _lagk")
    # Steps of rows 2.. of a chunk are local; row 1's step waits for the carry.
    c = c.selectExpr("*", f"CASE WHEN _lagk IS NULL THEN 0 ELSE {step('kind', f"_lagk = '{CREATE}'")} END AS _xr")
    c = c.selectExpr("*", f"sum(_xr) OVER ({run}) AS _r")
    c = c.selectExpr("*", f"min(_r) OVER ({run}) AS _rmin")
    c = c.selectExpr("*", f"lag(_r) OVER ({w}) AS _r_prev", f"lag(_rmin) OVER ({w}) AS _rmin_prev")

    # Kinds are summarised as small integer codes so min_by/max_by keep a
    # fixed-width buffer (hash aggregation instead of sort-based).
    code = f"CASE kind WHEN '{CREATE}' THEN 1 WHEN '{DELETE}' THEN 2 ELSE 0 END"
    s = c.groupBy(*kc).agg(F.expr(f"min_by({code}, seq)").alias("_first"),
                           F.expr(f"max_by({code}, seq)").alias("_last"),
                           F.expr("sum(_xr)").alias("_R"), F.expr("min(_r)").alias("_minr"))
    s = s.selectExpr("*", f"coalesce(lag(_last) OVER ({wk}) = 1, false) AS _carry")
    s = s.selectExpr("*", "CASE WHEN _first = 1 AND NOT _carry THEN 1 WHEN _first = 2 THEN -1 ELSE 0 END AS _x1")
    s = s.selectExpr("*", "_x1 + _R AS _tot", "_x1 + _minr AS _cmin")
    s = s.selectExpr(*kc, "_carry", "_x1", "_cmin", f"coalesce(sum(_tot) OVER ({before_k}), 0) AS _off")
    s = s.selectExpr(*kc, "_carry", "_x1", "_off", f"min(_off + _cmin) OVER ({before_k}) AS _pmin")
    c = c.join(s, kc)

    def after(r: str, rmin: str) -> str:
        return f"(_off + _x1 + {r}) - least(0, least(_pmin, _off + _x1 + {rmin}))"

    cols = [f"`{x}`" for x in cmds.columns]
    c = c.selectExpr(
        *cols,
        f"CASE WHEN _lagk IS NULL THEN _carry ELSE _lagk = '{CREATE}' END AS active_before",
        f"CAST(CASE WHEN _lagk IS NULL THEN _off - least(0, coalesce(_pmin, 0)) "
        f"ELSE {after('_r_prev', '_rmin_prev')} END AS BIGINT) AS rows_before",
        f"CAST({after('_r', '_rmin')} AS BIGINT) AS rows_after")
    reason = (f"CASE WHEN kind = '{CREATE}' AND active_before THEN 'already_exists' "
              f"WHEN kind = '{COMPLETE}' AND NOT active_before AND rows_before = 0 THEN 'not_found' "
              f"WHEN kind = '{COMPLETE}' AND NOT active_before THEN 'already_completed' "
              f"WHEN kind = '{DELETE}' AND rows_before = 0 THEN 'not_found' END")
    c = c.selectExpr("*", f"{reason} AS reason")
    code = (f"CASE WHEN reason IN ('already_exists', 'already_completed') THEN {CODE_CONFLICT} "
            f"WHEN reason = 'not_found' THEN {CODE_NOT_FOUND} WHEN reason IS NOT NULL THEN {CODE_BAD_REQUEST} "
            f"WHEN kind = '{CREATE}' THEN {CODE_CREATED} WHEN kind = '{COMPLETE}' THEN {CODE_OK} "
            f"ELSE {CODE_DELETED} END")
    decided = c.selectExpr(*cols, "active_before", "rows_before", "rows_after", "reason IS NULL AS accepted",
                           "reason", f"{code} AS code")
    return decided.unionByName(unknown.selectExpr(
        *cols, "CAST(NULL AS BOOLEAN) AS active_before", "CAST(NULL AS BIGINT) AS rows_before",
        "CAST(NULL AS BIGINT) AS rows_after", "false AS accepted", "'unknown_command' AS reason",
        f"{CODE_BAD_REQUEST} AS code"))


def fold(decisions: DataFrame) -> DataFrame:
    """Final runs from decided commands: one row per surviving create, with its tags and context."""
    for c in ("tags", "context"):
        if c not in decisions.columns:
            decisions = decisions.withColumn(c, F.lit(None).cast("string"))
    acc = decisions.filter("accepted")
    kind = F.col("kind")
    level = F.when(kind == CREATE, F.col("rows_after")).otherwise(F.col("rows_before"))
    ev = acc.withColumn("level", level)
    cd = kind.isin(CREATE, DELETE)
    done = kind == COMPLETE
    g = ev.groupBy(*KEY, "level").agg(
        F.max_by(F.when(cd, F.struct("kind", "seq", "ts", "deadline", "tags", "context")), F.when(cd, F.col("seq"))).alias("cd"),
        F.max_by(F.when(done, F.struct("seq", "ts", "status")), F.when(done, F.col("seq"))).alias("fin"))
    live = g.filter(F.col("cd.kind") == CREATE)
    finished = F.col("fin.seq").isNotNull() & (F.col("fin.seq") > F.col("cd.seq"))
    return live.select(
        F.col("cd.seq").alias("id"), "process_id", "name",
        F.when(finished, F.col("fin.status")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.col("cd.ts").alias("started_at"),
        F.when(finished, F.col("fin.ts")).alias("completed_at"),
        F.col("cd.deadline").alias("deadline"),
        F.col("cd.tags").alias("tags"), F.col("cd.context").alias("context"),
        F.col("cd.ts").alias("created_at"),
        F.when(finished, F.col("fin.ts")).otherwise(F.col("cd.ts")).alias("updated_at"),
        F.lit(None).cast("long").alias("namespace_id"),
        F.lit(None).cast("timestamp").alias("deadline_notified_at"),
        F.lit(None).cast("timestamp").alias("deadline_warned_at"))


def run_history(decisions: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Every run there ever was, deleted ones too, from decided commands.

    Columns of a run (id, process_id, name, status, started_at, completed_at,
    deadline, tags, context), then ``ended_by`` and ``ended_at``: the command
    that ended it, a complete or a delete. A deleted run stays in the state it
    had. "Next event at the same (key, level)" is found per seq chunk with
    ``lead``; the last event of a chunk looks up the first event of the next
    chunk holding that level through a per-chunk summary, so a busy key that
    keeps reusing one level is still spread over many tasks."""
    for c in ("tags", "context"):
        if c not in decisions.columns:
            decisions = decisions.withColumn(c, F.lit(None).cast("string"))
    level = F.when(F.col("kind") == CREATE, F.col("rows_after")).otherwise(F.col("rows_before"))
    ev = (decisions.filter("accepted").withColumn("_level", level)
          .withColumn("_chunk", F.floor(F.col("seq") / F.lit(chunk)).cast("long")).withColumn("_end", F.struct("kind", "ts", "status")))
    group = [*KEY, "_level"]
    ev = ev.withColumn("_next", F.lead("_end").over(Window.partitionBy(*group, "_chunk").orderBy("seq")))
    firsts = ev.groupBy(*group, "_chunk").agg(F.min_by("_end", "seq").alias("_first"))
    firsts = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy(*group).orderBy("_chunk")))
    ev = ev.filter(F.col("kind") == CREATE).join(firsts.select(*group, "_chunk", "_later"), [*group, "_chunk"])
    end = F.coalesce("_next", "_later")
    done = end["kind"] == COMPLETE
    return ev.select(
        F.col("seq").alias("id"), "process_id", "name", F.when(done, end["status"]).otherwise(F.lit("ACTIVE")).alias("status"),
        F.col("ts").alias("started_at"), F.when(done, end["ts"]).alias("completed_at"), "deadline", "tags", "context",
        end["kind"].alias("ended_by"), end["ts"].alias("ended_at"))


def fold_commands(cmds: DataFrame, chunk: int = DEFAULT_CHUNK) -> tuple[DataFrame, DataFrame]:
    d = decide(cmds, chunk)
    return d, fold(d)


def operation_results(decisions: DataFrame) -> DataFrame:
    """The database-operation outcome each decision records: create → create
    (true / false on conflict); accepted complete → update true; accepted
    delete → delete true; other rejections record nothing."""
    kind, ok = F.col("kind"), F.col("accepted")
    op = (F.when(kind == CREATE, F.lit("create"))
          .when((kind == COMPLETE) & ok, F.lit("update"))
          .when((kind == DELETE) & ok, F.lit("delete")))
    return decisions.select(op.alias("operation"), F.when(kind == CREATE, ok).otherwise(F.lit(True)).alias("success"))


def read_results(requests: DataFrame) -> DataFrame:
    """The read operations that lookups and lists record: GET requests, failed when the server erred."""
    return requests.filter(F.col("method") == "GET").select(
        F.lit("read").alias("operation"), F.coalesce(F.col("status") < 500, F.lit(False)).alias("success"))
