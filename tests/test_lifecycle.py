"""The window-only lifecycle fold against a brute-force replay."""

import random
from datetime import datetime, timedelta

import pytest

from duewatch.operators import lifecycle as LC

CMD_SCHEMA = "seq long, ts timestamp, name string, process_id string, kind string, status string, deadline timestamp"
BASE = datetime(2024, 1, 1)


def replay(cmds):
    """Row-by-row model of the service: an ACTIVE run per key at most; lookups
    take the newest row; deletes remove the newest row."""
    tables = {}
    decisions = {}
    for seq, ts, name, pid, kind, status, deadline in sorted(cmds):
        rows = tables.setdefault((name, pid), [])
        newest = rows[-1] if rows else None
        if kind == "create":
            if newest and newest["status"] == "ACTIVE":
                decisions[seq] = "already_exists"
            else:
                rows.append(dict(id=seq, status="ACTIVE", started=ts, completed=None, deadline=deadline))
                decisions[seq] = None
        elif kind == "complete":
            if newest is None:
                decisions[seq] = "not_found"
            elif newest["status"] != "ACTIVE":
                decisions[seq] = "already_completed"
            else:
                newest["status"], newest["completed"] = status, ts
                decisions[seq] = None
        elif kind != "delete":
            decisions[seq] = "unknown_command"
        else:
            if newest is None:
                decisions[seq] = "not_found"
            else:
                rows.pop()
                decisions[seq] = None
    final = {(k, r["id"], r["status"], r["completed"]) for k, rs in tables.items() for r in rs}
    return decisions, final


def random_commands(n, keys, seed):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        k = rnd.randrange(keys)
        kind = rnd.choices(["create", "complete", "delete", "pause"], [5, 4, 2, 1])[0]
        ts = BASE + timedelta(minutes=seq)
        out.append((seq * 3 + 1, ts, "p", f"k{k}", kind,
                    rnd.choice(["COMPLETED", "FAILED"]) if kind == "complete" else None,
                    ts + timedelta(hours=1) if kind == "create" else None))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_fold_matches_replay(spark, chunk):
    cmds = random_commands(600, 9, seed=chunk)
    expect_dec, expect_final = replay(cmds)
    df = spark.createDataFrame(cmds, CMD_SCHEMA)
    decisions, runs = LC.fold_commands(df, chunk)
    got_dec = {r.seq: r.reason for r in decisions.collect()}
    assert got_dec == expect_dec
    got_final = {((r.name, r.process_id), r.id, r.status, r.completed_at) for r in runs.collect()}
    assert got_final == expect_final


def test_codes_and_operations(spark):
    ts = BASE
    cmds = [(1, ts, "p", "a", "complete", "COMPLETED", None),
            (2, ts, "p", "a", "create", None, ts),
            (3, ts, "p", "a", "create", None, ts),
            (4, ts, "p", "a", "complete", "FAILED", None),
            (5, ts, "p", "a", "complete", "COMPLETED", None),
            (6, ts, "p", "a", "delete", None, None),
            (7, ts, "p", "a", "delete", None, None)]
    d = LC.decide(spark.createDataFrame(cmds, CMD_SCHEMA), 2)
    got = [(r.seq, r.code) for r in d.orderBy("seq").collect()]
    assert got == [(1, 404), (2, 201), (3, 409), (4, 200), (5, 409), (6, 204), (7, 404)]
    from duewatch.operators.metrics import operation_counters
    ops = {(r.operation, r.success): r["count"] for r in operation_counters(LC.operation_results(d)).collect()}
    assert ops == {("create", True): 1, ("create", False): 1, ("update", True): 1, ("delete", True): 1}


def test_validation_first_rule_wins(spark):
    from duewatch.functions.jsoncols import TAGS
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.StringType()),
                           T.StructField("deadline", T.LongType()), T.StructField("tags", TAGS),
                           T.StructField("received_at", T.TimestampType())])
    now = datetime(2024, 1, 1)
    now_s = 1704067200
    rows = [(" ", "x", None, None, now), ("a" * 101, "x", None, None, now), ("n", "", None, None, now),
            ("n", "i" * 51, None, None, now), ("n", "id1", 0, None, now), ("n", "id1", now_s - 61, None, now),
            ("n", "id1", now_s - 60, [("k", "v")] * 21, now),
            ("n", "id1", None, [("k", "v"), ("k" * 51, " "), (" ", "v")], now),
            ("n", "id1", None, [("k", "v")], now)]
    df = spark.createDataFrame(rows, schema)
    got = [r.r for r in df.select(LC.validate_create(df).alias("r")).collect()]
    assert got == ["name_blank", "name_too_long", "id_blank", "id_too_long", "deadline_not_positive",
                   "deadline_in_past", "too_many_tags", "tag_value_blank", None]
    edge = [r.r for r in df.select(LC.validate_edge(df).alias("r")).collect()]
    assert edge[0] == "name_required" and edge[2] == "id_required" and edge[4] is None


def brute_deadline_events(cmds, thr=0.75):
    """Replay: each accepted create fires warning/miss unless the run ends first."""
    decisions, _ = replay(cmds)
    by_key = {}
    for c in sorted(cmds):
        by_key.setdefault((c[2], c[3]), []).append(c)
    out = set()
    for (name, pid), cs in by_key.items():
        rows = []  # stack of [seq, start, deadline, end]
        for seq, ts, _, _, kind, status, dl in cs:
            if decisions[seq] is not None:
                continue
            if kind == "create":
                rows.append([seq, ts, dl, None])
            elif kind == "complete":
                rows[-1][3] = ts
            else:
                r = rows.pop()
                if r[3] is None:
                    r[3] = ts
                _emit(out, name, pid, r, thr)
        for r in rows:
            _emit(out, name, pid, r, thr)
    return out


def _emit(out, name, pid, r, thr):
    seq, st, dl, end = r
    if dl is None:
        return
    ms = lambda x: int((x - datetime(1970, 1, 1)).total_seconds() * 1000)
    s_ms, d_ms = ms(st), ms(dl)
    e_ms = None if end is None else ms(end)
    fires = [("process.deadline_missed", d_ms)]
    if d_ms > s_ms:
        fires.append(("process.deadline_warning", s_ms + int((d_ms - s_ms) * thr)))
    for ev, at in fires:
        if e_ms is None or e_ms > at:
            out.add((name, pid, seq, ev, at))


@pytest.mark.parametrize("chunk", [3, 50, 1 << 20])
def test_deadline_events_batch_matches_replay(spark, chunk):
    from duewatch.streaming.deadlines import deadline_events_batch
    cmds = random_commands(500, 4, seed=100 + chunk)
    df = spark.createDataFrame(cmds, CMD_SCHEMA)
    got = {tuple(r) for r in deadline_events_batch(df, 0.75, chunk).collect()}
    assert got == brute_deadline_events(cmds)
