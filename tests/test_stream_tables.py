"""Commands on a stream → runs, decisions, counters and outbox, against the batch jobs over the same log."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duewatch.operators import lifecycle as LC
from duewatch.operators import metrics as M
from duewatch.operators.scans import MISSED_EVENT, WARNING_EVENT
from duewatch.sources import runstore
from duewatch.sources.epochs import committed, read_epochs
from duewatch.sources.runs import RUNS
from duewatch.streaming import runs as R
from duewatch.streaming.deadlines import deadline_events_batch

SCHEMA = ("seq long, ts timestamp, name string, process_id string, kind string, status string, deadline timestamp, tags string, context string")
BASE = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small streams: two state partitions, so that a micro-batch starts few Python workers."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def commands(n, keys, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.choices(["create", "complete", "delete", "pause", None], [6, 5, 2, 1, 0.3])[0]
        ts = BASE + timedelta(minutes=i, microseconds=rnd.choice([0, 0, 1, 1500]))
        create = kind == "create"
        out.append((i * 3 + 1, ts, rnd.choice(["p", "q"]), f"k{rnd.randrange(keys)}", kind, rnd.choice(["COMPLETED", "FAILED"]) if kind == "complete" else None,
                    ts + timedelta(minutes=rnd.choice([-5, 0, 1, 7, 40, 300])) if create and rnd.random() < 0.9 else None,
                    rnd.choice([None, "[]", '[{"key":"k","value":"v"}]', "not json"]) if create else None,
                    rnd.choice([None, '{"n":1}']) if create else None))
    return out


def files(spark, rows, path, parts, first=0):
    for i in range(parts):
        part = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/p{first + i:03d}")


def run(spark, path, root, **options):
    src = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path))
    q = (R.stream_runs(src, **options).writeStream.foreachBatch(R.table_writer(root, "https://x/")).queryName("runs_" + os.path.basename(root))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination(600)
    assert q.exception() is None
    return q


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def expected_outbox(cmds):
    fires = deadline_events_batch(cmds).select(F.col("run_seq").alias("id"), "event", "fire_at_ms")
    history = {r.id: r for r in LC.run_history(LC.decide(cmds)).collect()}
    second = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() // 1)
    out = []
    for f in fires.collect():
        r = history[f.id]
        body = {"event": f.event, "name": r.name, "id": r.process_id, "started_at": second(r.started_at), "deadline": second(r.deadline)}
        if f.event == WARNING_EVENT:
            body["seconds_remaining"] = second(r.deadline) - f.fire_at_ms // 1000
        for c in ("tags", "context"):
            try:
                body[c] = json.loads(r[c]) if r[c] is not None else None
            except ValueError:
                body[c] = r[c]
        body["url"] = f"https://x/?process={r.name}/{r.process_id}"
        out.append((f.id, f.event, f.fire_at_ms // 1000, json.dumps(body, separators=(",", ":"))))
    return sorted(out, key=repr)


def check_tables(spark, root, cmds):
    decided = LC.decide(cmds, 16)
    assert rows(R.read_decisions(spark, root), "seq", "accepted", "reason", "code") == rows(decided, "seq", "accepted", "reason", "code")
    assert rows(runstore.read_runs(spark, root), *RUNS.names) == rows(LC.fold(decided), *RUNS.names)
    history = LC.run_history(decided, 16)
    assert rows(R.read_counters(spark, root)) == rows(M.lifecycle_counters(history))
    assert rows(R.read_timers(spark, root)) == rows(M.duration_timer(history))
    assert rows(R.read_event_counters(spark, root)) == rows(M.event_counters(deadline_events_batch(cmds)))
    assert rows(R.read_operations(spark, root)) == rows(M.operation_counters(LC.operation_results(decided)))
    outbox = R.read_outbox(spark, root)
    assert rows(outbox, "id", "event", "emitted_at", "payload") == expected_outbox(cmds)
    assert outbox.select("event_key").distinct().count() == outbox.count()


@pytest.fixture(scope="module")
def log():
    return commands(420, 6, seed=3)


END = (10 ** 9, BASE + timedelta(days=9), "~", "~", "noop", None, None, None, None)


def test_commands_to_tables_with_restart_and_replay(spark, scratch, log):
    files(spark, log[:200], f"{scratch}/in", 2)
    run(spark, f"{scratch}/in", f"{scratch}/t")
    files(spark, log[200:], f"{scratch}/in", 2, 2)
    files(spark, [END], f"{scratch}/in", 1, 9)
    run(spark, f"{scratch}/in", f"{scratch}/t")  # restarted from its checkpoint
    cmds = spark.createDataFrame([*log, END], SCHEMA)
    check_tables(spark, f"{scratch}/t", cmds)

    # An epoch that is replayed replaces its own folders, whatever part of them a crash had left.
    epochs = committed(spark, f"{scratch}/t/outbox")
    assert len(epochs) >= 5
    os.remove(f"{scratch}/t/outbox/epoch={epochs[-1]}/_SUCCESS")
    batch = spark.createDataFrame([], R.OUTPUT)
    R.table_writer(f"{scratch}/t", "https://x/")(batch, epochs[-1] + 1)
    before = len(expected_outbox(cmds))
    assert R.read_outbox(spark, f"{scratch}/t").count() <= before
    last = read_epochs(spark, f"{scratch}/t/outbox/", R.OUTBOX, after=epochs[-1])
    assert last.count() == 0


def test_replayed_epoch_adds_nothing(spark, scratch, log):
    files(spark, [*log[:120], END], f"{scratch}/in", 1)
    run(spark, f"{scratch}/in", f"{scratch}/t")
    cmds = spark.createDataFrame([*log[:120], END], SCHEMA)
    seen = []
    src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{scratch}/in")
    writer = R.table_writer(f"{scratch}/t", "https://x/")
    q = (R.stream_runs(src).writeStream.foreachBatch(lambda b, e: (writer(b, e), writer(b, e), seen.append(e)))  # every epoch twice, over the first run's
         .option("checkpointLocation", f"{scratch}/again").trigger(availableNow=True).start())
    q.awaitTermination(600)
    assert q.exception() is None and len(seen) >= 2
    check_tables(spark, f"{scratch}/t", cmds)


def test_store_compacts_marks_and_keeps_files(spark, scratch, log):
    root = f"{scratch}/t"
    files(spark, log[:300], f"{scratch}/in", 3)
    run(spark, f"{scratch}/in", root)
    want = rows(LC.fold(LC.decide(spark.createDataFrame(log[:300], SCHEMA))), *RUNS.names)
    runstore.compact(spark, root, files=4)
    assert rows(runstore.read_runs(spark, root), *RUNS.names) == want

    listing = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/base") for f in fs}
    at = datetime(2024, 3, 1)
    ids = [r[0] for r in want][:5]
    marks = spark.createDataFrame([(i, MISSED_EVENT, at) for i in ids] + [(ids[0], WARNING_EVENT, at - timedelta(hours=1))], runstore.MARKS)
    runstore.mark_runs(marks, root, 0)
    marked = {r.id: r for r in runstore.read_runs(spark, root).collect()}
    assert {i for i, r in marked.items() if r.deadline_notified_at == at and r.updated_at == at} == set(ids)
    assert [i for i, r in marked.items() if r.deadline_warned_at is not None] == [ids[0]]
    assert {p: os.stat(p).st_mtime_ns for p in listing} == listing and sorted(listing) == sorted(
        os.path.join(d, f) for d, _, fs in os.walk(f"{root}/base") for f in fs)

    files(spark, log[300:], f"{scratch}/in", 2, 3)
    run(spark, f"{scratch}/in", root)
    final = rows(LC.fold(LC.decide(spark.createDataFrame(log, SCHEMA))), "id", "status", "completed_at")
    assert rows(runstore.read_runs(spark, root), "id", "status", "completed_at") == final
    runstore.compact(spark, root, files=4, clean=True)
    assert committed(spark, f"{root}/changes") == [] and committed(spark, f"{root}/marks") == []
    after = runstore.read_runs(spark, root)
    assert rows(after, "id", "status", "completed_at") == final
    assert {r.id for r in after.where("deadline_notified_at is not null").collect()} == set(ids) & {r[0] for r in final}
    plan = after.where("status = 'ACTIVE'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_state_ends_and_late_commands_are_counted(spark, scratch):
    def cmd(seq, minutes, pid, kind, status=None):
        ts = BASE + timedelta(minutes=minutes)
        return (seq, ts, "p", pid, kind, status, ts + timedelta(days=30) if kind == "create" else None, None, None)

    first = [cmd(2 * i + 1, i, f"k{i}", "create") for i in range(20)] + [cmd(2 * i + 2, i, f"k{i}", "complete", "FAILED") for i in range(18)]
    files(spark, first, f"{scratch}/in", 1)
    files(spark, [cmd(1000, 600, "x", "create")], f"{scratch}/in", 1, 1)
    files(spark, [cmd(1001, 700, "x", "complete", "COMPLETED"), cmd(1002, 5, "k3", "delete")], f"{scratch}/in", 1, 2)   # the second is behind the watermark
    files(spark, [cmd(1003, 701, "k4", "complete", "FAILED"), cmd(999, 702, "x", "delete")], f"{scratch}/in", 1, 3)     # forgotten key; out of order
    late = R.LateRows()
    spark.streams.addListener(late)
    try:
        q = run(spark, f"{scratch}/in", f"{scratch}/t", forget_after="2 hours")
        keys = [p["stateOperators"][0]["customMetrics"] and p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        got = {r.seq: r.reason for r in R.read_decisions(spark, f"{scratch}/t").collect()}
        import time
        for _ in range(50):
            if late.dropped:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(late)
    assert got[1000] is None and got[1001] is None and 1002 not in got
    assert got[1003] == "not_found" and got[999] == "out_of_order"
    assert list(late.dropped.values()) == [1]
    assert max(keys) >= 20 > keys[-1]  # the 18 finished keys are gone, the two live ones stay


def test_change_counters_on_a_stream(spark, scratch, log):
    """The same counts as a stateful aggregate over the stream of changes."""
    files(spark, log, f"{scratch}/in", 3)
    run(spark, f"{scratch}/in", f"{scratch}/t")
    src = (spark.readStream.schema(runstore.CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .parquet(f"{scratch}/t/changes"))
    single = read_epochs(spark, f"{scratch}/t/changes", runstore.CHANGES)
    for name, made in (("counters", R.change_counters), ("timers", R.change_timers)):
        q = (made(src).writeStream.format("memory").queryName(f"{name}_of_changes").outputMode("complete")
             .option("checkpointLocation", f"{scratch}/{name}").trigger(availableNow=True).start())
        q.awaitTermination(600)
        assert q.exception() is None
        assert rows(spark.table(f"{name}_of_changes")) == rows(made(single))


def test_history_keeps_deleted_runs(spark):
    cmds = [(1, "a", "create"), (2, "a", "complete"), (3, "a", "create"), (4, "a", "delete"), (5, "a", "delete"), (6, "b", "create"), (7, "b", "delete"),
            (8, "b", "create")]
    df = spark.createDataFrame([(s, BASE + timedelta(minutes=s), "p", k, kind, "FAILED" if kind == "complete" else None, None, None, None)
                                for s, k, kind in cmds], SCHEMA)
    for chunk in (1, 2, 3, 100):
        got = rows(LC.run_history(LC.decide(df, chunk), chunk), "id", "status", "ended_by")
        assert got == [(1, "FAILED", "complete"), (3, "ACTIVE", "delete"), (6, "ACTIVE", "delete"), (8, "ACTIVE", None)]


def test_tables_of_a_stream_that_has_not_begun(spark, scratch):
    assert R.read_outbox(spark, f"{scratch}/none").count() == 0 and runstore.read_runs(spark, f"{scratch}/none").count() == 0
    assert R.read_counters(spark, f"{scratch}/none").count() == 0
