"""Streaming operators against their batch twins."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duewatch.operators import lifecycle as LC
from duewatch.operators import metrics as M
from duewatch.sources.fixtures import derive_commands, derive_http_requests
from duewatch.streaming.counters import gauge_refresher, read_gauges, stream_counters, stream_request_alerts
from duewatch.streaming.deadlines import deadline_events_batch, stream_deadlines
from duewatch.streaming.lifecycle import stream_lifecycle
from tests.test_lifecycle import CMD_SCHEMA, random_commands

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture data not present")


def _write_in_order(spark, df, order, path, parts, sentinel=None):
    pdf = df.orderBy(order).toPandas()
    n = len(pdf)
    for i in range(parts):
        chunk = pdf.iloc[i * n // parts:(i + 1) * n // parts]
        spark.createDataFrame(chunk, df.schema).coalesce(1).write.parquet(f"{path}/p{i:03d}")
    if sentinel is not None:
        spark.createDataFrame(sentinel, df.schema).coalesce(1).write.parquet(f"{path}/p999")


def _run(query_df, path, mode="append"):
    q = (query_df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start())
    q.awaitTermination(600)
    return q


def test_stream_deadlines_equal_batch(spark, scratch):
    cmds = derive_commands(spark, SF)
    last = cmds.agg(F.max("ts")).first()[0]
    sentinel = pd.DataFrame({"seq": [10 ** 12], "ts": [last + pd.Timedelta(days=2)], "name": ["~sentinel"],
                             "process_id": ["~"], "kind": ["noop"], "status": [None], "deadline": [pd.NaT],
                             "tags": [None], "context": [None]})
    _write_in_order(spark, cmds, "seq", f"{scratch}/in", 5, sentinel)
    src = (spark.readStream.schema(cmds.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{scratch}/in"))
    _run(stream_deadlines(src), scratch)
    got = spark.read.parquet(f"{scratch}/out")
    want = deadline_events_batch(cmds)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_lifecycle_equal_batch(spark, scratch):
    cmds = spark.createDataFrame(random_commands(400, 7, seed=11), CMD_SCHEMA)
    _write_in_order(spark, cmds, "seq", f"{scratch}/in", 4)
    src = (spark.readStream.schema(cmds.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{scratch}/in"))
    _run(stream_lifecycle(src), scratch)
    got = {r.seq: (r.accepted, r.reason, r.code) for r in spark.read.parquet(f"{scratch}/out").collect()}
    want = {r.seq: (r.accepted, r.reason, r.code) for r in LC.decide(cmds, 16).collect()}
    assert got == want


def test_stream_counters_equal_batch(spark, scratch):
    from duewatch.streaming.deadlines import deadline_events_batch
    events = deadline_events_batch(derive_commands(spark, SF)).withColumn("name", F.col("process_id"))
    _write_in_order(spark, events, "fire_at_ms", f"{scratch}/in", 3)
    src = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{scratch}/in")
    q = (stream_counters(src).writeStream.format("memory").queryName("counters_t").outputMode("complete")
         .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {tuple(r) for r in spark.sql("SELECT * FROM counters_t").collect()}
    want = {tuple(r) for r in M.event_counters(events).collect()}
    assert got == want


def test_stream_request_alerts_equal_batch(spark, scratch):
    reqs = derive_http_requests(spark, SF)
    last = reqs.agg(F.max("ts")).first()[0]
    sentinel = pd.DataFrame({"ts": [last + pd.Timedelta(hours=1)], "method": ["GET"], "path": ["/x"],
                             "status": [200], "duration_ms": [1.0]})
    _write_in_order(spark, reqs, "ts", f"{scratch}/in", 4, sentinel)
    src = (spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{scratch}/in"))
    _run(stream_request_alerts(src), scratch)
    got = spark.read.parquet(f"{scratch}/out")
    want = M.request_alerts_binned(reqs)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_gauge_refresher(spark, scratch):
    from datetime import datetime
    from duewatch.sources.runs import write_runs
    from tests.conftest import make_runs
    runs = make_runs(spark, [dict(process_id="a", name="x", status="ACTIVE", started=-3600, deadline=-60),
                             dict(process_id="b", name="y", status="ACTIVE", started=-3600, deadline=7200)])
    write_runs(runs, f"{scratch}/runs")
    refresh = gauge_refresher(f"{scratch}/runs", f"{scratch}/snap")
    tick = spark.createDataFrame([(datetime(2024, 6, 1, 12, 0),)], "timestamp timestamp")
    refresh(tick, 0)
    first = {r.name: r.overdue for r in read_gauges(spark, f"{scratch}/snap").collect()}
    assert first == {"x": 1, "y": 0}
    later = spark.createDataFrame([(datetime(2024, 6, 1, 15, 0),)], "timestamp timestamp")
    refresh(later, 1)
    second = {r.name: r.overdue for r in read_gauges(spark, f"{scratch}/snap").collect()}
    assert second == {"x": 1, "y": 1}


def test_late_requests_after_emission_dropped_and_counted(spark, scratch):
    """A row for windows that were already emitted (append mode) is dropped
    and counted; emitted windows are final and never repeated."""
    from datetime import datetime, timedelta
    schema = "ts timestamp, method string, path string, status int, duration_ms double"
    b = datetime(2024, 1, 1)
    files = [
        [(b + timedelta(minutes=i), "GET", "/x", 200, 10.0) for i in range(30)],
        [(b + timedelta(minutes=40), "GET", "/x", 200, 10.0)],   # moves the watermark; windows to 00:19 close
        [(b + timedelta(minutes=1), "GET", "/x", 500, 9999.0)],  # late: its windows were already emitted
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/in/p{i}")
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{scratch}/in"))
    q = _run(stream_request_alerts(src), scratch)
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    out = spark.read.parquet(f"{scratch}/out")
    # Counted after the sliding-window expansion: one row × 5 windows.
    assert dropped == 5
    assert out.filter("errors > 0").count() == 0
    assert out.count() == out.select("window_start").distinct().count()  # no window emitted twice


def test_stream_gauges_end_to_end(spark, scratch):
    import time
    from duewatch.sources.runs import write_runs
    from duewatch.streaming.counters import stream_gauges
    from tests.conftest import make_runs
    # Deadlines far in the past relative to the rate source's wall-clock ticks.
    runs = make_runs(spark, [dict(process_id="a", name="x", status="ACTIVE", started=-3600, deadline=-60),
                             dict(process_id="b", name="x", status="ACTIVE", started=-3600, deadline=-30)])
    write_runs(runs, f"{scratch}/runs")
    q = stream_gauges(spark, f"{scratch}/runs", f"{scratch}/snap", f"{scratch}/ck", interval="1 second")
    try:
        deadline = time.time() + 120
        while time.time() < deadline:
            if q.exception() is not None:
                raise q.exception()
            if _done_epochs(f"{scratch}/snap"):
                break
            time.sleep(1)
    finally:
        q.stop()
    newest = max(_done_epochs(f"{scratch}/snap"), key=lambda d: int(d.split("=")[1]))
    got = {r.name: r.overdue for r in spark.read.parquet(f"{scratch}/snap/{newest}").collect()}
    assert got == {"x": 2}


def _done_epochs(path):
    if not os.path.isdir(path):
        return []
    return [d for d in os.listdir(path)
            if d.startswith("epoch=") and os.path.exists(os.path.join(path, d, "_SUCCESS"))]


def test_request_stream_is_parsed_and_validated(spark, scratch):
    """Create requests as JSON lines on a stream: read, parsed and judged as in batch."""
    import json
    from pyspark.sql import types as T
    from duewatch.sources.requests import parse_create_requests, read_request_stream
    os.makedirs(f"{scratch}/in")
    bodies = ['{"id":"abc","deadline":null}', "{broken", None, '{"id":"\\t"}']
    with open(f"{scratch}/in/a.json", "w") as f:
        for b in bodies:
            f.write(json.dumps({"name": "n", "body": b, "received_at": "2024-01-01T00:00:00Z"}) + "\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("body", T.StringType()),
                           T.StructField("received_at", T.TimestampType())])
    src = parse_create_requests(read_request_stream(spark, f"{scratch}/in", schema))
    _run(src.select("id", LC.validate_create(src).alias("reason")), scratch)
    got = sorted((r.id or "", r.reason or "") for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == sorted([("abc", ""), ("", "body_unreadable"), ("", "body_unreadable"), ("\t", "id_blank")])


def test_commands_to_outbox_with_restart(spark, scratch):
    """Commands → deadline stream → outbox, under the package's own settings: stopped half way, restarted, replayed."""
    from duewatch.session import DEFAULT_CONF
    from duewatch.sources.outbox import foreach_batch_writer, read_outbox
    provider = "spark.sql.streaming.stateStore.providerClass"
    assert spark.conf.get(provider) == DEFAULT_CONF[provider]
    cmds = derive_commands(spark, SF)
    last = cmds.agg(F.max("ts")).first()[0]
    sentinel = pd.DataFrame({"seq": [10 ** 12], "ts": [last + pd.Timedelta(days=2)], "name": ["~sentinel"],
                             "process_id": ["~"], "kind": ["noop"], "status": [None], "deadline": [pd.NaT],
                             "tags": [None], "context": [None]})
    _write_in_order(spark, cmds, "seq", f"{scratch}/in", 2)

    def run():
        src = (spark.readStream.schema(cmds.schema).option("maxFilesPerTrigger", 1)
               .option("recursiveFileLookup", "true").parquet(f"{scratch}/in"))
        (stream_deadlines(src).writeStream.foreachBatch(foreach_batch_writer(f"{scratch}/outbox"))
         .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start().awaitTermination(600))

    run()
    spark.createDataFrame(sentinel, cmds.schema).coalesce(1).write.parquet(f"{scratch}/in/p999")
    run()
    want = {(r.run_seq, r.event, r.fire_at_ms // 1000) for r in deadline_events_batch(cmds).collect()}
    out = spark.read.parquet(f"{scratch}/outbox")
    assert {(r.id, r.event, r.emitted_at) for r in out.collect()} == want and out.count() == len(want)
    foreach_batch_writer(f"{scratch}/outbox")(deadline_events_batch(cmds), 99)  # everything replayed
    assert read_outbox(spark, f"{scratch}/outbox").count() == spark.read.parquet(f"{scratch}/outbox").count() == len(want)
