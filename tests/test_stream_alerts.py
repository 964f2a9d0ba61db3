"""Request windows with a sketch, sustained alerts and delivery retries on streams, against batch."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from duewatch.operators import metrics as M
from duewatch.operators import scans as S
from duewatch.operators import windows as W
from duewatch.sources.fixtures import derive_http_requests
from duewatch.streaming.alerts import stream_alert_episodes, stream_sustained
from duewatch.streaming.deliveries import stream_retries

SF = "/root/testdata/sf0.001"
BASE = datetime(2024, 1, 1)
REQUESTS = "ts timestamp, method string, path string, status int, duration_ms double"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small streams: two state partitions, so that a micro-batch starts few Python workers."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def requests(seed, minutes=240):
    rnd = random.Random(seed)
    rows, slow, bad = [], False, False
    for m in range(minutes):
        slow, bad = (slow ^ (rnd.random() < 0.06)), (bad ^ (rnd.random() < 0.08))
        if 100 <= m < 112:
            continue  # no data
        for _ in range(rnd.randrange(1, 6)):
            ts = BASE + timedelta(minutes=m, seconds=rnd.randrange(60))
            rows.append((ts, "GET", "/x", 500 if bad and rnd.random() < 0.4 else 200, rnd.choice([None, 1000.0, 3000.0 if slow else 20.0, rnd.random() * 1500])))
    return rows


def write(spark, rows, schema, path, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts:(i + 1) * len(rows) // parts], schema).coalesce(1).write.parquet(f"{path}/p{i:03d}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(df, path):
    q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out") if os.path.isdir(f"{path}/out") else None


END = (BASE + timedelta(days=2), "GET", "/x", 200, 1.0)


def test_sketched_windows(spark):
    rows = requests(1) + [(BASE + timedelta(hours=9), "GET", "/x", 200, None)]
    df = spark.createDataFrame(rows, REQUESTS).unionByName(derive_http_requests(spark, SF))
    got = {r.window_start: r for r in M.request_alerts_sketched(df).collect()}
    want = {r.window_start: r for r in M.request_alerts(df).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g.requests, g.errors, g.error_pct, g.latency_alert, g.error_alert) == (w.requests, w.errors, w.error_pct, bool(w.latency_alert), w.error_alert)
        assert (g.p95_ms is None) == (w.p95_ms is None)


def test_sketch_rank_error(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(4, 2, 150_000), np.full(50_000, 90.0)])
    rng.shuffle(values)
    df = spark.createDataFrame([(BASE + timedelta(seconds=i % 60), "GET", "/x", 200, float(v)) for i, v in enumerate(values)], REQUESTS).repartition(7)
    for r in M.request_alerts_sketched(df).collect():
        ordered = np.sort(values)
        lo, hi = np.searchsorted(ordered, r.p95_ms - 0.051, "left") / len(values), np.searchsorted(ordered, r.p95_ms + 0.051, "right") / len(values)
        assert lo - M.SKETCH_RANK_ERROR <= 0.95 <= hi + M.SKETCH_RANK_ERROR
        assert r.latency_alert == bool(np.percentile(values, 95) > 1000)


def batch_episodes(df):
    samples = M.alert_samples(M.request_alerts(df))
    return W.sustained(samples, ["alert"], "ts", F.col("fired"), M.alert_hold_seconds(F.col("alert")), max_gap_seconds=60)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", [2, 5])
def test_episodes_with_late_data(spark, scratch, seed):
    rows = requests(seed)
    # Rows come up to six minutes late, within the watermark.
    rnd = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[0] + timedelta(seconds=rnd.randrange(360)))
    write(spark, [*arrival, END], REQUESTS, f"{scratch}/in", 6)
    far = (BASE + timedelta(days=4), "GET", "/x", 200, 1.0)
    spark.createDataFrame([far], REQUESTS).coalesce(1).write.parquet(f"{scratch}/in/p998")
    got = run(stream_alert_episodes(stream(spark, f"{scratch}/in", REQUESTS)), scratch)
    want = batch_episodes(spark.createDataFrame([*rows, END], REQUESTS))
    cols = ("alert", "since", "until", "samples")
    assert rows_of(got, *cols) == rows_of(want, *cols) and got.count() > 2


def test_sustained_samples_out_of_order(spark, scratch):
    rnd = random.Random(9)
    schema = "alert string, ts timestamp, fired boolean"
    rows = [(a, BASE + timedelta(minutes=m), rnd.random() < 0.8) for a in ("latency", "errors") for m in range(200) if rnd.random() < 0.97]
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.randrange(500)))
    end = [(a, BASE + timedelta(days=d), False) for a in ("latency", "errors") for d in (3, 4)]
    write(spark, [*arrival, *end], schema, f"{scratch}/in", 5)
    got = run(stream_sustained(stream(spark, f"{scratch}/in", schema).withWatermark("ts", "10 minutes")), scratch)
    want = W.sustained(spark.createDataFrame([*rows, *end], schema), ["alert"], "ts", F.col("fired"), M.alert_hold_seconds(F.col("alert")), max_gap_seconds=60)
    cols = ("alert", "since", "until", "samples")
    assert rows_of(got, *cols) == rows_of(want, *cols) and got.count() > 5


def test_retries(spark, scratch):
    t = 1_700_000_000
    sent, acks = "id long, event string, payload string, emitted_at long", "id long, event string, acked_at long"
    outbox = [(i, e, f"{{{i}}}", t + i) for i in range(30) for e in (S.MISSED_EVENT, S.WARNING_EVENT)]
    heard = [(i, S.MISSED_EVENT, t + i + 10 * i) for i in range(0, 30, 2)] + [(3, S.WARNING_EVENT, t - 5)]  # the last comes before its row
    write(spark, heard[:-1] + [(10 ** 6, "~", t + 5000)], acks, f"{scratch}/acks", 1)
    spark.createDataFrame(heard[-1:], acks).coalesce(1).write.parquet(f"{scratch}/acks/p000a")
    write(spark, outbox + [(10 ** 6 + 1, "~", "", t + 5000)], sent, f"{scratch}/outbox", 1)
    got = run(stream_retries(spark.readStream.schema(sent).option("recursiveFileLookup", "true").parquet(f"{scratch}/outbox"),
                             spark.readStream.schema(acks).option("recursiveFileLookup", "true").parquet(f"{scratch}/acks"),
                             interval_seconds=60, attempts=4), scratch)
    tries = {}
    for r in got.where("id < 1000").orderBy("due_at").collect():
        tries.setdefault((r.id, r.event), []).append((r.attempt, r.due_at - t - r.id, r.payload))
    pending = S.pending_deliveries(spark.createDataFrame(outbox, sent), spark.createDataFrame(heard, acks))
    assert set(tries) == {(r.id, r.event) for r in pending.collect()}
    assert all(v == [(n, 60 * n, f"{{{k[0]}}}") for n in range(1, 5)] for k, v in tries.items())


def test_retry_until_acknowledged(spark, scratch):
    """The acknowledgement comes after two intervals: two retries, then none."""
    t = 1_700_000_000
    sent, acks = "id long, event string, payload string, emitted_at long", "id long, event string, acked_at long"
    mark = lambda n, at: (10 ** 6 + n, "~", "", at)  # noqa: E731  moves the watermark
    for i, rows in enumerate([[(1, "e", "p", t)], [mark(0, t + 200)], [mark(1, t + 230)], [mark(2, t + 2000)], [mark(3, t + 2001)]]):
        spark.createDataFrame(rows, sent).coalesce(1).write.parquet(f"{scratch}/outbox/p{i}")
    spark.createDataFrame([(5, "other", t)], acks).coalesce(1).write.parquet(f"{scratch}/acks/p0")

    def once():
        src = spark.readStream.schema(sent).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{scratch}/outbox")
        ack = spark.readStream.schema(acks).option("recursiveFileLookup", "true").parquet(f"{scratch}/acks")
        return run(stream_retries(src, ack, 60, 9), scratch)

    # The first run sees only the files so far: hold the later ones back.
    late = [f"{scratch}/outbox/p3", f"{scratch}/outbox/p4"]
    held = [p.replace("/outbox/", "/held-") for p in late]
    for a, b in zip(late, held, strict=True):
        os.rename(a, b)
    first = rows_of(once().where("id = 1"), "attempt")
    assert first == [(1,), (2,)]
    spark.createDataFrame([(1, "e", t + 235)], acks).coalesce(1).write.parquet(f"{scratch}/acks/p1")
    for a, b in zip(late, held, strict=True):
        os.rename(b, a)
    assert rows_of(once().where("id = 1"), "attempt") == [(1,), (2,)]
