import os
import sys
import tempfile
from datetime import datetime, timedelta, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers (streaming state processors, foreachBatch) import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, os.environ.get("PYTHONPATH", "")] if p)

T0 = datetime(2024, 6, 1, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="duewatch-test-")
    s = (SparkSession.builder.master("local[*]").appName("duewatch-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from duewatch.session import checkpoint_dir
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="duewatch-case-")


def at(offset_s):
    """T0 + offset seconds (None stays None)."""
    return None if offset_s is None else (T0 + timedelta(seconds=offset_s)).replace(tzinfo=None)


def make_runs(spark, rows):
    """rows: dicts with process_id, status, started, deadline, completed (offsets
    from T0 in seconds) and optional name, tags, id, notified, warned."""
    from duewatch.sources.runs import RUNS
    out = []
    for i, r in enumerate(rows):
        st = at(r.get("started", -3600))
        out.append((
            r.get("id", i + 1), r["process_id"], r.get("name", "proc"), r["status"], st,
            at(r.get("completed")), at(r.get("deadline")), r.get("tags"), r.get("context"),
            st, at(r.get("completed")) or st, None, at(r.get("notified")), at(r.get("warned"))))
    return spark.createDataFrame(out, RUNS)


def tags(*pairs):
    import json
    return json.dumps([{"key": k, "value": v} for k, v in pairs], separators=(",", ":"))
