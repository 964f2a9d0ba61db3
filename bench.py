"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs are first written once as a stored table (Parquet partitioned by status,
sorted by deadline), the way the reference keeps them in a database table;
the table goes under the session's shared ``spark.checkpoint.dir``. Each
query is then executed to a ``noop`` sink (full execution, nothing collected)
once to warm up and ``BENCH_REPEAT`` times measured; the median is reported.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["tag_impact_720h", "summary", "name_rollups", "list_page1", "filter_multi_tag",
            "missed_scan", "warning_scan", "lifecycle_decisions", "timeseries_1d"]
# Costlier plans, timed with three repeats and reported apart, so that the sum stays comparable between rounds.
MORE = ["tag_impact_totals", "latency_by_tag", "metrics_snapshot", "alert_sustained", "request_p95_window",
        "lifecycle_runs", "notification_rule_match", "notification_outbox"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    from duewatch.session import checkpoint_dir, get_session
    from duewatch.plans.catalog import Tables, load_all
    from duewatch.sources.fixtures import derive_runs
    from duewatch.sources.runs import write_runs

    spark = get_session(f"local[{cpus}]", app="duewatch-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    base = checkpoint_dir(spark).rstrip("/")
    stored = f"{base}/bench-runs-{uuid.uuid4().hex[:8]}"
    t0 = time.perf_counter()
    write_runs(derive_runs(spark, sf_dir), stored)
    materialize = time.perf_counter() - t0

    catalog = load_all()
    tables = Tables(spark, sf_dir, stored_runs=stored)
    results, more = {}, {}
    for name in HEADLINE + MORE:
        job = catalog[name].job
        job(tables).write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(repeat if name in HEADLINE else min(repeat, 3)):
            t = time.perf_counter()
            job(Tables(spark, sf_dir, stored_runs=stored)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        (results if name in HEADLINE else more)[name] = round(statistics.median(times), 4)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, [round(x, 3) for x in times], file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 4), "unit": "sec",
           "queries": results, "more_queries": more, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
           "materialize_runs_sec": round(materialize, 3), "repeat": repeat, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
