"""Exact percentiles by value counts equal Spark's own exact percentile, also for one hot group."""

import random

from pyspark.sql import functions as F

from duewatch.operators.quantiles import exact_percentiles


def _frame(spark):
    rnd = random.Random(7)
    rows = []
    for g, n in [("hot", 20000), ("mid", 137), ("two", 2), ("one", 1), (None, 30)]:
        for _ in range(n):
            rows.append((g, (rnd.random() - 0.3) * 1e6 if rnd.random() > 0.05 else None))
    rows += [("dups", 5.0)] * 50 + [("dups", 7.0)] * 3 + [("empty", None)]
    return spark.createDataFrame(rows, "g string, v double")


def _close(a, b):
    return all(abs(x - y) <= 1e-9 * max(1.0, abs(y)) for x, y in zip(a, b, strict=True))


def test_interpolated_equals_percentile(spark):
    df = _frame(spark)
    got = {r.g: (r.n, r.q) for r in exact_percentiles(df, ["g"], "v").collect()}
    want = {r.g: (r.n, r.q) for r in df.groupBy("g").agg(
        F.count("v").alias("n"), F.percentile("v", [0.5, 0.9, 0.99]).alias("q")).where("n > 0").collect()}
    assert set(got) == set(want)
    for g, (n, q) in got.items():
        assert n == want[g][0] and _close(q, want[g][1]), g


def test_nearest_rank_equals_percentile_disc(spark):
    df = _frame(spark)
    got = {r.g: r.q for r in exact_percentiles(df, ["g"], "v", nearest_rank=True).collect()}
    want = {r.g: [r.a, r.b, r.c] for r in df.where("v IS NOT NULL").groupBy("g").agg(*[
        F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").alias(n)
        for p, n in ((0.5, "a"), (0.9, "b"), (0.99, "c"))]).collect()}
    assert got == want


def test_no_keys_and_no_values(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5000)], "g string, v double")
    got = exact_percentiles(df, [], "v").first()
    assert _close(got.q, df.agg(F.percentile("v", [0.5, 0.9, 0.99])).first()[0])
    assert exact_percentiles(df.where("false"), [], "v").count() == 0


def test_no_group_wide_buffer_in_the_plan(spark):
    plan = exact_percentiles(_frame(spark), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile(" not in plan


def test_totals_without_durations(spark):
    from duewatch.operators import analytics as A
    from tests.conftest import T0, make_runs
    only_active = make_runs(spark, [dict(process_id="a", status="ACTIVE")])
    r = A.tag_totals(only_active, T0, 24).first()
    assert (r.total, r.dur_count, r.p50_s) == (1, 0, None)


def test_window_hours_are_checked(spark):
    import pytest
    from duewatch.operators import analytics as A
    from tests.conftest import T0, make_runs
    runs = make_runs(spark, [dict(process_id="a", status="ACTIVE")])
    for entry in (A.scope, A.tag_totals, A.tag_rollup, A.tag_impact):
        for hours in (0, 721):
            with pytest.raises(ValueError):
                entry(runs, T0, hours)


def test_counters_have_no_batch_cap(spark):
    """More due runs than a delivery batch: the log, counters and backlog agree."""
    from duewatch.operators import analytics as A
    from duewatch.operators import metrics as M
    from duewatch.operators import scans as S
    from tests.conftest import T0, make_runs
    runs = make_runs(spark, [dict(process_id=f"p{i}", status="ACTIVE", started=-3600, deadline=-60) for i in range(640)])
    events = S.deadline_events(runs, T0)
    assert events.count() == 640 == M.event_counters(events).first().missed_events == A.backlog(runs, T0).first().missed_backlog
    assert S.missed_scan(runs, T0).count() == 500
