"""Window rollups from stored partials against the direct ones."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from duewatch.operators import analytics as A
from duewatch.operators import rollups as RU
from duewatch.sources.epochs import committed
from duewatch.sources.runs import read_stored_runs, write_runs
from tests.conftest import T0, make_runs, tags


def some_runs(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        started = -rnd.randrange(40 * 86400)
        done = rnd.random() < 0.8
        end = started + rnd.choice([60, 3600, 90_000, rnd.randrange(1, 400_000)]) if done else None
        status = rnd.choice(["COMPLETED", "COMPLETED", "FAILED"]) if done else "ACTIVE"
        out.append(dict(process_id=f"p{i}", name=rnd.choice("ab"), status=status, started=started, completed=end,
                        deadline=None if rnd.random() < 0.2 else started + rnd.randrange(1, 400_000),
                        tags=rnd.choice([None, "not json", tags(("t", "x")), tags(("t", "x"), ("t", "x")), tags(("t", "y"), ("u", ""))])))
    return out


def rows(df):
    # The average is rounded to 0.1 from sums in another order.
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture()
def stored(spark, scratch):
    runs = make_runs(spark, some_runs(900, 1))
    write_runs(runs, f"{scratch}/runs", files=4)
    runs = read_stored_runs(spark, f"{scratch}/runs")
    for epoch, part in enumerate(("id % 3 = 0", "id % 3 = 1", "id % 3 = 2")):  # late ones come in an epoch of their own
        RU.add_finished(runs.where(part), f"{scratch}/partials", epoch)
    return runs, f"{scratch}/partials"


def test_equal_to_direct(stored):
    runs, root = stored
    for as_of, hours, name in ((T0, 720, None), (T0, 24, "a"), (T0 - timedelta(hours=7, minutes=3, microseconds=1), 169, None), (T0 + timedelta(days=9), 1, "b")):
        want = A.tag_rollup_with_totals(runs, as_of, hours, name)
        assert rows(RU.window_rollup(runs, root, as_of, hours, name)) == rows(want)
    assert rows(RU.tag_impact(runs, root, T0, 720)) == rows(A.tag_impact(runs, T0, 720))
    assert rows(RU.tag_totals(runs, root, T0, 720)) == rows(A.tag_totals(runs, T0, 720))
    with pytest.raises(ValueError):
        RU.tag_impact(runs, root, T0, 721)


def test_deleted_runs_and_compaction(spark, stored):
    runs, root = stored
    gone = F.col("id") % 5 == 0
    RU.add_finished(runs.where(gone), root, 3, sign=-1)
    left = runs.where(~gone)
    want = rows(A.tag_rollup_with_totals(left, T0, 720))
    assert rows(RU.window_rollup(left, root, T0, 720)) == want
    assert RU.compact(spark, root, clean=True) == 4
    assert committed(spark, f"{root}/ranges") == committed(spark, f"{root}/values") == [4]
    assert rows(RU.window_rollup(left, root, T0, 720)) == want


def test_a_replayed_epoch_adds_nothing(stored):
    runs, root = stored
    RU.add_finished(runs.where("id % 3 = 1"), root, 1)
    assert rows(RU.tag_totals(runs, root, T0, 720)) == rows(A.tag_totals(runs, T0, 720))


def test_reads_only_active_runs_and_the_first_day(stored):
    runs, root = stored
    plan = RU.tag_impact(runs, root, T0, 720)._jdf.queryExecution().optimizedPlan().toString()
    physical = RU.tag_impact(runs, root, T0, 720)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(day" in plan
    finished = [line for line in physical.split("\n") if "FileScan" in line and "/runs" in line and "NOT (status" in line]
    assert finished and all("LessThan(comple" in line and "GreaterThanOrEqual(completed_at," in line for line in finished)
    scans = [line for line in physical.split("\n") if "FileScan" in line and "/runs" in line]
    assert all("status#" in line and ("= ACTIVE)" in line) for line in scans)


def test_no_partials_yet(spark, scratch):
    runs = make_runs(spark, [dict(process_id="a", status="ACTIVE", tags=tags(("t", "x")))])
    assert rows(RU.tag_totals(runs, f"{scratch}/none", T0, 24)) == rows(A.tag_totals(runs, T0, 24))
