"""The reference's test scenarios, rebuilt as hand-made rows with exact expectations."""

from pyspark.sql import functions as F

from duewatch.operators import analytics as A
from duewatch.operators import filters as FL
from duewatch.operators import listing as L
from duewatch.operators import metrics as M
from duewatch.operators import scans as S
from duewatch.operators.filters import RunFilter
from tests.conftest import T0, make_runs, tags


def test_tag_breakdown_order(spark):
    runs = make_runs(spark, [
        dict(process_id="overdue-de", status="ACTIVE", started=-3600, deadline=-600, tags=tags(("country", "DE"))),
        dict(process_id="ontrack-fr", status="ACTIVE", started=-3600, deadline=3600, tags=tags(("country", "FR"))),
    ])
    tot = A.tag_totals(runs, T0, 24).first()
    assert (tot.total, tot.problems) == (2, 1)
    rows = A.tag_impact(runs, T0, 24).orderBy("pos").collect()
    assert [(r.tag_value, r.overdue, r.problems) for r in rows] == [("DE", 1, 1), ("FR", 0, 0)]


def test_no_match_name(spark):
    runs = make_runs(spark, [dict(process_id="a", status="ACTIVE", tags=tags(("k", "v")))])
    assert A.tag_impact(runs, T0, 24, name="nope").count() == 0
    assert A.tag_totals(runs, T0, 24, name="nope").first().total == 0


def test_duration_stats_exact(spark):
    runs = make_runs(spark, [
        dict(process_id="a", status="COMPLETED", started=-1000, completed=-900, tags=tags(("country", "DE"))),
        dict(process_id="b", status="COMPLETED", started=-1000, completed=-700, tags=tags(("country", "DE"))),
    ])
    r = A.tag_impact(runs, T0, 24).first()
    assert (r.dur_count, r.avg_s, r.p50_s, r.p90_s, r.p99_s) == (2, 200.0, 200.0, 280.0, 298.0)


def test_window_scoping(spark):
    runs = make_runs(spark, [
        dict(process_id="old", status="COMPLETED", started=-200000, completed=-48 * 3600),
        dict(process_id="live", status="ACTIVE"),
    ])
    assert A.tag_totals(runs, T0, 24).first().total == 1
    assert A.tag_totals(runs, T0, 168).first().total == 2


def test_failed_is_problem_without_latency(spark):
    runs = make_runs(spark, [dict(process_id="f", status="FAILED", started=-500, completed=-120,
                                  tags=tags(("provider", "acme")))])
    r = A.tag_impact(runs, T0, 24).first()
    assert (r.failed, r.problems, r.dur_count, r.avg_s, r.p50_s) == (1, 1, 0, None, None)


def test_summary_and_names(spark):
    runs = make_runs(spark, [
        dict(process_id="a", name="n", status="ACTIVE", started=-3600, deadline=-60),
        dict(process_id="b", name="n", status="COMPLETED", started=-3600, deadline=-1800, completed=-600),
    ])
    r = A.name_rollups(runs, T0).first()
    assert (r.total, r.active, r.overdue, r.completed, r.completed_late, r.completed_on_time) == (2, 1, 1, 1, 1, 0)
    s = A.summary(runs, T0).first()
    assert (s.total, s.overdue, s.completed_late, s.completed_24h) == (2, 1, 1, 1)


def test_and_tags_same_element(spark):
    runs = make_runs(spark, [
        dict(process_id="de-web", status="ACTIVE", tags=tags(("country", "DE"), ("channel", "web"))),
        dict(process_id="de-app", status="ACTIVE", tags=tags(("country", "DE"), ("channel", "app"))),
        dict(process_id="fr-web", status="ACTIVE", tags=tags(("country", "FR"), ("channel", "web"))),
        dict(process_id="untagged", status="ACTIVE"),
    ])

    def ids(flt):
        return sorted(r.process_id for r in FL.apply_filter(runs, flt, T0).collect())
    assert ids(RunFilter(tags={"country": "DE"})) == ["de-app", "de-web"]
    assert ids(RunFilter(tags={"country": "DE", "channel": "web"})) == ["de-web"]
    assert ids(RunFilter(tags={"country": "web"})) == []


def test_deadline_status_filters(spark):
    runs = make_runs(spark, [
        dict(process_id="missed", status="ACTIVE", deadline=-60),
        dict(process_id="on-track", status="ACTIVE", deadline=600),
        dict(process_id="on-time", status="COMPLETED", deadline=-60, completed=-120),
        dict(process_id="late", status="COMPLETED", deadline=-600, completed=-60),
        dict(process_id="no-deadline", status="ACTIVE"),
    ])
    for status, expect in [("MISSED", "missed"), ("ON_TRACK", "on-track"),
                           ("COMPLETED_ON_TIME", "on-time"), ("COMPLETED_LATE", "late")]:
        got = [r.process_id for r in FL.apply_filter(runs, RunFilter(deadline_status=status), T0).collect()]
        assert got == [expect]


def test_sort_nulls_last_and_fallback(spark):
    runs = make_runs(spark, [
        dict(id=1, process_id="b", status="ACTIVE", deadline=600),
        dict(id=2, process_id="a", status="ACTIVE", deadline=60),
        dict(id=3, process_id="c", status="ACTIVE"),
    ])

    def order(key, d):
        return [r.process_id for r in L.page(runs, L.sort_columns(key, d, T0), 20, 0).orderBy("pos").collect()]
    assert order("deadline", "asc") == ["a", "b", "c"]
    assert order("deadline", "desc") == ["b", "a", "c"]
    assert order(None, None) == ["c", "a", "b"]  # started_at equal → id desc
    assert order("id; drop table", "desc") == order("started_at", "desc")


def test_paging(spark):
    runs = make_runs(spark, [dict(id=i, process_id=f"run-{i}", status="ACTIVE", started=-1000 + i)
                             for i in range(1, 6)])
    order = L.sort_columns("started_at", "desc", T0)
    p1 = [r.process_id for r in L.page(runs, order, 2, 0).orderBy("pos").collect()]
    p2 = [r.process_id for r in L.page(runs, order, 2, 2).orderBy("pos").collect()]
    assert (p1, p2) == (["run-5", "run-4"], ["run-3", "run-2"])
    info = L.page_info(runs, None, T0, 2, 2).first()
    assert (info.total, info.rows, info.has_more) == (5, 2, True)
    assert L.clamp_page(500, -3) == (100, 0)


def test_warning_threshold_bounds(spark):
    runs = make_runs(spark, [
        dict(id=1, process_id="at-75", status="ACTIVE", started=-750, deadline=250),
        dict(id=2, process_id="at-20", status="ACTIVE", started=-200, deadline=800),
        dict(id=3, process_id="inverted", status="ACTIVE", started=-100, deadline=-200),
        dict(id=4, process_id="past", status="ACTIVE", started=-2000, deadline=-10),
        dict(id=5, process_id="deadline-now", status="ACTIVE", started=-2000, deadline=0),
    ])
    got = [r.process_id for r in S.warning_scan(runs, T0, 0.75).collect()]
    assert got == ["at-75"]
    missed = [r.process_id for r in S.missed_scan(runs, T0).collect()]
    assert missed == ["inverted", "past"]  # deadline == as_of is neither
    assert S.warning_scan(runs, T0, 1.0).count() == 0
    payload = S.warning_scan(runs, T0, 0.75).first().payload
    assert '"seconds_remaining":250' in payload and '"tags":null' in payload


def test_circuit_breaker(spark):
    rows = [(1, i + 1, 100 + i, False) for i in range(7)]
    rows += [(2, i + 1, 200 + i, ok) for i, ok in enumerate([False, True, False, True, False, True])]
    att = spark.createDataFrame(rows, "scan_id long, pos int, run_id long, delivered boolean")
    marked = sorted((r.scan_id, r.run_id) for r in S.circuit_breaker(att).collect())
    assert marked == [(2, 201), (2, 203), (2, 205)]


def test_gauge_reset(spark):
    prev = spark.createDataFrame([("a", 3), ("b", 1)], "name string, overdue long")
    cur = spark.createDataFrame([("b", 2)], "name string, overdue long")
    got = {r.name: r.overdue for r in M.overdue_gauge(prev, cur).collect()}
    assert got == {"a": 0, "b": 2}
    many = spark.createDataFrame([(f"n{i}", 1) for i in range(120)], "name string, overdue long")
    assert M.overdue_gauge(many, cur).count() == 121
    kept = M.overdue_gauge(many, cur, cap=100).collect()
    assert {r.name for r in kept} == {"b"}  # over a registry's cap, zeroed series are dropped


def test_response_row(spark):
    from datetime import datetime
    from duewatch.sources.runs import RUNS
    st = datetime(2022, 1, 1, 0, 0)
    dl = datetime(2022, 1, 1, 1, 0)
    rows = [(1, "on-time", "p", "COMPLETED", st, datetime(2022, 1, 1, 1, 0), dl, None, None, st, st, None, None, None),
            (2, "late", "p", "COMPLETED", st, datetime(2022, 1, 1, 2, 0), dl, None, None, st, st, None, None, None)]
    runs = spark.createDataFrame(rows, RUNS)
    got = {r.id: (r.duration, r.deadline_status, r.started_at, r.deadline)
           for r in L.run_response(runs, "2023-01-01T00:00:00Z").collect()}
    assert got == {"on-time": (3600, "COMPLETED_ON_TIME", 1640995200, 1640998800),
                   "late": (7200, "COMPLETED_LATE", 1640995200, 1640998800)}


# -- the deadline pass -------------------------------------------------------------

def _pass_runs(spark, late=0, soon=0):
    return make_runs(spark, [dict(id=i + 1, process_id=f"late{i}", status="ACTIVE", started=-3600, deadline=-600 + i)
                             for i in range(late)]
                     + [dict(id=100 + i, process_id=f"soon{i}", status="ACTIVE", started=-900, deadline=100 + i)
                        for i in range(soon)])


def _marks(spark, runs, ok, **options):
    through = spark.createDataFrame(ok, "id long, event string")
    return {(r.id, r.event) for r in S.deadline_pass(runs, through, T0, **options).collect()}


def test_pass_marks_only_what_was_delivered(spark):
    runs = _pass_runs(spark, late=3, soon=2)
    ok = [(1, S.MISSED_EVENT), (3, S.MISSED_EVENT), (101, S.WARNING_EVENT)]
    assert _marks(spark, runs, ok) == set(ok)


def test_pass_stops_after_consecutive_failures(spark):
    runs = _pass_runs(spark, late=9, soon=1)
    ok = [(i, S.MISSED_EVENT) for i in (1, 7, 8)] + [(100, S.WARNING_EVENT)]
    # 2 to 6 fail in a row, so 7 and 8 are not tried any more; the warning pass is its own.
    assert _marks(spark, runs, ok) == {(1, S.MISSED_EVENT), (100, S.WARNING_EVENT)}
    assert _marks(spark, runs, []) == set()


def test_pass_with_delivery_disabled_marks_all(spark):
    runs = _pass_runs(spark, late=7, soon=2)
    assert len(_marks(spark, runs, [], enabled=False)) == 9


def test_pass_with_warnings_off_and_marks_table(spark):
    runs = _pass_runs(spark, late=2, soon=2)
    every = [(1, S.MISSED_EVENT), (2, S.MISSED_EVENT), (100, S.WARNING_EVENT), (101, S.WARNING_EVENT)]
    assert _marks(spark, runs, every, threshold=1.0) == set(every[:2])
    marks = S.deadline_pass(runs, spark.createDataFrame(every[:1], "id long, event string"), T0)
    left = S.unmarked(S.deadline_events(runs, T0), marks)
    assert {(r.id, r.event) for r in left.collect()} == set(every[1:])
