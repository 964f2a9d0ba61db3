"""Unit checks for helpers without a SQL twin (SURVEY marks them U)."""

from pyspark.sql import functions as F

from duewatch.functions import jsoncols as J
from duewatch.operators.listing import page_by_number, parse_sort, sort_multi
from duewatch.sources.runs import RUNS, jdbc_options, upgrade_runs


def test_parse_sort():
    assert parse_sort(None) == ("started_at", "desc")
    assert parse_sort("  ") == ("started_at", "desc")
    assert parse_sort("deadline") == ("deadline", "asc")
    assert parse_sort("deadline:desc,name:asc") == ("deadline", "desc")
    assert parse_sort("name:") == ("name", "asc")


def test_page_by_number():
    assert page_by_number(1, 20) == (20, 0)
    assert page_by_number(3, 500) == (50, 100)
    assert page_by_number(0, 10) == (10, 0)


def test_context_round_trip_and_raw(spark):
    df = spark.createDataFrame([('{"a":"1","b":{"c":2}}',), ("",), ("nope",), (None,)], "ctx string")
    out = df.select(J.parse_context("ctx").alias("m")).select(
        F.size("m").alias("n"), J.context_to_json(F.col("m")).alias("j")).collect()
    assert [r.n for r in out] == [2, 0, 0, 0]
    assert out[0].j == '{"a":"1","b":"{\\"c\\":2}"}' and out[1].j is None
    raw = [r.x for r in df.select(J.parse_or_raw("ctx").alias("x")).collect()]
    assert raw[0] == '{"a":"1","b":{"c":2}}' and raw[2] == "nope" and raw[3] is None


def test_jdbc_options():
    o = jdbc_options("jdbc:postgresql://db/x", lower_id=1, upper_id=1000, partitions=8)
    assert o["partitionColumn"] == "id" and o["numPartitions"] == "8" and o["fetchsize"] == "500"
    assert "partitionColumn" not in jdbc_options("jdbc:postgresql://db/x")


def test_upgrade_adds_missing_columns(spark):
    df = spark.createDataFrame([(1, "p", "n", "ACTIVE")], "id long, process_id string, name string, status string")
    up = upgrade_runs(df)
    assert up.columns == RUNS.fieldNames()
    assert up.first().deadline_warned_at is None


def test_sort_multi_columns(spark):
    cols = sort_multi("status:asc, bogus:desc, deadline:desc", "2024-01-01T00:00:00Z")
    assert len(cols) == 3  # status, deadline, id tiebreak


def test_outbox_write_is_idempotent(spark, scratch):
    from duewatch.operators import scans as S
    from duewatch.sources.outbox import read_outbox, write_outbox
    from tests.conftest import T0, make_runs
    runs = make_runs(spark, [dict(process_id="late", status="ACTIVE", started=-3600, deadline=-60),
                             dict(process_id="soon", status="ACTIVE", started=-900, deadline=100)])
    events = S.deadline_events(runs, T0)
    path = f"{scratch}/outbox"
    write_outbox(events, path, T0)
    write_outbox(events, path, T0)  # a replayed batch
    from datetime import timedelta
    write_outbox(events, path, T0 + timedelta(days=30))  # replayed a month later
    out = read_outbox(spark, path)
    assert out.count() == 2 == spark.read.parquet(path).count()
    assert {r.event for r in out.collect()} == {S.MISSED_EVENT, S.WARNING_EVENT}


def test_normalize_fills_defaults(spark):
    from duewatch.functions.jsoncols import CONTEXT, TAGS
    from duewatch.operators.listing import normalize
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", TAGS),
                           T.StructField("context", CONTEXT)])
    df = spark.createDataFrame([("a", None, None), ("b", [("k", "v")], {"x": "1"})], schema)
    rows = {r.id: (r.tags, r.context) for r in normalize(df).collect()}
    assert rows["a"] == ([], {}) and rows["b"][1] == {"x": "1"}


def test_rules_match_once_per_target_kind(spark):
    from duewatch.operators import rules as R
    from tests.conftest import T0, make_runs, tags
    runs = make_runs(spark, [
        dict(id=1, process_id="a", name="building", status="ACTIVE", started=-3600, deadline=-10),
        dict(id=2, process_id="b", name="machinery", status="ACTIVE", started=-3600, deadline=600,
             tags=tags(("region", "EUROPE"))),
        dict(id=3, process_id="c", name="x", status="COMPLETED", started=-3600, deadline=600, completed=-5,
             tags=tags(("priority", "1-URGENT")))])
    from duewatch.sources.fixtures import FIXTURE_RULES
    both = ("r5", "deadline_breached", "duration", 0.0, ["building", "building"], {"region": "EUROPE"}, ["pager"])
    rules = spark.createDataFrame([*FIXTURE_RULES, both], R.RULES)
    got = [tuple(r) for r in R.match_rules(runs, rules, T0).collect()]
    fast = set(got)
    assert len(got) == len(fast) and ("r5", 1, "deadline_breached", "pager") in fast
    plan = R.match_rules(runs, rules, T0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and "Cartesian" not in plan
    assert ("r2", 1, "deadline_breached", "pager") in fast
    assert ("r4", 2, "deadline_approaching", "webhook") in fast
    assert {x[3] for x in fast if x[0] == "r3"} == {"email", "slack-ops"}


def test_circuit_breaker_chunked_equals_reference_loop(spark):
    import random
    from duewatch.operators.scans import circuit_breaker
    rnd = random.Random(3)
    rows, expect = [], set()
    for scan in range(40):
        n = rnd.randint(1, 60)
        oks = [rnd.random() < 0.45 for _ in range(n)]
        fails = 0
        for i, ok in enumerate(oks, start=1):
            rows.append((scan, i, scan * 1000 + i, ok))
        for i, ok in enumerate(oks, start=1):  # the pass, row by row
            if not ok:
                fails += 1
                if fails >= 5:
                    break
                continue
            fails = 0
            expect.add((scan, scan * 1000 + i))
    df = spark.createDataFrame(rows, "scan_id long, pos int, run_id long, delivered boolean")
    for chunk in (1, 3, 1 << 16):
        got = {(r.scan_id, r.run_id) for r in circuit_breaker(df, chunk=chunk).collect()}
        assert got == expect, chunk


def test_foreach_batch_writer_replay(spark, scratch):
    """A replayed or overlapping micro-batch of the deadline stream adds only new keys."""
    from duewatch.sources.outbox import foreach_batch_writer, read_outbox
    from duewatch.streaming.deadlines import EVENTS
    rows = [("n", "p", 7, "process.deadline_missed", 1_700_000_000_123), ("n", "q", 8, "process.deadline_warning", 1_700_000_001_000)]
    w = foreach_batch_writer(f"{scratch}/ob")
    for epoch, part in ((0, rows[:1]), (0, rows[:1]), (1, rows)):
        w(spark.createDataFrame(part, EVENTS), epoch)
    out = read_outbox(spark, f"{scratch}/ob")
    assert spark.read.parquet(f"{scratch}/ob").count() == 2
    assert {(r.id, r.emitted_at) for r in out.collect()} == {(7, 1_700_000_000), (8, 1_700_000_001)}



def test_payload_url_and_escaping(spark):
    import json
    from duewatch.operators import scans as S
    from tests.conftest import T0, make_runs, tags
    runs = make_runs(spark, [dict(process_id="a b", name="n", status="ACTIVE", started=-3600, deadline=-60,
                                  tags=tags(("k", "v")), context='{"x":1}')])
    p = json.loads(runs.select(S.event_payload(runs, S.MISSED_EVENT, T0, "https://h/it's/").alias("p")).first().p)
    assert p["url"] == "https://h/it's/?process=n/a+b"
    assert p["tags"] == [{"key": "k", "value": "v"}] and p["context"] == {"x": 1} and p["event"] == S.MISSED_EVENT


def test_burn_rate_empty_window_is_null(spark):
    from duewatch.operators.timeseries import burn_rate
    from tests.conftest import T0, make_runs
    runs = make_runs(spark, [dict(process_id="a", name="quiet", status="ACTIVE", started=-3600, deadline=3600)])
    r = burn_rate(runs, T0, 24, 0.9).first()
    assert (r.total, r.error_pct, r.burn_rate) == (0, None, None)
