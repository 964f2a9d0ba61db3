"""Edge rows the reference's tests do not cover."""

from pyspark.sql import functions as F

from duewatch.functions import columns as C
from duewatch.functions import jsoncols as J
from duewatch.functions import text as X
from duewatch.operators import analytics as A
from tests.conftest import T0, make_runs, tags


def test_tag_parsing_edges(spark):
    raw = [None, "", "  ", "[]", '{"key":"x","value":"y"}', "not json", '[{"key":"a"}]',
           tags(("k", "v"), ("k", "v")), tags(*[(f"k{i}", "v") for i in range(101)])]
    df = spark.createDataFrame([(s,) for s in raw], "tags string")
    got = [r.n for r in df.select(F.size(J.parse_tags("tags")).alias("n")).collect()]
    assert got == [0, 0, 0, 0, 0, 0, 1, 2, 101]
    nulls = [r.j for r in df.select(J.tags_to_json(J.parse_tags("tags")).alias("j")).collect()]
    assert nulls[:6] == [None] * 6


def test_duplicate_tags_count_twice_and_101_tags(spark):
    runs = make_runs(spark, [
        dict(process_id="dup", status="ACTIVE", tags=tags(("k", "v"), ("k", "v"))),
        dict(process_id="many", status="ACTIVE", tags=tags(*[(f"k{i:03d}", "v") for i in range(101)])),
        dict(process_id="obj", status="ACTIVE", tags='{"key":"k","value":"v"}'),
    ])
    rows = A.tag_rollup(runs, T0, 24).collect()
    kv = {(r.tag_key, r.tag_value): r.total for r in rows}
    assert kv[("k", "v")] == 2 and len(kv) == 102
    assert A.tag_impact(runs, T0, 24).count() == 100


def test_equalities(spark):
    runs = make_runs(spark, [
        dict(process_id="ca-eq-dl", status="COMPLETED", started=-100, deadline=-50, completed=-50),
        dict(process_id="dl-eq-now", status="ACTIVE", started=-100, deadline=0),
        dict(process_id="zero-budget", status="ACTIVE", started=-100, deadline=-100),
    ])
    got = {r.process_id: (r.ds, r.o, r.b) for r in runs.select(
        "process_id", C.deadline_status(T0).alias("ds"), C.outcome(T0).alias("o"),
        C.budget_used(T0).alias("b")).collect()}
    assert got["ca-eq-dl"][:2] == ("COMPLETED_ON_TIME", "COMPLETED_ON_TIME")
    assert got["dl-eq-now"][:2] == ("ON_TRACK", "ON_TRACK")
    assert got["zero-budget"][2] == 120.0  # no budget, and time has passed


def test_window_bound_inclusive(spark):
    runs = make_runs(spark, [dict(process_id="edge", status="COMPLETED", started=-90000, completed=-24 * 3600)])
    assert A.scope(runs, T0, 24).count() == 1


def test_formatting(spark):
    df = spark.createDataFrame([(None,), (42,), (303,), (3600,), (7500,), (86400 + 3 * 3600,)], "s long")
    got = [r.t for r in df.select(X.fmt_duration("s").alias("t")).collect()]
    assert got == ["—", "42s", "5m 3s", "1h", "2h 5m", "1d 3h"]
    now_s = 1_700_000_000
    rel = spark.createDataFrame([(now_s - 300,), (now_s + 7200,)], "t long")
    got = [r.x for r in rel.select(X.fmt_relative("t", now_s).alias("x")).collect()]
    assert got == ["5m ago", "in 2h"]
    ab = spark.createDataFrame([(1640995200,)], "t long").select(X.fmt_absolute("t").alias("x")).first().x
    assert ab == "2022-01-01 00:00 UTC"


def test_deep_link_spaces_and_sanitize(spark):
    df = spark.createDataFrame([("my proc", "a b/c"), (None, "x")], "name string, process_id string")
    urls = [r.u for r in df.select(X.process_url("https://h/app//").alias("u")).collect()]
    assert urls == ["https://h/app/?process=my+proc/a+b%2Fc", None]
    paths = spark.createDataFrame([("/v1/processes/a/b",), ("/v1/processes/a",), ("/swagger-ui/x/y",), (None,),
                                   ("/x/" + "y" * 120,)], "p string")
    got = [r.s for r in paths.select(X.sanitize_path("p").alias("s")).collect()]
    assert got[:4] == ["/v1/processes/{name}/{id}", "/v1/processes/{name}", "/swagger-ui/**", "unknown"]
    assert len(got[4]) == 103 and got[4].endswith("...")


def test_tag_filter_parse(spark):
    assert X.parse_tag_filter(" a:1, b : x:y ,bad, :e, a:2") == {"a": "2", "b": "x:y"}
    assert X.parse_tag_filter("  ") is None
    df = spark.createDataFrame([(" a:1, b : x:y ,bad, :e, a:2",)], "t string")
    m = df.select(X.parse_tag_filter_col("t").alias("m")).first().m
    assert m == {"a": "2", "b": "x:y"}


def test_round_half_up():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(0.05,), (-0.05,), (2.25,)], "x double")
    assert [r.r for r in df.select(C.round1("x").alias("r")).collect()] == [0.1, 0.0, 2.3]


def test_array_guard_variants(spark):
    raw = [' \n [{"key":"k","value":"v"}]', "[1,2", '[{"key":"k","value":"v"}', "[]x", '{"a":[1]}', "\t[]"]
    df = spark.createDataFrame([(s,) for s in raw], "tags string")
    got = [r.n for r in df.select(F.size(J.parse_tags("tags")).alias("n")).collect()]
    want = [r.n for r in df.select(F.size(F.coalesce(
        F.when(F.json_array_length("tags").isNotNull(), F.from_json("tags", J.TAGS)),
        F.array().cast(J.TAGS))).alias("n")).collect()]
    assert got == want


def test_multi_tag_containment_edges(spark):
    from duewatch.operators.filters import has_tags
    df = spark.createDataFrame([('[{"key":"k","value":"v"},{"key":"k","value":"v"},{"key":"a"}]',),
                                ('[{"key":"k","value":"v"},{"key":"a","value":"x"}]',),
                                ('{"key":"k","value":"v"}',), (None,)], "tags string")
    both = [r.m for r in df.select(has_tags({"k": "v", "a": "x"}).alias("m")).collect()]
    assert both == [False, True, False, False]
    one = [r.m for r in df.select(has_tags({"k": "v"}).alias("m")).collect()]
    assert one == [True, True, False, False]


def test_arrays_with_other_elements(spark):
    """SQL unnests every element and finds tags beside others; the typed response takes arrays of objects only."""
    raw = ['[1,{"key":"k","value":"v"}]', '[{"key":"k","value":"v"}] junk', "[null]", '[["x"],{"key":7,"value":{"a":1}}]', "[1", '[{"key":"k","value":"v"}]\n']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "id int, tags string")
    got = {}
    for r in A.explode_tags(df, "id").collect():
        got.setdefault(r.id, []).append((r.tag_key, r.tag_value))
    assert got == {0: [(None, None), ("k", "v")], 2: [(None, None)], 3: [(None, None), ("7", '{"a":1}')], 5: [("k", "v")]}
    assert [r.hit for r in df.orderBy("id").select(J.has_tag("k", "v").alias("hit")).collect()] == [True, False, False, False, False, True]
    assert [r.n for r in df.orderBy("id").select(F.size(J.parse_tags("tags")).alias("n")).collect()] == [0, 0, 1, 0, 0, 1]


def test_typed_context(spark):
    import json

    from duewatch.operators.listing import normalize, run_response
    contexts = ['{"n":1,"f":1.5,"b":false,"o":{"p":[1,{"q":null}]},"s":"1"}', None, " ", "[1]", "not json", '{"a":1} tail', "7"]
    runs = make_runs(spark, [dict(process_id=f"p{i}", status="ACTIVE", context=c) for i, c in enumerate(contexts)])
    got = {r.id: json.loads(r.c) for r in run_response(runs, T0).select("id", F.to_json("context").alias("c")).collect()}
    assert got["p0"] == json.loads(contexts[0]) and all(got[f"p{i}"] == {} for i in range(1, 7))
    empty = normalize(run_response(runs, T0).withColumn("context", F.when(F.lit(False), F.col("context"))))
    assert {r.c for r in empty.select(F.to_json("context").alias("c")).collect()} == {"{}"}


def test_a_page_past_the_end_keeps_the_total(spark):
    from duewatch.operators.filters import RunFilter
    from duewatch.operators.listing import list_runs
    runs = make_runs(spark, [dict(process_id=f"p{i}", status="ACTIVE") for i in range(5)])
    assert [(r.pos, r.id, r.total) for r in list_runs(runs, None, T0, 2, 10).collect()] == [(None, None, 5)]
    assert [(r.id, r.total) for r in list_runs(runs, RunFilter(status="FAILED"), T0).collect()] == [(None, 0)]
    assert [r.total for r in list_runs(runs, None, T0, 2, 4).collect()] == [5]


def test_list_order_of_one_field_and_of_several(spark):
    from duewatch.operators.filters import RunFilter
    from duewatch.operators.listing import list_runs
    runs = make_runs(spark, [dict(process_id=p, name=n, status="ACTIVE", started=s) for p, n, s in (("a", "y", -3), ("b", "x", -2), ("c", "y", -1))])

    def ids(**kw):
        return [r.id for r in list_runs(runs, RunFilter(**kw), T0).orderBy("pos").collect()]
    assert ids() == ["c", "b", "a"] and ids(sort_by="started_at", sort_dir="asc") == ids(sort_by="started_at:asc") == ["a", "b", "c"]
    assert ids(sort_by="started_at") == ["c", "b", "a"] and ids(sort_by="nonsense:asc") == ["a", "b", "c"]
    assert ids(sort_by="name:asc,started_at:desc") == ["b", "c", "a"] and ids(sort_by="name:desc,") == ["c", "a", "b"]


def test_burn_rate_arguments(spark):
    import pytest

    from duewatch.operators.timeseries import burn_rate
    runs = make_runs(spark, [dict(process_id="a", status="COMPLETED", started=-100, deadline=-50, completed=-40)])
    assert burn_rate(runs, T0, 24, 0.9).first().burn_rate == 10.0
    for hours, target in ((24, 1.0), (24, 1.5), (24, -0.1), (0, 0.9), (99999, 0.9)):
        with pytest.raises(ValueError):
            burn_rate(runs, T0, hours, target)


def test_old_gauge_snapshots_go(spark, scratch):
    from datetime import timedelta

    from duewatch.sources.epochs import committed
    from duewatch.sources.runs import write_runs
    from duewatch.streaming.counters import gauge_refresher, read_gauges
    write_runs(make_runs(spark, [dict(process_id="a", status="ACTIVE", deadline=-60)]), f"{scratch}/runs")
    refresh = gauge_refresher(f"{scratch}/runs", f"{scratch}/snap", keep=2)
    for epoch in range(5):
        refresh(spark.createDataFrame([((T0 + timedelta(minutes=epoch)).replace(tzinfo=None),)], "timestamp timestamp"), epoch)
    assert committed(spark, f"{scratch}/snap") == [3, 4] and read_gauges(spark, f"{scratch}/snap").first().epoch == 4


def test_keyset_pages_cover_a_listing(spark):
    """Pages by the last row's key, for every sort field both ways, make up the whole listing; ties and nulls included."""
    from duewatch.operators.filters import RunFilter
    from duewatch.operators.listing import SORT_KEYS, keyset_page, sort_columns, sort_expression
    runs = make_runs(spark, [dict(process_id=f"p{i}", name="xyz"[i % 3], status=("ACTIVE", "COMPLETED")[i % 2], started=-100 * (i % 4), completed=-i if i % 2 else None,
                                  deadline=None if i % 5 == 0 else 60 * (i % 3)) for i in range(23)])
    for key in SORT_KEYS:
        for direction in ("asc", "desc"):
            want = [r.id for r in runs.orderBy(*sort_columns(key, direction, T0)).collect()]
            got, after = [], None
            while True:
                rows = keyset_page(runs, RunFilter(sort_by=key, sort_dir=direction), T0, after, 7).withColumn("k", sort_expression(key, T0)).orderBy("pos").collect()
                if not rows:
                    break
                got += [r.id for r in rows]
                after = (rows[-1].k, rows[-1].id)
            assert got == want, (key, direction)
