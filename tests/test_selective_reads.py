"""Lookups that skip row groups, told from the scans' own metrics, and the same rows as the plain filters."""

import os
import pytest
from pyspark.sql import functions as F

from duewatch.operators import filters as FL
from duewatch.sources.fixtures import derive_runs
from duewatch.sources.runs import _input_bytes, read_stored_runs, write_runs
from duewatch.sources.tagindex import tagged_ids, tagged_runs, write_tag_index
from tests.conftest import at, make_runs, tags

SF = "/root/testdata/sf0.01"


def scanned(df, of):
    """Rows that the file scans of the folder ``of`` handed on while ``df`` ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, total, todo = "", 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec" and of in p.relation().location().rootPaths().toString():
            total += p.metrics().apply("numOutputRows").value()
            text += p.simpleString(10_000)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total, text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("selective"))
    runs = derive_runs(spark, SF)
    write_runs(runs, f"{root}/runs", files=24)
    many = [dict(process_id=f"x{i}", status="COMPLETED", started=-i * 60, completed=-i * 60 + 30, tags=tags(("order", f"o{i // 4}"), ("kind", "a" if i % 2 else "b")))
            for i in range(4000)]
    many += [dict(process_id="act", status="ACTIVE", deadline=None, tags=tags(("order", "o7"), ("order", "o7"), ("kind", "b")))]
    write_runs(make_runs(spark, many), f"{root}/many", files=16)
    tagged = read_stored_runs(spark, f"{root}/many")
    write_tag_index(tagged, f"{root}/index", files=16)
    return root


def test_lookup_skips_row_groups(spark, stored):
    runs = read_stored_runs(spark, f"{stored}/runs")
    row = runs.where("status = 'COMPLETED'").orderBy(F.col("id").desc()).first()
    for cond in (F.col("process_id") == row.process_id, F.col("id") == row.id):
        found = runs.where(cond)
        rows, text = scanned(found, "/runs")
        assert rows < 0.25 * runs.count() and "EqualTo(" in text
        assert [r.id for r in found.collect()] == [row.id]
    got = FL.get_run(runs, row.name, row.process_id)
    assert scanned(got, "/runs")[0] < 0.25 * runs.count() and got.first().id == row.id


def test_tags_by_the_index(spark, stored):
    runs = read_stored_runs(spark, f"{stored}/many")
    for pairs in ({"order": "o7"}, {"order": "o7", "kind": "b"}, {"kind": "a"}, {"order": "none"}, {"order": "o7", "kind": "c"}, {"order": "o1"}):
        want = runs.where(FL.has_tags(pairs))
        got = tagged_runs(runs, f"{stored}/index", pairs)
        assert got.columns == runs.columns
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
        assert {r.id for r in tagged_ids(spark, f"{stored}/index", pairs).collect()} == {r.id for r in want.collect()}
    got = tagged_runs(runs, f"{stored}/index", {"order": "o700"})
    assert scanned(got, "/index")[0] < 0.25 * 8000
    assert scanned(tagged_runs(runs, f"{stored}/index", {"order": "o700"}), "/many")[0] < 0.25 * runs.count()
    with pytest.raises(ValueError):
        tagged_ids(spark, f"{stored}/index", {})


def test_size_by_statistics(spark, stored):
    df = spark.read.parquet(f"{stored}/runs")
    files = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{stored}/runs") for f in fs if f.endswith(".parquet"))
    assert _input_bytes(df) == files
    assert _input_bytes(df.join(df.select("id"), "id")) >= files


def test_scans_skip_by_time(spark, stored):
    """Deadline scans and windows read the row groups of their times only."""
    runs = read_stored_runs(spark, f"{stored}/many")
    recent = runs.where((F.col("status") == "COMPLETED") & (F.col("completed_at") >= F.lit(at(-3600))))
    rows, text = scanned(recent, "/many")
    assert recent.count() == 61 and rows < 0.2 * runs.count() and "GreaterThanOrEqual(completed_at" in text
