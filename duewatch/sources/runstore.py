"""A runs table that a stream can upsert into and a scan can mark, merged on read.

``base/changes=C,marks=M`` holds runs in the layout of
:func:`duewatch.sources.runs.write_runs`, complete up to change epoch C and
mark epoch M. ``changes`` and ``marks`` hold what came since, a folder per
epoch. Neither an upsert nor a mark rewrites a file of the base: a reader takes
the base without the ids that changed, adds their newest rows, and fills in the
marks. :func:`compact` writes a new base now and then.

Filters on the columns of a run reach the base's scan, as both joins keep its
rows: partitions and row groups are skipped as in a plain table. Changes and
marks since the last base are small beside it, so Spark broadcasts their ids
under its size threshold and the base isn't shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duewatch.operators.scans import MISSED_EVENT, WARNING_EVENT
from duewatch.sources.epochs import _fs, committed, prune, read_epochs, write_epoch
from duewatch.sources.runs import RUNS, read_stored_runs, upgrade_runs, write_runs

#: A change: the run as it stands after the command ``seq``, or only its id if it is ``gone``.
CHANGES = T.StructType([T.StructField("seq", T.LongType()), T.StructField("gone", T.BooleanType()),
                        *[T.StructField(f.name, f.dataType) for f in RUNS.fields]])
MARKS = T.StructType([T.StructField("id", T.LongType()), T.StructField("event", T.StringType()),
                      T.StructField("marked_at", T.TimestampType())])


def _base(spark: SparkSession, root: str) -> tuple[str | None, int, int]:
    """(path, change epoch, mark epoch) of the newest complete base."""
    fs, path = _fs(spark, f"{root}/base")
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "changes=*/_SUCCESS")) if fs.exists(path) else []
    names = [d.getPath().getParent().getName() for d in done or []]
    upto = sorted(tuple(map(int, re.fullmatch(r"changes=(-?\d+),marks=(-?\d+)", n).groups())) for n in names)
    return (f"{root}/base/changes={upto[-1][0]},marks={upto[-1][1]}", *upto[-1]) if upto else (None, -1, -1)


def upsert(changes: DataFrame, root: str, epoch: int) -> None:
    """Append one micro-batch of changes (:data:`CHANGES`); only the newest of a run is kept.

    The newest is taken in each task before the shuffle, so a run that changes often sends few rows."""
    rows = changes.select(*[F.col(f.name).cast(f.dataType) for f in CHANGES.fields])
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*CHANGES.names), "seq").alias("c")).select("c.*")
    write_epoch(newest, f"{root}/changes", epoch)


def mark_runs(marks: DataFrame, root: str, epoch: int) -> None:
    """Append one pass's marks (id, event, marked_at); no file of the runs is touched."""
    write_epoch(marks.select(*[F.col(f.name).cast(f.dataType) for f in MARKS.fields]), f"{root}/marks", epoch)


def _with_marks(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """A run keeps the newest mark of each kind, and counts as updated then if it wasn't later."""
    def newest(event: str) -> F.Column:
        return F.max(F.when(F.col("event") == event, F.col("marked_at")))
    m = marks.groupBy(F.col("id").alias("_id")).agg(newest(MISSED_EVENT).alias("_missed"), newest(WARNING_EVENT).alias("_warned"))
    joined = runs.join(m, runs["id"] == m["_id"], "left")
    new = {"deadline_notified_at": F.coalesce("_missed", "deadline_notified_at"),
           "deadline_warned_at": F.coalesce("_warned", "deadline_warned_at"),
           "updated_at": F.greatest("updated_at", "_missed", "_warned")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in RUNS.names])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs as of the newest committed changes and marks."""
    path, upto, marked = _base(spark, root)
    changes = read_epochs(spark, f"{root}/changes", CHANGES, after=upto)
    newest = changes.groupBy("id").agg(F.max_by(F.struct(*CHANGES.names), "seq").alias("c")).select("c.*")
    live = upgrade_runs(newest.where("NOT gone").drop("seq", "gone"))
    if path is not None:
        kept = read_stored_runs(spark, path).join(changes.select("id"), "id", "left_anti")
        live = upgrade_runs(kept).unionByName(live)
    if not committed(spark, f"{root}/marks", marked):
        return live
    return _with_marks(live, read_epochs(spark, f"{root}/marks", MARKS, after=marked))


def compact(spark: SparkSession, root: str, files: int | None = None, clean: bool = False) -> str:
    """Write a new base from all that is committed; ``clean`` deletes the epochs that it holds.

    Readers that began before go on with the older base and epochs, so clean
    only when none can be left. A base without ``_SUCCESS`` is never read."""
    old, upto, marked = _base(spark, root)
    new = (max(committed(spark, f"{root}/changes"), default=upto), max(committed(spark, f"{root}/marks"), default=marked))
    path = f"{root}/base/changes={new[0]},marks={new[1]}"
    if path != old:
        write_runs(read_runs(spark, root), path, files=files)
    if clean:
        prune(spark, f"{root}/changes", new[0])
        prune(spark, f"{root}/marks", new[1])
    return path
