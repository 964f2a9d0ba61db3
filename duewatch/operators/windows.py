"""Per-name top-k and run-length operators.

Per-key top-k uses ``row_number() <= k``; Spark inserts a partial
``WindowGroupLimit`` before the shuffle, so each map task sends at most k rows
per key even when one name holds a large share of all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duewatch.functions import columns as C
from duewatch.functions.text import status_tone
from duewatch.functions.time import instant

STRIP_LEN = 8


def newest_first() -> list[Column]:
    return [F.col("started_at").desc(), F.col("id").desc()]


def newest_per_name(runs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("name").orderBy(*newest_first())
    return runs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def recent_strip(runs: DataFrame, as_of, n: int = STRIP_LEN) -> DataFrame:
    """The last ``n`` runs of each name as tones, oldest → newest, padded with
    ``empty`` to ``n`` cells."""
    top = newest_per_name(runs, n).select("name", "rn", status_tone(C.deadline_status(as_of)).alias("tone"))
    cells = F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), F.col("tone").alias("t"))))
    agg = top.groupBy("name").agg(F.transform(cells, lambda s: s["t"]).alias("_tones"))
    padded = F.concat(F.col("_tones"), F.array_repeat(F.lit("empty"), F.lit(n) - F.size("_tones")))
    return agg.select("name", F.size("_tones").alias("runs_shown"), F.concat_ws(",", padded).alias("strip"))


def last_run(runs: DataFrame, as_of) -> DataFrame:
    """Latest run per name (by started_at, then id) via a partial-aggregating ``max_by``."""
    key = F.struct("started_at", "id")
    latest = F.max_by(F.struct("id", "process_id", "status", "started_at", "completed_at", "deadline"), key)
    agg = runs.groupBy("name").agg(latest.alias("r"))
    return agg.select("name", "r.id", "r.process_id", "r.status",
                      F.unix_seconds("r.started_at").alias("started_at"),
                      (F.unix_seconds(F.coalesce(F.col("r.completed_at"), instant(as_of)))
                       - F.unix_seconds("r.started_at")).alias("duration"))


def related_runs(runs: DataFrame, keys: DataFrame, pool: int = 7, show: int = 6) -> DataFrame:
    """For each key run: up to ``show`` other runs of its name, taken from the
    name's ``pool`` newest runs, skipping those with the same process_id.

    The pool is at most ``pool`` rows per name, gathered into one array per
    name; keys join it on name with no shuffle of the keys when the pool table
    is under the broadcast threshold (it has one row per name)."""
    top = newest_per_name(runs, pool)
    per_name = top.groupBy("name").agg(F.sort_array(F.collect_list(
        F.struct(F.col("rn"), F.col("id").alias("rid"), F.col("process_id").alias("rpid")))).alias("pool"))
    j = keys.select("id", "name", "process_id").join(per_name, "name")
    others = F.slice(F.filter("pool", lambda s: s["rpid"] != F.col("process_id")), 1, show)
    return j.select("id", F.posexplode(others).alias("p", "r")).select(
        "id", F.col("r.rid").alias("related_id"), (F.col("p") + 1).cast("long").alias("related_rank"))


def duplicate_active(runs: DataFrame) -> DataFrame:
    """(name, process_id) pairs with more than one ACTIVE run."""
    return (runs.filter(C.is_active()).groupBy("name", "process_id")
            .agg(F.count(F.lit(1)).alias("active_runs")).filter(F.col("active_runs") > 1))


def sustained(samples: DataFrame, key: list[str], ts: str, cond: Column, hold_seconds: int | Column,
              max_gap_seconds: int | None = None) -> DataFrame:
    """Alert episodes: maximal runs of consecutive samples (per ``key``, in
    ``ts`` order) where ``cond`` holds, reported when they span at least
    ``hold_seconds`` (first to last sample). A gap of more than
    ``max_gap_seconds`` between samples (no data) also ends an episode.

    Samples are one per key per evaluation step, so a key's partition grows
    with the covered time span, not with the data volume."""
    w = Window.partitionBy(*key).orderBy(ts)
    s = samples.withColumn("_on", F.coalesce(cond, F.lit(False)))
    brk = ~F.col("_on")
    if max_gap_seconds is not None:
        gap = F.unix_seconds(F.col(ts)) - F.unix_seconds(F.lag(ts).over(w))
        brk = brk | F.coalesce(gap > max_gap_seconds, F.lit(False))
    s = s.withColumn("_brk", brk)
    s = s.withColumn("_grp", F.sum(F.col("_brk").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = s.filter("_on")
    ep = on.groupBy(*key, "_grp").agg(F.min(ts).alias("since"), F.max(ts).alias("until"),
                                      F.count(F.lit(1)).alias("samples"))
    span = F.unix_seconds("until") - F.unix_seconds("since")
    return ep.filter(span >= hold_seconds).select(
        *key, F.unix_seconds("since").alias("since"), F.unix_seconds("until").alias("until"), "samples")
