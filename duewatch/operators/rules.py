"""Notification rules matched to runs.

A rule has an event type, a threshold (percent of the deadline budget or a
duration in seconds), optional targets (process names, or tags that must all
match; any target matching is enough; no targets means every run) and
channels. Each run qualifies for at most one event type at ``as_of``. Rules
meet runs by equi-joins only: on (event type, name) for name targets, and on
(event type, key, value) of one wanted tag for tag targets, whose other tags are
then verified; only untargeted rules, which every run of the type matches, join
on the type alone. Whether a side is broadcast is Spark's choice by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from duewatch.functions import columns as C
from duewatch.functions.jsoncols import TAGS, tag_elements
from duewatch.functions.time import instant

APPROACHING, BREACHED, COMPLETED_EVENT = "deadline_approaching", "deadline_breached", "process_completed"

RULES = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("threshold_type", T.StringType()),
    T.StructField("threshold_value", T.DoubleType()),
    T.StructField("target_names", T.ArrayType(T.StringType())),
    T.StructField("target_tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("channel_ids", T.ArrayType(T.StringType())),
])

def run_event_type(as_of):
    now = instant(as_of)
    dl = F.col("deadline")
    return (F.when(C.is_active() & dl.isNotNull() & (dl > now), F.lit(APPROACHING))
            .when(C.is_active() & dl.isNotNull() & (dl < now), F.lit(BREACHED))
            .when(F.col("status") == C.COMPLETED, F.lit(COMPLETED_EVENT)))


def match_rules(runs: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """One row per (rule, run, channel) that fires at ``as_of``."""
    now_s = F.unix_seconds(instant(as_of))
    r = runs.select("id", "name", F.coalesce(tag_elements("tags"), F.array().cast(TAGS)).alias("_tags"), run_event_type(as_of).alias("event_type"),
                    F.unix_seconds("started_at").alias("_st"), F.unix_seconds("deadline").alias("_dl"),
                    F.unix_seconds("completed_at").alias("_ca")).filter(F.col("event_type").isNotNull())
    names = F.array_distinct(F.coalesce(F.col("target_names"), F.array().cast("array<string>")))
    tags = F.coalesce(F.col("target_tags"), F.create_map().cast("map<string,string>"))
    q = rules.withColumn("_names", names).withColumn("_want", F.sort_array(F.map_entries(tags)))
    by_name = r.join(q.select("*", F.explode("_names").alias("name")), ["event_type", "name"])
    first = F.col("_want")[0]
    tagged = q.filter(F.size("_want") > 0).select("*", first["key"].alias("key"), first["value"].alias("value"))
    one = r.select("*", F.explode(F.array_distinct("_tags")).alias("_t")).select("*", "_t.key", "_t.value").drop("_t")
    # A rule that names the run has matched already.
    by_tag = (one.join(tagged, ["event_type", "key", "value"]).drop("key", "value")
              .filter(~F.array_contains("_names", F.col("name")) & F.forall("_want", lambda e: F.exists(
                  "_tags", lambda t: (t["key"] == e["key"]) & (t["value"] == e["value"])))))
    everyone = q.filter((F.size("_names") == 0) & (F.size("_want") == 0))
    j = by_name.unionByName(by_tag).unionByName(r.join(everyone, "event_type"))
    budget = (F.col("_dl") - F.col("_st")).cast("double")
    v, pct = F.col("threshold_value"), F.col("threshold_type") == "percent"
    et = F.col("event_type")
    approaching_ok = F.when(pct, (now_s - F.col("_st")).cast("double") >= budget * v / 100.0) \
                      .otherwise((F.col("_dl") - now_s).cast("double") <= v)
    breached_ok = F.when(pct, (now_s - F.col("_dl")).cast("double") >= budget * v / 100.0) \
                   .otherwise((now_s - F.col("_dl")).cast("double") >= v)
    completed_ok = F.when(pct, F.coalesce((F.col("_ca") - F.col("_st")).cast("double") >= budget * v / 100.0,
                                          F.lit(True))) \
                    .otherwise((F.col("_ca") - F.col("_st")).cast("double") >= v)
    threshold_ok = (F.when(et == APPROACHING, approaching_ok).when(et == BREACHED, breached_ok)
                    .otherwise(completed_ok))
    fired = j.filter(F.coalesce(threshold_ok, F.lit(False)))
    return fired.select("rule_id", "id", "event_type", F.explode("channel_ids").alias("channel_id"))
