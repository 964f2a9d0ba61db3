"""Views derived from the driver's TPC-H-like tables.

The driver has no run table, so ``runs`` is a deterministic view over
``orders ⋈ customer ⋈ nation ⋈ region``; commands, HTTP requests and delivery
attempts are views over ``events``. The SQL twins of these views live in
``duewatch.plans.oracle``.

Joins are written without hints: ``nation`` and ``region`` are a few rows, so
Spark broadcasts them under ``spark.sql.autoBroadcastJoinThreshold`` (a size
check on file statistics); ``customer`` grows with the data and is broadcast
only while it is under that threshold, else it is sort-merge joined on
``o_custkey``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from duewatch.functions.time import MICROS_PER_DAY, MICROS_PER_HOUR, to_micros

AS_OF = datetime(2001, 8, 1, tzinfo=timezone.utc)
AS_OF_US = to_micros(AS_OF)  # 996624000000000

# Fixed values of the fixture definition: deadline budget per order priority
# (days; 5-LOW has no deadline).
BUDGET_DAYS = {"1-URGENT": 45, "2-HIGH": 90, "3-MEDIUM": 150, "4-NOT SPECIFIED": 210}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _budget_days() -> F.Column:
    col = F.col("o_orderpriority")
    expr = None
    for priority, days in BUDGET_DAYS.items():
        expr = (F.when(col == priority, F.lit(days)) if expr is None
                else expr.when(col == priority, F.lit(days)))
    return expr.cast("long")


def _tag_json() -> F.Column:
    def pair(key, col):
        return F.concat(F.lit('{"key":"' + key + '","value":"'), F.col(col), F.lit('"}'))
    return F.concat(F.lit("["), pair("region", "r_name"), F.lit(","), pair("country", "n_name"),
                    F.lit(","), pair("priority", "o_orderpriority"), F.lit("]"))


def derive_runs(spark: SparkSession, sf_dir: str, as_of_us: int = AS_OF_US) -> DataFrame:
    """The ``runs`` view (schema ``duewatch.sources.runs.RUNS``)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    cust = customer.join(geo, customer.c_nationkey == geo.n_nationkey).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name")
    base = orders.join(cust, orders.o_custkey == cust.c_custkey)

    key = F.col("o_orderkey")
    started_us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    budget = _budget_days()
    deadline_us = started_us + budget * F.lit(MICROS_PER_DAY)
    spread_us = ((key * 7919 + F.col("o_custkey") * 104729) % 207360) * F.lit(100_000_000)
    end_us = F.when((key % 97 == 0) & budget.isNotNull(), deadline_us).otherwise(started_us + spread_us)

    staged = base.select(
        key.alias("id"),
        F.concat(F.lit("run-"), key.cast("string")).alias("process_id"),
        F.lower(F.col("c_mktsegment")).alias("name"),
        F.col("o_orderstatus"), F.col("o_custkey"),
        started_us.alias("started_us"), deadline_us.alias("deadline_us"), end_us.alias("end_us"),
        F.when(key % 17 == 0, F.lit(None).cast("string"))
         .when(key % 101 == 0, F.lit('{"key":"region","value":"none"}'))
         .when(key % 103 == 0, F.lit("not json"))
         .when(key % 107 == 0, F.lit('[1,{"key":"region","value":"none"}]'))
         .when(key % 109 == 0, F.lit('[{"key":"region","value":"none"}] junk'))
         .otherwise(_tag_json()).alias("tags"),
    )
    as_of = F.lit(as_of_us)
    ts = F.timestamp_micros
    finished = F.col("end_us") <= as_of
    return staged.select(
        F.col("id"), F.col("process_id"), F.col("name"),
        F.when(~finished, F.lit("ACTIVE"))
         .when(F.col("o_orderstatus") == "P", F.lit("FAILED"))
         .otherwise(F.lit("COMPLETED")).alias("status"),
        ts(F.col("started_us")).alias("started_at"),
        F.when(finished, ts(F.col("end_us"))).alias("completed_at"),
        ts(F.col("deadline_us")).alias("deadline"),
        F.col("tags"),
        F.when(F.col("id") % 4 == 1, F.concat(F.lit('{"customer":'), F.col("o_custkey").cast("string"),
                                              F.lit(',"nested":{"a":[1,null,"x"]},"ok":true,"ratio":0.5}')))
         .otherwise(F.concat(F.lit('{"customer":'), F.col("o_custkey").cast("string"), F.lit("}"))).alias("context"),
        ts(F.col("started_us")).alias("created_at"),
        ts(F.when(finished, F.col("end_us")).otherwise(F.col("started_us"))).alias("updated_at"),
        F.lit(None).cast("long").alias("namespace_id"),
        F.when(F.col("id") % 3 == 0, ts(as_of - F.lit(MICROS_PER_HOUR))).alias("deadline_notified_at"),
        F.when(F.col("id") % 4 == 0, ts(as_of - F.lit(MICROS_PER_HOUR))).alias("deadline_warned_at"),
    )


# -- views over events ---------------------------------------------------------

def derive_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle commands: signup → create (deadline ts + 6 h, a tag and a
    context), purchase → complete COMPLETED, error → complete FAILED, views of
    every fifth user → delete, clicks of every eleventh → a kind that doesn't
    exist. Key (journey or trial, user-<id>); ``seq`` is the event id, which
    rises with ``ts``."""
    et, uid = F.col("event_type"), F.col("user_id")
    kind = (F.when(et == "signup", "create").when(et.isin("purchase", "error"), "complete")
            .when((et == "view") & (uid % 5 == 0), "delete").when((et == "click") & (uid % 11 == 0), "pause"))
    ev = table(spark, sf_dir, "events").withColumn("kind", kind).filter("kind IS NOT NULL")
    create = F.col("kind") == "create"
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(uid % 3 == 0, "trial").otherwise("journey").alias("name"),
        F.concat(F.lit("user-"), uid.cast("string")).alias("process_id"),
        "kind",
        F.when(et == "purchase", F.lit("COMPLETED")).when(et == "error", F.lit("FAILED")).alias("status"),
        F.when(create, F.col("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("deadline"),
        F.when(create, F.concat(F.lit('[{"key":"k","value":"'), F.get_json_object("props", "$.k"), F.lit('"}]'))).alias("tags"),
        F.when(create, F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit("}"))).alias("context"),
    )


def derive_http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API request per event: POST for signup, PUT for purchase, GET otherwise."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(et == "signup", F.lit("POST")).when(et == "purchase", F.lit("PUT")).otherwise(F.lit("GET")).alias("method"),
        F.concat(F.lit("/v1/processes/"), et, F.lit("/"), F.col("event_id").cast("string")).alias("path"),
        F.when(et == "error", F.lit(500)).when(et == "signup", F.lit(201)).otherwise(F.lit(200)).alias("status"),
        (F.col("value") * 10).alias("duration_ms"),
    )


def derive_delivery_attempts(spark: SparkSession, sf_dir: str, chunk: int = 1 << 16) -> DataFrame:
    """Webhook delivery attempts: one scan per user, attempts numbered in
    (ts, event_id) order — event ids rise with ts, so by event id. Numbering is
    done per (user, event-id chunk) and offset by the counts of the user's
    earlier chunks, so a very busy user is not numbered in one task."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "event_type", f"CAST(floor(event_id / {int(chunk)}) AS BIGINT) AS _chunk")
    local = ev.selectExpr("*", "row_number() OVER (PARTITION BY user_id, _chunk ORDER BY event_id) AS _rn")
    offsets = (ev.groupBy("user_id", "_chunk").agg(F.expr("count(1)").alias("_n"))
               .selectExpr("user_id", "_chunk", "coalesce(sum(_n) OVER (PARTITION BY user_id ORDER BY _chunk "
                           "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off"))
    return local.join(offsets, ["user_id", "_chunk"]).selectExpr(
        "user_id AS scan_id",
        "CASE WHEN event_type = 'signup' THEN 'deadline_warning' ELSE 'deadline_missed' END AS event",
        "CAST(_off + _rn AS INT) AS pos",
        "event_id AS run_id",
        "event_type IN ('signup', 'purchase') AS delivered")


# Bodies that purchase requests of the fixture send, by event id modulo 40; ``{id}`` is the event id.
ODD_BODIES = [
    '{"id":"user-{id}","deadline":"soon"}', '{"id":"user-{id}","tags":{"key":"k","value":"v"}}', '{"id":"user-{id}","tags":"zz"}',
    '{"id":"user-{id}","context":[1]}', '{"id":["user-{id}"]}', '{"id":"user-{id}"} trailing', '{"id":"user-{id}"}]', '{"id":"user-{id}"}}',
    '{"id":"user-{id}"},{"id":"x"}', '{"id":{id}}', '{"id":"user-{id}","deadline":"4102444800"}', '{"id":"user-{id}","tags":[1]}',
    '{"id":"user-{id}","tags":[{"key":["k"],"value":"v"}]}', '{"id":"user-{id}","deadline":4102444800.5}',
    '{"id":"user-{id}","deadline":null,"tags":null,"context":null}', '{"id":"user-{id}","deadline":true}', '["user-{id}"]', 'null', '  ',
    ' {"id" : "user-{id}", "extra" : [1, {"a" : null}]} ', '{"id":"user-{id}","context":{"n":{"m":[1,2]}},"tags":[{"key":1,"value":true}]}',
    '{"id":"user-{id}","deadline":92233720368547758070}', '{"id":"user-{id}","context":"c"}', '{}',
]
ODD_EVERY = 40
# Bodies that every 29th complete request sends, by event id.
ODD_COMPLETES = ['{"status":["FAILED"]}', '{"status":"FAILED"} x', '{"status":"FAILED"}}', '{"status":null}', '{"status":5}', '[]', '{"other":1}', ' ']


def _odd_body(bodies: list[str], at) -> F.Column:
    """The body numbered ``at`` with the event id filled in; null where there is none."""
    texts = F.array(*[F.lit(b) for b in bodies])
    return F.replace(F.get(texts, at.cast("int")), F.lit("{id}"), F.col("event_id").cast("string"))


def derive_create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON bodies of create requests, one per event, as an API would
    receive them. Field values are taken from the event so that every
    validation rule is exercised by real rows; purchase events also send the
    bodies of ODD_BODIES, and names that end in a line feed."""
    ev = table(spark, sf_dir, "events")
    et, uid, val, eid = F.col("event_type"), F.col("user_id"), F.col("value"), F.col("event_id")
    k = F.get_json_object(F.col("props"), "$.k")
    # name: the event type; blank for view events with an odd user id, by a space or a tab
    name = (F.when((et == "view") & (uid % 4 == 1), F.lit(" ")).when((et == "view") & (uid % 4 == 3), F.lit("\t"))
            .when((et == "purchase") & (eid % 37 == 0), F.lit("purchase\n")).otherwise(et))
    pid = F.when(et == "click", F.concat(F.lit("u"), uid.cast("string"))) \
           .otherwise(F.concat(F.lit("user-"), uid.cast("string")))
    deadline_s = F.unix_seconds(F.col("ts").cast("timestamp")) + (F.floor(val * 60).cast("long") - 600)
    tag = F.concat(F.lit('{"key":"k","value":"'), k, F.lit('"}'))
    tags = F.when(et == "error", F.concat(F.lit('[{"key":"k","value":" "},'), tag, F.lit("]"))) \
            .otherwise(F.concat(F.lit("["), tag, F.lit("]")))
    body = F.concat(
        F.lit('{"id":"'), pid, F.lit('","deadline":'), deadline_s.cast("string"),
        F.lit(',"tags":'), tags, F.lit(',"context":{"event":'), F.col("event_id").cast("string"), F.lit("}}"))
    odd = F.when(et == "purchase", _odd_body(ODD_BODIES, eid % ODD_EVERY))
    return ev.select(
        F.col("event_id").alias("request_id"),
        name.alias("name"),
        F.when((et == "click") & (uid % 13 == 0), F.lit("{broken")).otherwise(F.coalesce(odd, body)).alias("body"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


def derive_complete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw complete bodies: purchase → COMPLETED, error → FAILED, click → an
    empty body (defaults to COMPLETED), view → ACTIVE (rejected). Some users
    send a body that can't be read, a bare string, or a status that doesn't
    exist; every 29th event sends one of ODD_COMPLETES."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") != "signup")
    et, eid = F.col("event_type"), F.col("event_id")
    uid = F.col("user_id")
    odd = F.when(eid % 29 == 0, _odd_body(ODD_COMPLETES, (eid / 29).cast("long") % len(ODD_COMPLETES)))
    body = (F.when(odd.isNotNull(), odd).when(uid % 17 == 0, F.lit("{broken")).when(uid % 19 == 0, F.lit('"completed"'))
            .when(uid % 23 == 0, F.lit('{"status":"DONE"}')).when(et == "purchase", F.lit('{"status":"COMPLETED"}'))
            .when(et == "error", F.lit('{"status":"FAILED"}'))
            .when(et == "view", F.lit('{"status":"ACTIVE"}')))
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.lit("journey").alias("name"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("process_id"),
        body.alias("body"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


# The four rules of the fixture (id, event type, threshold type and value, names, tags, channels).
FIXTURE_RULES = [
    ("r1", "deadline_approaching", "percent", 75.0, [], {}, ["slack-ops"]),
    ("r2", "deadline_breached", "duration", 0.0, ["building"], {}, ["pager"]),
    ("r3", "process_completed", "percent", 0.0, [], {"priority": "1-URGENT"}, ["email", "slack-ops"]),
    ("r4", "deadline_approaching", "duration", 86400.0, ["machinery"], {"region": "EUROPE"}, ["webhook"]),
]


def fixture_rules(spark: SparkSession) -> DataFrame:
    from duewatch.operators.rules import RULES

    return spark.createDataFrame(FIXTURE_RULES, RULES)
