"""Notification outbox: an append-only table of deadline events.

Re-aims webhook delivery: each scan appends its events keyed by
``event_key = md5(id|event)``; a downstream deliverer reads new keys and
records acknowledgements. Writing by key makes re-runs idempotent: a batch
that is replayed after an executor or driver loss rewrites the same keys, and
readers take distinct keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duewatch.functions.time import instant


def outbox_rows(events: DataFrame, as_of) -> DataFrame:
    return events.select(
        "id", "event", "name", "process_id", "payload",
        F.unix_seconds(instant(as_of)).alias("emitted_at"),
        F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("event"))).alias("event_key"))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_outbox(events: DataFrame, path: str, as_of) -> None:
    """Append one scan's events, skipping keys already in the outbox.

    All keys count, whatever their age; the anti-join reads that one column.
    A table that exists but can't be read is an error, not a first write."""
    rows = outbox_rows(events, as_of)
    if _exists(events.sparkSession, path):
        rows = rows.join(events.sparkSession.read.parquet(path).select("event_key"), "event_key", "left_anti")
    rows = rows.withColumn("emit_date", F.to_date(F.timestamp_seconds("emitted_at")))
    rows.write.mode("append").partitionBy("emit_date").parquet(path)


def read_outbox(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).dropDuplicates(["event_key"])


def stream_outbox_rows(events: DataFrame) -> DataFrame:
    """Outbox rows of the deadline stream's events: the run's seq is its id, and it fires at ``fire_at_ms``."""
    body = F.to_json(F.struct("event", "name", F.col("process_id").alias("id"),
                              (F.col("fire_at_ms") / 1000).cast("long").alias("fired_at")))
    return events.select(
        F.col("run_seq").alias("id"), "event", "name", "process_id", body.alias("payload"),
        F.floor(F.col("fire_at_ms") / 1000).cast("long").alias("emitted_at"),
        F.md5(F.concat_ws("|", F.col("run_seq").cast("string"), F.col("event"))).alias("event_key"))


def foreach_batch_writer(path: str):
    """A ``foreachBatch`` function for the stream of deadline events.

    Rows have the layout of :func:`write_outbox`, and keys that the outbox has
    are skipped, so a micro-batch that is replayed after a failure adds only
    what it had not written; readers dedupe by ``event_key``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        rows = stream_outbox_rows(batch).dropDuplicates(["event_key"])
        if _exists(batch.sparkSession, path):
            rows = rows.join(batch.sparkSession.read.parquet(path).select("event_key"), "event_key", "left_anti")
        rows = rows.withColumn("emit_date", F.to_date(F.timestamp_seconds("emitted_at")))
        rows.write.mode("append").partitionBy("emit_date").parquet(path)
    return write
