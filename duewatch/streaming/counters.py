"""Streaming counters, request-health windows and the periodic gauge refresh
(SURVEY §2.K7–K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duewatch.operators import metrics as M
from duewatch.sources.epochs import committed, prune, write_epoch
from duewatch.sources.runs import read_stored_runs


def stream_counters(events: DataFrame) -> DataFrame:
    """Per-name deadline event counts over a stream; run in ``update`` or
    ``complete`` output mode (partial aggregation happens per micro-batch,
    the running totals live in the state store)."""
    return M.event_counters(events)


def stream_request_alerts(requests: DataFrame, watermark: str = "10 minutes", **kw) -> DataFrame:
    """Sliding-window request health on a stream; windows close (append mode)
    once the watermark passes their end and are then final. A row behind the
    watermark is still merged if its windows are held in state, and dropped
    once they have been emitted. Spark reports drops in
    ``numRowsDroppedByWatermark``, counting (row, window) pairs, so a 5-minute
    window sliding by 1 minute counts 5 per row."""
    return M.request_alerts_binned(requests.withWatermark("ts", watermark), **kw)


GAUGES = "name string, overdue long, active long, epoch long"


def gauge_refresher(runs_path: str, snapshot_path: str, cap: int | None = None, keep: int = 10):
    """A ``foreachBatch`` function: on every trigger, recompute overdue and
    active runs per name from the stored runs at the trigger's time, carry the
    newest committed snapshot below this epoch forward (absent names reset to
    0) and write this epoch's own folder. A crash leaves earlier snapshots as
    they are, and a replayed epoch replaces its own. The last ``keep``
    snapshots stay, older ones are deleted."""
    def refresh(batch: DataFrame, epoch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        ticks = batch.agg(F.max("timestamp").alias("t")).first()
        if ticks is None or ticks.t is None:
            return
        earlier = [e for e in committed(spark, snapshot_path) if e < epoch_id]
        prev = spark.read.schema(GAUGES).parquet(f"{snapshot_path}/epoch={earlier[-1]}").select("name", "overdue") if earlier else None
        snap = M.gauge_snapshot(read_stored_runs(spark, runs_path), F.lit(ticks.t).cast("timestamp"), prev, cap)
        write_epoch(snap.withColumn("epoch", F.lit(epoch_id).cast("long")), snapshot_path, epoch_id)
        if len(earlier) >= keep:
            prune(spark, snapshot_path, earlier[-keep])
    return refresh


def read_gauges(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """The newest committed snapshot."""
    return spark.read.schema(GAUGES).parquet(f"{snapshot_path}/epoch={committed(spark, snapshot_path)[-1]}")


def stream_gauges(spark: SparkSession, runs_path: str, snapshot_path: str, checkpoint: str,
                  interval: str = "30 seconds"):
    """Start the 30-second gauge refresh as a streaming query on a rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.foreachBatch(gauge_refresher(runs_path, snapshot_path))
            .option("checkpointLocation", checkpoint).trigger(processingTime=interval).start())
