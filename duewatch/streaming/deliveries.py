"""Deliveries that stay unacknowledged come out again, once for each retry interval.

A key (run, event) waits from the instant its outbox row was emitted. At each
interval after it the row is emitted with the number of the attempt, until an
acknowledgement has come (before or after the row itself) or the attempts are
used up. Keys are many and have two rows each, so none is hot; a key's state
ends with its last attempt or, acknowledged, an interval later.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_LONG, _TEXT = T.LongType(), T.StringType()
RETRIES = T.StructType([T.StructField("id", _LONG), T.StructField("event", _TEXT), T.StructField("payload", _TEXT),
                        T.StructField("attempt", T.IntegerType()), T.StructField("due_at", _LONG)])
WAIT = T.StructType([T.StructField("acked", T.BooleanType()), T.StructField("emitted_ms", _LONG), T.StructField("attempt", T.IntegerType()),
                     T.StructField("payload", _TEXT)])
Retry = Row(*RETRIES.names)


class PendingDeliveries(StatefulProcessor):
    def __init__(self, interval_ms: int, attempts: int):
        self.interval, self.attempts = interval_ms, attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", WAIT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        acked, emitted, attempt, payload = self.wait.get() if self.wait.exists() else (False, None, 0, None)
        latest = None
        for r in rows:
            latest = max(latest or 0, r.at_ms)
            if r.acked:
                acked = True
            elif emitted is None:
                emitted, payload = r.at_ms, r.payload
        if acked:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            # Kept for an interval, so that a row that comes after its acknowledgement isn't retried.
            self.handle.registerTimer(latest + self.interval)
        elif attempt == 0 and emitted is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(emitted + self.interval)
        self.wait.update((acked, emitted, attempt, payload if not acked else None))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.wait.exists():
            return
        acked, emitted, attempt, payload = self.wait.get()
        if acked or emitted is None:
            self.wait.clear()
            return
        now = timerValues.getCurrentWatermarkInMs()
        due = emitted + (attempt + 1) * self.interval
        while due <= now and attempt < self.attempts:  # a watermark that leaps passes several intervals
            attempt += 1
            yield Retry(key[0], key[1], payload, attempt, due // 1000)
            due += self.interval
        if attempt >= self.attempts:
            self.wait.clear()
        else:
            self.wait.update((False, emitted, attempt, payload))
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def stream_retries(outbox: DataFrame, acknowledged: DataFrame, interval_seconds: int = 60, attempts: int = 5,
                   watermark: str = "1 minute") -> DataFrame:
    """Outbox rows (id, event, payload, emitted_at) and acknowledgements (id, event, acked_at), both in epoch seconds → rows to deliver again.

    Instants are event time. With the streams at rest behind their watermark,
    the keys still coming out are those of
    :func:`duewatch.operators.scans.pending_deliveries`."""
    sent = outbox.select("id", "event", "payload", F.lit(False).alias("acked"), (F.col("emitted_at") * 1000).alias("at_ms"))
    heard = acknowledged.select("id", "event", F.lit(None).cast("string").alias("payload"), F.lit(True).alias("acked"),
                                (F.col("acked_at") * 1000).alias("at_ms"))
    rows = sent.unionByName(heard).withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", watermark)
    return (rows.groupBy("id", "event").transformWithState(PendingDeliveries(interval_seconds * 1000, attempts), RETRIES, "Append", "EventTime"))
