"""Streaming deadline events.

Replaces the 60-second poll: each key (name, process_id) keeps its current
run in state and two event-time timers — a warning at
``start + (deadline − start) · threshold`` and a miss at the deadline. A
complete or delete that arrives first deletes both timers, so each run emits
each event at most once, at the exact instant rather than at the next poll.
State lives in the checkpointed state store (RocksDB), so a restarted query
resumes without re-sending.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from duewatch.operators.lifecycle import COMPLETE, CREATE, DELETE, decide, run_history
from duewatch.operators.scans import MISSED_EVENT, WARNING_EVENT

EVENTS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("process_id", T.StringType()),
    T.StructField("run_seq", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("fire_at_ms", T.LongType()),
])

RUN_STATE = T.StructType([
    T.StructField("run_seq", T.LongType()),
    T.StructField("warn_ms", T.LongType()),
    T.StructField("deadline_ms", T.LongType()),
])


def fire_times(started_ms, deadline_ms, threshold: float):
    """(warning ms or None, deadline ms or None) for one run."""
    if deadline_ms is None:
        return None, None
    warn = None
    if 0 < threshold < 1 and deadline_ms > started_ms:
        warn = started_ms + int((deadline_ms - started_ms) * threshold)
    return warn, deadline_ms


def _processor_class():
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class DeadlineTimers(StatefulProcessor):
        threshold = 0.75

        def init(self, handle) -> None:
            self.handle = handle
            self.run = handle.getValueState("run", RUN_STATE)

        def _clear(self) -> None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.run.clear()

        def _due_before(self, key, until_ms: int):
            """Timers of the live run due strictly before ``until_ms``: a command
            later in the same micro-batch must not cancel an event that had
            already happened in event time."""
            out = []
            seq, warn, due = self.run.get()
            for kind, at in ((WARNING_EVENT, warn), (MISSED_EVENT, due)):
                if at is not None and at < until_ms:
                    out.append((kind, at))
                    self.handle.deleteTimer(at)
                    warn = None if kind == WARNING_EVENT else warn
                    due = None if kind == MISSED_EVENT else due
            if out:
                self.run.update((seq, warn, due))
            return [(key[0], key[1], int(seq), kind, int(at)) for kind, at in out]

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            cmds = pd.concat(list(rows), ignore_index=True).sort_values("seq")
            fired = []
            for c in cmds.itertuples(index=False):
                ts_ms = int(pd.Timestamp(c.ts).value // 1_000_000)
                live = self.run.exists()
                if live:
                    fired += self._due_before(key, ts_ms)
                if c.kind == CREATE:
                    if live:
                        continue  # rejected: the run is still ACTIVE (missed or not)
                    dl = None if pd.isna(c.deadline) else int(pd.Timestamp(c.deadline).value // 1_000_000)
                    warn, due = fire_times(ts_ms, dl, self.threshold)
                    self.run.update((int(c.seq), warn, due))
                    for t in (warn, due):
                        if t is not None:
                            self.handle.registerTimer(t)
                elif c.kind in (COMPLETE, DELETE) and live:
                    self._clear()
            if not fired:
                return iter([])
            return iter([pd.DataFrame(fired, columns=[f.name for f in EVENTS.fields])])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if not self.run.exists():
                return iter([])
            seq, warn, due = self.run.get()
            at = expiredTimerInfo.getExpiryTimeInMs()
            if warn is not None and at == warn:
                event, warn = WARNING_EVENT, None
            elif due is not None and at == due:
                event, due = MISSED_EVENT, None
            else:
                return iter([])
            # The run stays ACTIVE after its miss; only complete/delete end it.
            self.run.update((seq, warn, due))
            return iter([pd.DataFrame({"name": [key[0]], "process_id": [key[1]], "run_seq": [int(seq)],
                                       "event": [event], "fire_at_ms": [int(at)]})])

        def close(self) -> None:
            pass

    return DeadlineTimers


def stream_deadlines(cmds: DataFrame, threshold: float = 0.75, watermark: str = "10 minutes") -> DataFrame:
    """Streaming (or batch) commands → deadline events. ``cmds`` needs seq, ts,
    name, process_id, kind, deadline."""
    proc = _processor_class()
    proc.threshold = threshold
    return (cmds.withWatermark("ts", watermark)
            .groupBy("name", "process_id")
            .transformWithStateInPandas(proc(), EVENTS, "Append", "EventTime"))


def run_fires(cmds: DataFrame, threshold: float = 0.75, chunk: int = 1 << 20) -> DataFrame:
    """Every accepted create's warning and miss, with its run, unless the
    command that ends it (the next accepted complete or delete at the same
    stored level) comes at or before the fire time."""
    runs = (run_history(decide(cmds, chunk), chunk).filter(F.col("deadline").isNotNull())
            .withColumn("_ms", F.unix_millis("started_at")).withColumn("_end_ms", F.unix_millis("ended_at")))
    st, dl = F.col("_ms"), F.unix_millis("deadline")
    warn = F.when(F.lit(0 < threshold < 1) & (dl > st),
                  st + F.floor((dl - st).cast("double") * F.lit(float(threshold))).cast("long"))
    fires = runs.select("name", "process_id", "id", "started_at", "deadline", "tags", "context", "_end_ms",
                        F.explode(F.array(
                            F.struct(F.lit(WARNING_EVENT).alias("event"), warn.alias("fire_ms")),
                            F.struct(F.lit(MISSED_EVENT).alias("event"), dl.alias("fire_ms")))).alias("e"))
    kept = fires.filter(F.col("e.fire_ms").isNotNull()
                        & (F.col("_end_ms").isNull() | (F.col("_end_ms") > F.col("e.fire_ms"))))
    return kept.select("name", "process_id", "id", "started_at", "deadline", "tags", "context", "e.event", "e.fire_ms")


def deadline_events_batch(cmds: DataFrame, threshold: float = 0.75, chunk: int = 1 << 20) -> DataFrame:
    """Batch twin of :func:`stream_deadlines`."""
    return run_fires(cmds, threshold, chunk).select("name", "process_id", F.col("id").alias("run_seq"), "event",
                                                    F.col("fire_ms").alias("fire_at_ms"))
