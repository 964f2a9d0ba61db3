"""From commands to runs, decisions and deadline events by one stateful operator.

Each key (name, process_id) keeps its number of stored rows, the live run with
its tags, context and two timers, and a map of the stored rows' ids by level. A
command is decided, the run it changes is emitted as it stands afterwards, and
a warning or miss that came before it in event time is emitted first; timers
emit the others when the watermark passes them. So runs, counters and outbox
come from one shuffle and one state store.

``forget_after`` ends a key's state that long (event time) after it last had a
live run; later completes and deletes of it are then ``not_found``. Commands
that come after a later one of their key was decided are emitted as
``out_of_order`` and change nothing. Those behind the watermark are dropped by
Spark before the operator; :class:`LateRows` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from duewatch.operators.lifecycle import COMPLETE, CREATE, DELETE, operation_results
from duewatch.operators.metrics import duration_timer, ended_counts, event_counters, operation_counters
from duewatch.operators.scans import MISSED_EVENT, WARNING_EVENT, event_payload
from duewatch.sources.epochs import read_epochs, write_epoch
from duewatch.sources.runstore import CHANGES, upsert
from duewatch.streaming.deadlines import fire_times, run_fires
from duewatch.streaming.lifecycle import step

DECISION, RUN, EVENT = "decision", "run", "event"
CODE_OUT_OF_ORDER = 409



def _fields(**kinds) -> T.StructType:
    """A struct of the named fields; built without a session, as modules are imported before there is one."""
    return T.StructType([T.StructField(name, kind()) for name, kind in kinds.items()])


_TEXT, _LONG, _FLAG = T.StringType, T.LongType, T.BooleanType
OUTPUT = _fields(output=_TEXT, name=_TEXT, process_id=_TEXT, seq=_LONG, kind=_TEXT, accepted=_FLAG, reason=_TEXT, code=T.IntegerType,
                 id=_LONG, gone=_FLAG, status=_TEXT, started_us=_LONG, completed_us=_LONG, deadline_us=_LONG, tags=_TEXT, context=_TEXT,
                 event=_TEXT, fire_ms=_LONG)
TOP = _fields(rows=_LONG, active=_FLAG, last_seq=_LONG, id=_LONG, started_us=_LONG, deadline_us=_LONG, tags=_TEXT, context=_TEXT,
              warn_ms=_LONG, due_ms=_LONG, forget_ms=_LONG)
Out = Row(*OUTPUT.names)
_FRESH = (0, False, -1, None, None, None, None, None, None, None, None)


class RunLifecycle(StatefulProcessor):
    """State machine of one key; see the module's docstring."""

    def __init__(self, threshold: float, forget_ms: int | None):
        self.threshold, self.forget_after = threshold, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", TOP)
        self.ids = handle.getMapState("ids", "level long", "id long")

    def _load(self, key) -> None:
        self.key = key
        (self.rows, self.active, self.last, self.id, self.started, self.deadline, self.tags, self.context, self.warn, self.due,
         self.forget) = self.top.get() if self.top.exists() else _FRESH

    def _store(self) -> None:
        self.top.update((self.rows, self.active, self.last, self.id, self.started, self.deadline, self.tags, self.context, self.warn,
                         self.due, self.forget))

    def _out(self, output: str, **fields) -> Row:
        row = {"output": output, "name": self.key[0], "process_id": self.key[1], **fields}
        return Out(*[row.get(n) for n in OUTPUT.names])

    def _stop(self, at: int | None) -> None:
        # A warning and a miss (or the end of the state) may share an instant, and with it a timer.
        if at is not None and at not in (self.warn, self.due, self.forget):
            self.handle.deleteTimer(at)

    def _set(self, name: str, at: int | None) -> None:
        old = getattr(self, name)
        setattr(self, name, at)
        if at is not None and at != old:
            self.handle.registerTimer(at)
        if old != at:
            self._stop(old)

    def _fired(self, event: str, at: int) -> Row:
        return self._out(EVENT, id=self.id, event=event, fire_ms=at, started_us=self.started, deadline_us=self.deadline,
                         tags=self.tags, context=self.context)

    def _fire(self, until_ms: int, through: bool) -> Iterator[Row]:
        """Events of the live run due before ``until_ms`` (``through``: or then)."""
        for name, event in (("warn", WARNING_EVENT), ("due", MISSED_EVENT)):
            at = getattr(self, name)
            if self.active and at is not None and (at < until_ms or through and at == until_ms):
                yield self._fired(event, at)
                self._set(name, None)

    def _decide(self, c) -> Iterator[Row]:
        if c.seq <= self.last:
            yield self._out(DECISION, seq=c.seq, kind=c.kind, accepted=False, reason="out_of_order", code=CODE_OUT_OF_ORDER)
            return
        yield from self._fire(c.ts_us // 1000, through=False)
        before = self.rows
        self.rows, now_active, reason, code = step(self.rows, self.active, c.kind)
        self.last = c.seq
        yield self._out(DECISION, seq=c.seq, kind=c.kind, accepted=reason is None, reason=reason, code=code)
        if reason is not None:
            return
        if c.kind == CREATE:
            self.active, self.id, self.started, self.deadline = True, c.seq, c.ts_us, c.deadline_us
            self.tags, self.context = c.tags, c.context
            self.ids.updateValue((self.rows,), (c.seq,))
            warn, due = fire_times(c.ts_us // 1000, None if c.deadline_us is None else c.deadline_us // 1000, self.threshold)
            self._set("warn", warn)
            self._set("due", due)
            yield self._run(c, "ACTIVE", None)
        elif c.kind == COMPLETE:
            yield self._run(c, c.status, c.ts_us)
        elif c.kind == DELETE:
            yield self._out(RUN, seq=c.seq, id=self.ids.getValue((before,))[0], gone=True, kind=c.kind)
            self.ids.removeKey((before,))
        self.active = now_active
        if not now_active:
            self._set("warn", None)
            self._set("due", None)
            self.id = self.started = self.deadline = self.tags = self.context = None

    def _run(self, c, status: str, completed: int | None) -> Row:
        return self._out(RUN, seq=c.seq, kind=c.kind, id=self.id, gone=False, status=status, started_us=self.started, completed_us=completed,
                         deadline_us=self.deadline, tags=self.tags, context=self.context)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load(key)
        latest = None
        for c in sorted(rows, key=lambda r: r.seq):
            yield from self._decide(c)
            latest = max(latest or 0, c.ts_us // 1000)
        if self.forget_after is not None:
            self._set("forget", None if self.active else max(latest + self.forget_after, (self.forget or 0)))
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.top.exists():
            return
        self._load(key)
        at = expiredTimerInfo.getExpiryTimeInMs()
        # This timer is spent; only others are to be deleted.
        for name, event in (("warn", WARNING_EVENT), ("due", MISSED_EVENT)):
            if self.active and getattr(self, name) == at:
                yield self._fired(event, at)
                setattr(self, name, None)
        if self.forget == at and not self.active:
            self.top.clear()
            self.ids.clear()
            return
        self._store()

    def close(self) -> None:
        pass


def stream_runs(cmds: DataFrame, threshold: float = 0.75, watermark: str = "10 minutes", forget_after: str | None = None) -> DataFrame:
    """Commands (seq, ts, name, process_id, kind, status, deadline, tags, context) → rows of :data:`OUTPUT`.

    Commands of a key must come in ``seq`` order across micro-batches, as a log
    keyed by process delivers them. A key's commands of one micro-batch meet in
    one task, so bound the micro-batch at the source."""
    forget = None
    if forget_after is not None:
        spark = cmds.sparkSession
        forget = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {forget_after})")).first()[0])
    rows = cmds.withWatermark("ts", watermark)
    have = set(cmds.columns)
    text = {c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("status", "tags", "context")}
    rows = rows.select("ts", "name", "process_id", "seq", "kind", F.unix_micros("ts").alias("ts_us"),
                       F.unix_micros("deadline").alias("deadline_us"), *text.values())
    return rows.groupBy("name", "process_id").transformWithState(RunLifecycle(threshold, forget), OUTPUT, "Append", "EventTime")


# Views of the operator's rows -------------------------------------------------------------------------------------

def decisions(out: DataFrame) -> DataFrame:
    return out.where(F.col("output") == DECISION).select("seq", "name", "process_id", "kind", "accepted", "reason", "code")


def changes(out: DataFrame) -> DataFrame:
    """Changed runs in the layout of :data:`duewatch.sources.runstore.CHANGES`."""
    ts = F.timestamp_micros
    none = F.lit(None)
    cols = {"started_at": ts("started_us"), "completed_at": ts("completed_us"), "deadline": ts("deadline_us"), "created_at": ts("started_us"),
            "updated_at": ts(F.coalesce("completed_us", "started_us")), "namespace_id": none, "deadline_notified_at": none,
            "deadline_warned_at": none}
    return out.where(F.col("output") == RUN).select(
        *[cols.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHANGES.fields])


def outbox_events(out: DataFrame, public_url: str | None = None) -> DataFrame:
    """Outbox rows of the operator's events, see :func:`outbox_of`."""
    ts = F.timestamp_micros
    return outbox_of(out.where(F.col("output") == EVENT).select(
        "id", "event", "name", "process_id", ts("started_us").alias("started_at"), ts("deadline_us").alias("deadline"), "tags", "context",
        "fire_ms"), public_url)


def outbox_of(events: DataFrame, public_url: str | None = None) -> DataFrame:
    """Outbox rows with the full webhook payload, as :func:`duewatch.sources.outbox.outbox_rows` has them; an event's own instant is its time."""
    e = events.withColumn("fire_at", F.timestamp_millis("fire_ms"))
    payload = (F.when(F.col("event") == WARNING_EVENT, event_payload(e, WARNING_EVENT, F.col("fire_at"), public_url, now="fire_at"))
               .otherwise(event_payload(e, MISSED_EVENT, F.col("fire_at"), public_url)))
    return e.select("id", "event", "name", "process_id", payload.alias("payload"), F.unix_seconds("fire_at").alias("emitted_at"),
                    F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("event"))).alias("event_key"))


def outbox_batch(cmds: DataFrame, threshold: float = 0.75, public_url: str | None = None) -> DataFrame:
    """Batch twin of the streamed outbox."""
    return outbox_of(run_fires(cmds, threshold), public_url)


# Counters --------------------------------------------------------------------------------------------------------

def change_counters(runs: DataFrame) -> DataFrame:
    """Lifecycle counters of changed runs: a create counts once, an end once under its outcome.

    Works on a stream of changes (complete or update mode) and on one
    micro-batch, whose counts add up to the same."""
    done = F.col("completed_at").isNotNull()
    started = runs.where(~F.col("gone"))
    return started.groupBy("name").agg(F.count_if(~done).alias("created"), *ended_counts())


def change_timers(runs: DataFrame) -> DataFrame:
    """Duration timers of ended runs, by name and status."""
    return duration_timer(runs.where(~F.col("gone") & F.col("completed_at").isNotNull()))


COUNTERS = "name string, created long, completed long, failed long, on_time long, late long"
TIMERS = "name string, status string, count long, sum_ms long, max_ms long"
EVENT_COUNTS = "name string, missed_events long, warning_events long"
OPERATIONS = "operation string, table string, success boolean, count long"


def _add_up(spark, path: str, schema: str, keys: list[str], largest: tuple[str, ...] = ()) -> DataFrame:
    rows = read_epochs(spark, path, schema)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[(F.max(c) if c in largest else F.sum(c)).alias(c) for c in values])


def read_counters(spark, root: str) -> DataFrame:
    """Lifecycle counters (name, created, completed, failed, on_time, late) since the stream began; deletes take nothing back."""
    return _add_up(spark, f"{root}/counters", COUNTERS, ["name"])


def read_timers(spark, root: str) -> DataFrame:
    return _add_up(spark, f"{root}/timers", TIMERS, ["name", "status"], ("max_ms",))


def read_event_counters(spark, root: str) -> DataFrame:
    return _add_up(spark, f"{root}/event_counters", EVENT_COUNTS, ["name"])


def read_operations(spark, root: str) -> DataFrame:
    return _add_up(spark, f"{root}/operations", OPERATIONS, ["operation", "table", "success"])


# Sink ------------------------------------------------------------------------------------------------------------

OUTBOX = "id long, event string, name string, process_id string, payload string, emitted_at long, event_key string"
DECISIONS = "seq long, name string, process_id string, kind string, accepted boolean, reason string, code int"


def table_writer(root: str, public_url: str | None = None):
    """A ``foreachBatch`` function: a micro-batch's decisions, changed runs, outbox rows and counts, each in this
    epoch's folder under ``root``.

    No table is read: the operator's state emits each run's events once, and a
    replayed epoch replaces its own folders. Counts are the micro-batch's own;
    readers add them up."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            made, runs, events = decisions(batch), changes(batch), outbox_events(batch, public_url)
            write_epoch(made, f"{root}/decisions", epoch)
            write_epoch(events, f"{root}/outbox", epoch)
            write_epoch(change_counters(runs), f"{root}/counters", epoch)
            write_epoch(change_timers(runs), f"{root}/timers", epoch)
            write_epoch(event_counters(events), f"{root}/event_counters", epoch)
            write_epoch(operation_counters(operation_results(made.where("coalesce(reason, '') <> 'out_of_order'"))), f"{root}/operations", epoch)
            upsert(runs, root, epoch)
        finally:
            batch.unpersist()
    return write


def read_decisions(spark, root: str) -> DataFrame:
    return read_epochs(spark, f"{root}/decisions", DECISIONS)


def read_outbox(spark, root: str, after: int = -1) -> DataFrame:
    """Outbox rows of epochs above ``after``, so that a deliverer reads only what is new."""
    return read_epochs(spark, f"{root}/outbox", OUTBOX, after)


class LateRows(StreamingQueryListener):
    """Rows that Spark dropped behind the watermark, by query name or id."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        n = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if n > 0:
            name = p.name or str(p.id)
            self.dropped[name] = self.dropped.get(name, 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
