"""Streaming lifecycle fold: per key, state holds the number of
stored rows and whether the newest is ACTIVE; each command is decided as it
arrives. Equals :func:`duewatch.operators.lifecycle.decide` on the same log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T

from duewatch.operators.lifecycle import (CODE_CONFLICT, CODE_CREATED, CODE_DELETED, CODE_NOT_FOUND, CODE_OK,
                                          COMPLETE, CREATE, DELETE)

DECISIONS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("process_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("code", T.IntegerType()),
])
STATE = T.StructType([T.StructField("rows", T.LongType()), T.StructField("active", T.BooleanType())])


def step(rows: int, active: bool, kind: str):
    """One command against (rows, active) → (rows, active, reason, code)."""
    if kind == CREATE:
        if active:
            return rows, active, "already_exists", CODE_CONFLICT
        return rows + 1, True, None, CODE_CREATED
    if kind == COMPLETE:
        if active:
            return rows, False, None, CODE_OK
        return rows, active, ("not_found" if rows == 0 else "already_completed"), \
            (CODE_NOT_FOUND if rows == 0 else CODE_CONFLICT)
    if kind == DELETE:
        if rows == 0:
            return rows, active, "not_found", CODE_NOT_FOUND
        return rows - 1, False, None, CODE_DELETED
    return rows, active, "unknown_command", 400


def _processor_class():
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class LifecycleFold(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("keystate", STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            cmds = pd.concat(list(rows), ignore_index=True).sort_values("seq")
            n, active = self.state.get() if self.state.exists() else (0, False)
            out = []
            for c in cmds.itertuples(index=False):
                n, active, reason, code = step(int(n), bool(active), c.kind)
                out.append((int(c.seq), key[0], key[1], c.kind, reason is None, reason, code))
            self.state.update((int(n), bool(active)))
            return iter([pd.DataFrame(out, columns=[f.name for f in DECISIONS.fields])])

        def close(self) -> None:
            pass

    return LifecycleFold


def stream_lifecycle(cmds: DataFrame) -> DataFrame:
    """Decisions for a (streaming) command log, keyed by (name, process_id).

    Commands of a key must arrive in ``seq`` order across micro-batches (as a
    per-key ordered log, e.g. a Kafka partition keyed by process, delivers)."""
    return (cmds.groupBy("name", "process_id")
            .transformWithStateInPandas(_processor_class()(), DECISIONS, "Append", "None"))
