"""Sustained alerts on a stream: windowed request health, then run lengths.

The windowed aggregate emits each window once, when the watermark passes its
end. A second stateful operator keeps, for each alert, the samples that have
come and follows them in time order behind its own watermark: an episode is a
run of samples without a gap in which the condition holds, and comes out once,
when a later sample ends it or when a timer finds that none followed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from duewatch.operators import metrics as M

EPISODES = T.StructType([T.StructField("alert", T.StringType()), T.StructField("since", T.LongType()),
                         T.StructField("until", T.LongType()), T.StructField("samples", T.LongType())])
_LONG = T.LongType()
RUN = T.StructType([T.StructField(n, _LONG) for n in ("since", "until", "samples", "known_ms")])
KNOWN = T.StructType([T.StructField("known_ms", _LONG)])
SAMPLE = T.StructType([T.StructField("at", _LONG), T.StructField("fired", T.BooleanType())])
Episode = Row(*EPISODES.names)


class SustainedAlerts(StatefulProcessor):
    """Run-length state of one alert.

    A sample stands at ``at`` and is known at ``known_ms`` (event time; for a
    window its end). Samples may come in any order; they are followed, in
    order, up to the watermark."""

    def __init__(self, hold: dict[str, int], max_gap: int):
        self.hold, self.max_gap = hold, max_gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", KNOWN, SAMPLE)
        self.run = handle.getValueState("run", RUN)

    def _ended(self, key) -> Iterator[Row]:
        since, until, samples, _ = self.run.get()
        self.run.clear()
        if until - since >= self.hold[key[0]]:
            yield Episode(key[0], since, until, samples)

    def _follow(self, key, watermark_ms: int) -> Iterator[Row]:
        waiting = sorted(k[0] for k in self.waiting.keys())
        for known in waiting:
            if known > watermark_ms:
                break
            at, fired = self.waiting.getValue((known,))
            self.waiting.removeKey((known,))
            if self.run.exists() and (not fired or at - self.run.get()[1] > self.max_gap):
                yield from self._ended(key)
            if fired:
                since, _, samples, _ = self.run.get() if self.run.exists() else (at, at, 0, 0)
                self.run.update((since, at, samples + 1, known))
        # The next timer: the next sample to follow, or the end of the gap behind the last one.
        ahead = [k for k in waiting if k > watermark_ms]
        gap_ends = self.run.get()[3] + self.max_gap * 1000 if self.run.exists() else None
        if gap_ends is not None and gap_ends < watermark_ms and (not ahead or ahead[0] > gap_ends):
            yield from self._ended(key)
            gap_ends = None
        wake = [k for k in (ahead[0] if ahead else None, gap_ends + 1 if gap_ends is not None else None) if k is not None]
        if wake:
            self.handle.registerTimer(min(wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.known_ms,), (r.at, bool(r.fired)))
        yield from self._follow(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._follow(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_sustained(samples: DataFrame, hold: dict[str, int] | None = None, max_gap_seconds: int = 60, known: str = "ts") -> DataFrame:
    """(alert, ts, fired) samples → episodes (alert, since, until, samples), each once; equals
    :func:`duewatch.operators.windows.sustained`.

    ``known`` is the column that has the watermark: the sample's own instant, or
    when it came to be known. State per alert: the run it is in and the samples
    ahead of the watermark."""
    s = samples.select("alert", known, F.unix_seconds("ts").alias("at"), F.unix_millis(known).alias("known_ms"), F.coalesce("fired", F.lit(False)).alias("fired"))
    return s.groupBy("alert").transformWithState(SustainedAlerts(dict(hold or M.ALERT_HOLD), max_gap_seconds), EPISODES, "Append", "EventTime")


def stream_alert_episodes(requests: DataFrame, watermark: str = "10 minutes", **kw) -> DataFrame:
    """Requests → sustained alert episodes: two stateful operators in one query, under the requests' watermark."""
    alerts = M.request_alerts_sketched(requests.withWatermark("ts", watermark), closed_at=True, **kw)
    return stream_sustained(M.alert_samples(alerts), known="closed_at")
