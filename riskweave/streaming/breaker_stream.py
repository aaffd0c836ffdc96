"""Streaming circuit breaker and danger watch, in event time.

The breaker keeps, per log, the dangerous events and resets that the watermark has not passed, and behind it the epoch,
when it opened, and the newest dangerous times. Nothing is decided before the watermark has passed it: a timer per
log fires then, and what lies behind the watermark is taken in the order of time and id. So files may come in any
order and late, within the watermark's delay, and alerts are those of the batch query. Other events never reach the
state; they only move the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..tables import contexts as values

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events that go to the state in one call; each call waits for an answer of the JVM.
SLICE = 5000


class BreakerProcessor(StatefulProcessor):
    """Input rows: ``micros, event, dangerous, chat, reset``. Output rows: ``log, epoch, event, micros, opened``."""

    def __init__(self, event_type: str, minutes: int, threshold: int):
        self.event_type, self.reach, self.threshold = event_type, minutes * 60_000_000, threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"micros long, event {self.event_type}, dangerous boolean, chat boolean, reset boolean")
        self.latch = handle.getValueState("latch", "epoch long, opened long, recent array<long>")
        self.timer = handle.getValueState("timer", "due long")

    def _wake(self, micros: int, least: int) -> None:
        """One timer per log, just behind the first event that waits."""
        due = max(micros // 1000 + 1, least)
        if self.timer.exists():
            now = self.timer.get()[0]
            if now <= due:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def _wait(self, entries: Iterator[tuple]) -> int | None:
        """Adds events to those that wait; the time of the first one."""
        first = None
        while part := list(islice(entries, SLICE)):
            self.waiting.appendList(part)
            least = min(x[0] for x in part)
            first = least if first is None else min(first, least)
        return first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = self._wait((row.micros, row.event, row.dangerous, row.chat, row.reset) for row in rows)
        if first is not None:
            self._wake(first, 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for entry in self.waiting.get():
            (ready if entry[0] <= behind else later).append(tuple(entry))
        self.waiting.clear()
        if later:
            self._wake(self._wait(iter(later)), behind // 1000 + 1)
        epoch, opened, recent = self.latch.get() if self.latch.exists() else (0, None, [])
        recent, out = list(recent), []
        # Events of one instant and epoch see each other, as in a range window.
        same: list[tuple] = []

        def settle() -> None:
            nonlocal opened
            for micros, event, chat in same:
                if chat and sum(t >= micros - self.reach for t in recent) >= self.threshold:
                    opened = micros if opened is None else opened
                    out.append(Row(log=key[0], epoch=epoch, event=event, micros=micros, opened=opened))
            same.clear()

        for micros, event, dangerous, chat, reset in sorted(ready, key=lambda x: x[:2]):
            if same and same[0][0] != micros:
                settle()
            if reset:
                settle()
                epoch, opened, recent = epoch + 1, None, []
            if dangerous:
                # Whether the threshold is met depends on the newest events only.
                recent = [*recent, micros][-self.threshold:]
                same.append((micros, event, bool(chat)))
        settle()
        self.latch.update((epoch, opened, recent))
        return iter(out)

    def close(self) -> None:
        pass


def _behind_watermark(ts: str, condition: Column) -> Column:
    """The condition in a form that names the time, so that the optimizer leaves the filter behind the watermark: rows that
    are filtered out still move it."""
    return F.when(F.col(ts).isNotNull(), condition)


def breaker_stream(events: DataFrame, *, log: str, ts: str = "ts", event_id: str = "event_id", watermark: str = "10 minutes",
                   minutes: int = values.BREAKER_MINUTES, threshold: int = values.BREAKER_THRESHOLD) -> DataFrame:
    """Streaming alerts ``(log, epoch, event_id, ts, opened_at)`` from events with
    ``verdict, is_chat, is_reset``. An alert comes when the watermark has passed its event; events that come later
    than ``watermark`` behind the newest one are left out and stay in the batch tables. Uses (and sets, where the
    session has another) the RocksDB state store, which state with timers needs."""
    spark, types = events.sparkSession, dict(events.dtypes)
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    dangerous, reset = F.coalesce(F.col("verdict") == "DANGEROUS", F.lit(False)), F.coalesce(F.col("is_reset"), F.lit(False))
    rows = (events.withWatermark(ts, watermark).filter(_behind_watermark(ts, dangerous | reset))
            .select(F.col(log).alias("log"), ts, F.unix_micros(ts).alias("micros"), F.col(event_id).alias("event"), dangerous.alias("dangerous"),
                    F.coalesce(F.col("is_chat"), F.lit(False)).alias("chat"), reset.alias("reset")))
    alerts = rows.groupBy("log").transformWithState(
        statefulProcessor=BreakerProcessor(types[event_id], minutes, threshold),
        outputStructType=f"log {types[log]}, epoch long, event {types[event_id]}, micros long, opened long",
        outputMode="append", timeMode="eventtime")
    return alerts.select(F.col("log").alias(log), "epoch", F.col("event").alias(event_id), F.timestamp_micros("micros").alias(ts),
                         F.timestamp_micros("opened").alias("opened_at"))


def danger_stream(events: DataFrame, *, ts: str = "ts", window: str = "10 minutes", slide: str = "1 minute",
                  watermark: str = "10 minutes", threshold: int = values.BREAKER_THRESHOLD, by: list[str] = ()) -> DataFrame:
    """Sliding windows with enough dangerous events; late events beyond the
    watermark are left out here and stay in the batch tables."""
    counted = (events.withWatermark(ts, watermark).filter(_behind_watermark(ts, F.col("verdict") == "DANGEROUS"))
               .groupBy(*by, F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("dangerous")))
    return counted.filter(F.col("dangerous") >= threshold).select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dangerous")
