"""Things that happen because nothing happened: silent sources and files that did not come.

Both keep one small state per key and a processing-time timer, which fires without new input under
a ``processingTime`` trigger. They need the RocksDB state store. What is expected goes in as initial
state: registered sources, so that one that is never heard is raised too, and the calendar of feeds. A
feed's state is gone ``KEEP_DAYS`` after its window has closed. Events become alerts in a store through
``alert_sink``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslake import session, vocab
from opslake.functions.fingerprint import dedup_key
from opslake.operators import alerts, signals
from opslake.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(value) -> int:
    return int(pd.Timestamp(value).value // 1_000_000)


class _Heartbeats(StatefulProcessor):
    """Raise when a source has been silent too long, resolve when it is heard again."""

    def __init__(self, stale_after_ms: int):
        self.stale_after_ms = stale_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms bigint, stale boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(_millis(batch["at"].max()) for batch in rows)
        known = self.seen.get() if self.seen.exists() else None
        newest = max(newest, known[0]) if known else newest
        now = timerValues.getCurrentProcessingTimeInMs()
        due = newest + self.stale_after_ms
        stale = due <= now
        if not stale:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.seen.update((newest, stale))
        was = bool(known and known[1])
        if stale != was:
            yield _event(key, "raise" if stale else "resolve", newest)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A registered source counts as heard when it was registered."""
        newest = _millis(initialState["at"].max())
        self.seen.update((newest, False))
        self.handle.registerTimer(max(newest + self.stale_after_ms, timerValues.getCurrentProcessingTimeInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, stale = self.seen.get()
        if not stale and newest + self.stale_after_ms <= timerValues.getCurrentProcessingTimeInMs():
            self.seen.update((newest, True))
            yield _event(key, "raise", newest)

    def close(self) -> None:
        pass


def _event(key, kind: str, last_ms: int) -> pd.DataFrame:
    at = datetime.fromtimestamp(last_ms / 1000, UTC).replace(tzinfo=None)
    return pd.DataFrame({"source_id": [key[0]], "kind": [kind], "last_heartbeat": [at]})


def stale_events(heartbeats: DataFrame, stale_after_seconds: float, registered: DataFrame | None = None) -> DataFrame:
    """raise/resolve events per source from a stream of heartbeats (source_id bigint, at).

    ``registered``: the sources to watch (source_id, at), heard or not; a table.
    """
    known = None if registered is None else registered.select(F.col("source_id").cast("bigint").alias("source_id"), "at").groupBy("source_id")
    return heartbeats.groupBy("source_id").transformWithStateInPandas(
        _Heartbeats(int(stale_after_seconds * 1000)),
        "source_id bigint, kind string, last_heartbeat timestamp_ntz", "append", "ProcessingTime", known,
    )


KEEP_DAYS = 2


class _Windows(StatefulProcessor):
    """Say once per feed and day whether its file arrived in time, late, or is missing.

    Missing is said when the window closes; a file that comes after that is said to be late.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "closes_ms bigint, arrived_ms bigint, said string")

    def _say(self, key, state: str) -> pd.DataFrame:
        return pd.DataFrame({"feed_name": [key[0]], "day": [key[1]], "state": [state]})

    def _wait(self, closes: int | None, timerValues) -> None:
        """For the next thing that can happen: the window closes, or the state is done with."""
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = closes if closes is not None and closes > now else (now if closes is None else closes) + self.keep_ms
        self.handle.registerTimer(max(due, now + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        closes = _millis(initialState["closes_at"].max())
        self.slot.update((closes, None, ""))
        self.handle.registerTimer(max(closes, timerValues.getCurrentProcessingTimeInMs() + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closes, arrived, said = self.slot.get() if self.slot.exists() else (None, None, "")
        for batch in rows:
            plan, came = batch["closes_at"].dropna(), batch["arrived_at"].dropna()
            if len(plan):
                closes = _millis(plan.max())
            if len(came):
                first = _millis(came.min())
                arrived = first if arrived is None else min(arrived, first)
        state = ""
        if closes is not None and arrived is not None:
            state = "arrived" if arrived <= closes else "late"
        elif closes is not None and closes <= timerValues.getCurrentProcessingTimeInMs():
            state = "missing"
        news = state if state and (said == "" or (said == "missing" and state != "missing")) else ""
        self.slot.update((closes, arrived, news or said))
        self._wait(closes, timerValues)
        if news:
            yield self._say(key, news)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closes, arrived, said = self.slot.get() if self.slot.exists() else (None, None, "")
        if closes is not None and arrived is None and said == "":
            said = "missing"
            yield self._say(key, said)
        if closes is None or closes + self.keep_ms <= timerValues.getCurrentProcessingTimeInMs():
            self.slot.clear()
        else:
            self.slot.update((closes, arrived, said))
            self._wait(closes, timerValues)

    def close(self) -> None:
        pass


def window_states(expected_and_arrivals: DataFrame, calendar: DataFrame | None = None, keep_seconds: float = KEEP_DAYS * 86_400) -> DataFrame:
    """arrived/late/missing per feed and day.

    Input stream: feed_name, day (text), closes_at (set on plan rows), arrived_at (set on arrivals).
    ``calendar``: a table of what is expected when the stream begins (feed_name, day, closes_at). A feed's
    day is forgotten ``keep_seconds`` after its window has closed; a file that comes still later says nothing.
    """
    shape = ["feed_name", F.col("day").cast("string").alias("day"), "closes_at"]
    rows = expected_and_arrivals.select(*shape, "arrived_at")
    known = None if calendar is None else calendar.select(*shape).groupBy("feed_name", "day")
    return rows.groupBy("feed_name", "day").transformWithStateInPandas(
        _Windows(int(keep_seconds * 1000)), "feed_name string, day string, state string", "append", "ProcessingTime", known
    )


def alert_sink(store: Store, writer: str, events: Callable[[DataFrame, Column], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that makes alerts in a store of what the timers say.

    ``events(rows, seq)`` are the events that ``alerts.merge`` takes. A replayed micro-batch replaces what it
    raised before.
    """

    def sink(rows: DataFrame, batch_id: int) -> None:
        said = session.cut(events(rows, F.lit(batch_id).cast("bigint")))
        if not said.isEmpty():
            store.transact(writer, batch_id + 1, lambda past: {"alert": alerts.merge(past.touched("alert", said), said)})

    return sink


def stale_alerts(rows: DataFrame, seq: Column) -> DataFrame:
    """Alert events of ``stale_events``."""
    return rows.select(
        dedup_key(F.lit(vocab.STALE), F.col("source_id")).alias("dedup_key"), F.lit(vocab.STALE).alias("type"),
        F.when(F.col("kind") == "raise", alerts.RAISE).otherwise(alerts.RESOLVE).alias("kind"),
        F.current_timestamp().alias("at"), seq.alias("seq"),
        F.concat(F.lit("source "), F.col("source_id"), F.lit(" has been silent since "), F.col("last_heartbeat")).alias("message"),
    )


def missing_alerts(rows: DataFrame, seq: Column) -> DataFrame:
    """Alert events of ``window_states``: a file is missing, or came late after all."""
    late = rows.filter(F.col("state").isin("missing", "late"))
    return signals.feed_events(late, vocab.FEED_LATE, F.current_timestamp(), seq)
