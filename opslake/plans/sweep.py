"""Stale sweep: one pass over all sources against their last heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.operators import alerts, health
from opslake.store import Store


def sweep(store: Store, batch: int, now: str, stale_after_seconds: int) -> DataFrame:
    """Raise for sources that went quiet, resolve for those that came back; returns the alerts."""
    at = F.lit(now).cast("timestamp")

    def build(past: Store) -> dict[str, DataFrame]:
        beats = past.current("source_state").select("source_id", "last_heartbeat")
        sources = past.current("source").join(beats, "source_id", "left")
        swept = health.stale_sources(sources, at, stale_after_seconds)
        events = health.stale_events(swept, at, F.lit(batch).cast("bigint"))
        return {"alert": alerts.merge(past.touched("alert", events), events)}

    store.transact("sweep", batch, build, reads=("source", "source_state"))
    return store.current("alert")
