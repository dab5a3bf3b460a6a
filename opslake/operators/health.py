"""Watching the readers: empty or shrunken catalogues, purged history, silent sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions import fingerprint as fp
from opslake.functions import time
from opslake.operators import alerts, scan


def zero_rows(syncs: DataFrame) -> DataFrame:
    """Completed syncs that found no job at all."""
    return syncs.filter((F.col("status") == vocab.COMPLETED) & (F.col("job_count") == 0))


def sharp_drop(syncs: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Completed syncs whose job count fell below half of the trailing baseline.

    Baseline: the five completed, non-empty syncs of the source before this one; at least three.
    ``syncs``: source_id, sync_id, started_at, status, job_count.
    """
    chunk = scan.time_chunk("started_at") if chunk is None else chunk
    filled = syncs.filter((F.col("status") == vocab.COMPLETED) & (F.col("job_count") > 0))
    compared = scan.trailing(
        filled, ["source_id"], ["started_at", "sync_id"], chunk, vocab.BASELINE_SYNCS,
        {
            "samples": lambda frame: F.count("job_count").over(frame),
            "baseline": lambda frame: F.avg("job_count").over(frame),
        },
    )
    return compared.filter(
        (F.col("samples") >= vocab.BASELINE_MIN_SAMPLES)
        & (F.col("job_count") < F.col("baseline") * vocab.SHARP_DROP_FRACTION)
    )


def purge_gap(history: DataFrame, watermarks: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources whose oldest surviving history row lies past the watermark: rows were lost unread.

    ``watermarks``: key, since. A source that was never read (since 0) cannot have a gap.
    """
    oldest = history.groupBy(key).agg(F.min("instance_id").alias("oldest"))
    return (
        oldest.join(watermarks.filter(F.col("since") != 0), key)
        .filter(F.col("oldest") > F.col("since") + 1)
        .withColumn("missed", F.col("oldest") - F.col("since") - 1)
    )


def last_heartbeats(heartbeats: DataFrame, key: str = "source_id") -> DataFrame:
    return heartbeats.groupBy(key).agg(F.max("at").alias("last_heartbeat"))


def stale_sources(sources: DataFrame, now: Column, stale_after_seconds: int) -> DataFrame:
    """Every source with ``stale``: no heartbeat ever, or none since the cutoff.

    ``sources``: source_id, name, last_heartbeat.
    """
    cutoff = time.plus_seconds(now, F.lit(-stale_after_seconds))
    quiet = F.col("last_heartbeat").isNull() | (F.col("last_heartbeat") < cutoff)
    return sources.withColumn("stale", quiet)


def stale_after(poll_interval_seconds: int, configured_seconds: int = 0) -> int:
    """Configured limit, or two poll intervals."""
    return configured_seconds if configured_seconds > 0 else 2 * max(1, poll_interval_seconds)


def stale_events(swept: DataFrame, now: Column, seq: Column) -> DataFrame:
    """Raise for stale sources, resolve for the others."""
    since = F.coalesce(F.date_format("last_heartbeat", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
    return swept.select(
        fp.dedup_key(F.lit(vocab.STALE), F.col("source_id")).alias("dedup_key"),
        F.lit(vocab.STALE).alias("type"),
        F.when(F.col("stale"), alerts.RAISE).otherwise(alerts.RESOLVE).alias("kind"),
        now.alias("at"),
        seq.alias("seq"),
        F.concat("name", F.lit(" has not heartbeated since "), since).alias("message"),
    )


def source_events(found: DataFrame, kind: str, message: Column, at: Column, seq: Column) -> DataFrame:
    """Alert raises of one type, keyed by type and source."""
    return found.select(
        fp.dedup_key(F.lit(kind), F.col("source_id")).alias("dedup_key"),
        F.lit(kind).alias("type"), F.lit(alerts.RAISE).alias("kind"), at.alias("at"), seq.alias("seq"),
        message.alias("message"),
    )


def as_of(view: DataFrame, sources: DataFrame) -> DataFrame:
    """Add to a view by source how old its data is: the source's last heartbeat."""
    return view.join(sources.select("source_id", F.col("last_heartbeat").alias("as_of")), "source_id", "left")


def sync_log(events: DataFrame) -> DataFrame:
    """Syncs from their open and close events; a sync without a close event is still Running.

    ``events``: sync_id, source_id, kind (open/close), at, status, job_count, unowned_count, error_text.
    """
    opened, closed = F.col("kind") == "open", F.when(F.col("kind") == "close", F.col("at"))
    last = F.struct("at", "status", "job_count", "unowned_count", "error_text")
    return (
        events.groupBy("sync_id", "source_id")
        .agg(F.min(F.when(opened, F.col("at"))).alias("started_at"), F.min_by(last, closed).alias("c"))
        .select(
            "sync_id", "source_id", "started_at", F.col("c.at").alias("completed_at"),
            F.coalesce("c.status", F.lit(vocab.RUNNING)).alias("status"),
            F.coalesce("c.job_count", F.lit(0)).cast("bigint").alias("job_count"),
            F.coalesce("c.unowned_count", F.lit(0)).cast("bigint").alias("unowned_count"),
            F.col("c.error_text").alias("error_text"),
        )
    )
