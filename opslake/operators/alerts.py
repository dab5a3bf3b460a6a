"""Alert state: raise, resolve, acknowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import vocab

RAISE, RESOLVE = "raise", "resolve"
STATE = [
    "dedup_key", "type", "status", "routed_to", "message", "first_seen", "last_occurrence", "occurrences",
    "acked_by", "acked_at",
]


def fold_events(events: DataFrame) -> DataFrame:
    """Per key, what a batch of raise and resolve events adds up to. Pre-aggregates, also on a stream.

    ``events``: dedup_key, type, kind, at, seq, message.
    """
    raised = F.col("kind") == RAISE
    when_raised = F.when(raised, F.col("seq"))
    return events.groupBy("dedup_key").agg(
        F.max_by("kind", "seq").alias("last_kind"),
        F.count_if(raised).alias("raises"),
        F.max_by("type", when_raised).alias("e_type"),
        F.max_by("message", when_raised).alias("e_message"),
        F.min(F.when(raised, F.col("at"))).alias("first_raise"),
        F.max(F.when(raised, F.col("at"))).alias("last_raise"),
    )


def merge(state: DataFrame, events: DataFrame) -> DataFrame:
    """Next alert state.

    A raise makes the alert fire, whatever it was, and counts; a resolve ends a firing alert and
    nothing else. A key that was never raised gets no row.
    """
    folded = fold_events(events).withColumnRenamed("dedup_key", "e_key")
    joined = state.join(folded, F.col("dedup_key") == F.col("e_key"), "full")
    status = (
        F.when(F.col("last_kind") == RAISE, vocab.FIRING)
        .when(
            (F.col("last_kind") == RESOLVE) & ((F.col("raises") > 0) | (F.col("status") == vocab.FIRING)),
            vocab.RESOLVED,
        )
        .otherwise(F.col("status"))
    )
    return joined.filter(F.col("dedup_key").isNotNull() | (F.col("raises") > 0)).select(
        F.coalesce("dedup_key", "e_key").alias("dedup_key"),
        F.coalesce("type", "e_type").alias("type"),
        status.alias("status"),
        "routed_to",
        F.coalesce("e_message", "message").alias("message"),
        F.coalesce("first_seen", "first_raise").alias("first_seen"),
        F.greatest("last_occurrence", "last_raise").alias("last_occurrence"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("raises", F.lit(0))).cast("bigint").alias("occurrences"),
        "acked_by",
        "acked_at",
    )


def acknowledge(state: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply acknowledgements (dedup_key, acked_by, acked_at): the first one ends the firing."""
    first = acks.groupBy("dedup_key").agg(
        F.min_by(F.struct("acked_by", "acked_at"), F.struct("acked_at", "acked_by")).alias("__ack")
    )
    applies = F.col("__ack").isNotNull() & (F.col("status") == vocab.FIRING)
    return (
        state.join(first, "dedup_key", "left")
        .withColumn("acked_by", F.when(applies, F.col("__ack.acked_by")).otherwise(F.col("acked_by")))
        .withColumn("acked_at", F.when(applies, F.col("__ack.acked_at")).otherwise(F.col("acked_at")))
        .withColumn("status", F.when(applies, vocab.ACKNOWLEDGED).otherwise(F.col("status")))
        .select(*state.columns)
    )


def empty_state_schema() -> str:
    return (
        "dedup_key string, type string, status string, routed_to string, message string, first_seen timestamp, "
        "last_occurrence timestamp, occurrences bigint, acked_by string, acked_at timestamp"
    )
