"""Feed contracts: rules, versions, sync results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions import contract as fn
from opslake.operators import scan

SPEC = [
    "feed_id", "owner", "landing_prefix", "file_mask", "window_start", "window_end", "schema_name", "columns",
]


def spec_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in SPEC}


def check_rules(specs: DataFrame) -> DataFrame:
    """Add ``error``: why the file could not be read, else the first rule its contract breaks."""
    read_error = F.col("read_error") if "read_error" in specs.columns else F.lit(None).cast("string")
    return specs.withColumn("error", F.coalesce(read_error, fn.rule_error(spec_columns())))


def with_hash(specs: DataFrame) -> DataFrame:
    return specs.withColumn("spec_json", fn.canonical_json(spec_columns())).withColumn(
        "spec_hash", fn.spec_hash(F.col("spec_json"))
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """Latest version and its hash per feed."""
    return versions.groupBy("feed_id").agg(
        F.max("version").alias("latest_version"), F.max_by("spec_hash", "version").alias("latest_hash")
    )


def next_versions(specs: DataFrame, versions: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Number each spec: a new version where its hash differs from the one just before it.

    Specs of a feed are taken in ``order``; before the first of them stands the stored latest
    version. So A, B, A makes three versions. Adds ``created`` and ``version``.
    """
    stored = latest_versions(versions).select(
        "feed_id", F.col("latest_hash").alias("start_value"), F.col("latest_version").alias("start_number")
    )
    numbered = scan.numbered_changes(specs, ["feed_id"], order, chunk, F.col("spec_hash"), stored)
    return numbered.withColumnsRenamed({"changed": "created", "number": "version"}).drop("previous")


def sync_results(checked: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row per contract file: feed, created, version, error. A bad file is named by its stem."""
    good = numbered.select("path", "feed_id", "created", "version", F.lit(None).cast("string").alias("error"))
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]*\z", 1)
    bad = checked.filter(F.col("error").isNotNull()).select(
        "path", stem.alias("feed_id"), F.lit(False).alias("created"), F.lit(0).cast("bigint").alias("version"), "error"
    )
    return good.unionByName(bad)


def sync_summary(results: DataFrame) -> DataFrame:
    """How many contracts were synced, failed, created, unchanged."""
    failed = F.col("error").isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("synced"),
        F.count_if(failed).alias("failed"),
        F.count_if(~failed & F.col("created")).alias("created"),
        F.count_if(~failed & ~F.col("created")).alias("unchanged"),
    )


def merge_feeds(feeds: DataFrame, specs: DataFrame, order: list[str]) -> DataFrame:
    """Feeds by name with owner and prefix from the last good spec; other feeds stay."""
    last = specs.groupBy(F.col("feed_id").alias("s_feed")).agg(
        F.max_by(F.struct("owner", "landing_prefix"), F.struct(*order)).alias("s")
    )
    return feeds.join(last, F.col("feed_name") == F.col("s_feed"), "full").select(
        F.coalesce("feed_name", "s_feed").alias("feed_name"),
        F.coalesce("s.owner", "team_id").alias("team_id"),
        F.coalesce("s.landing_prefix", "landing_prefix").alias("landing_prefix"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )


def with_schema(feeds: DataFrame, schemas: DataFrame) -> DataFrame:
    """Attach columns by schema id; a feed whose schema is unknown gets an ``error``."""
    known = schemas.select("schema_id", "columns")
    missing = F.concat(F.lit("unknown schema: "), F.coalesce("schema_id", F.lit("(none)")))
    return feeds.join(known, "schema_id", "left").withColumn("error", F.when(F.col("columns").isNull(), missing))


def by_carrier(feeds: DataFrame) -> DataFrame:
    """Active feeds per carrier."""
    return feeds.filter("is_active").groupBy("carrier_name").agg(F.count(F.lit(1)).alias("feeds"))


def version_in_force(
    arrivals: DataFrame, versions: DataFrame, chunk_seconds: int = scan.CHUNK_SECONDS
) -> DataFrame:
    """Attach to each arrival the contract version in force when it arrived, null if there was none.

    ``arrivals``: feed_id, arrival_id, arrived_at; ``versions``: feed_id, version, effective_from.
    Both sides go through one running "last version" by feed, so neither arrivals nor versions of a
    busy feed meet in one task or pair up.
    """
    known = versions.select(
        "feed_id", F.col("effective_from").alias("at"), F.lit(0).alias("kind"), F.col("version").alias("tie"),
        F.lit("").alias("id"), F.col("version").alias("v"), F.lit(None).alias("arrival"),
    )
    came = arrivals.select(
        "feed_id", F.col("arrived_at").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("tie"),
        F.col("arrival_id").cast("string").alias("id"), F.lit(None).cast("bigint").alias("v"), F.struct(*arrivals.columns).alias("arrival"),
    )
    seen = scan.running(
        known.unionByName(came), ["feed_id"], ["at", "kind", "tie", "id"], scan.time_chunk("at", chunk_seconds),
        {"version": scan.last(F.col("v"))},
    )
    return seen.filter(F.col("kind") == 1).select("arrival.*", "version")
