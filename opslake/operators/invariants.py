"""What stored tables must not hold; each function gives the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.operators import catalog


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("upstream") == F.col("downstream"))


def repeated_edges(edges: DataFrame) -> DataFrame:
    return repeated(edges, ["upstream", "downstream"])


def double_bindings(bindings: DataFrame) -> DataFrame:
    """Active bindings that share a job and source, or a source and native id without case."""
    active = catalog.active_bindings(bindings)
    by_job = repeated(active, ["source_id", "job_id"]).select(
        F.lit("job").alias("shared"), "source_id", F.col("job_id").alias("id"), "rows"
    )
    native = active.withColumn("native_key", F.lower("native_id"))
    by_native = repeated(native, ["source_id", "native_key"]).select(
        F.lit("native").alias("shared"), "source_id", F.col("native_key").alias("id"), "rows"
    )
    return by_job.unionByName(by_native)


def repeated_runs(runs: DataFrame) -> DataFrame:
    return repeated(runs, ["source_id", "native_run_id"])
