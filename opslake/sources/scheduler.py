"""Scheduler exports: agent tables as parquet, DAG listings as landed JSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake import schemas

AGENT_TABLES = {
    "sysjobs": schemas.SYSJOBS,
    "sysjobservers": schemas.SYSJOBSERVERS,
    "sysjobactivity": schemas.SYSJOBACTIVITY,
    "syssessions": schemas.SYSSESSIONS,
    "sysjobhistory": schemas.SYSJOBHISTORY,
}


def agent_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(AGENT_TABLES[name]).parquet(f"{root}/{name}")


def agent_table_jdbc(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """The same table over the user's own JDBC driver; filters on it reach the server."""
    return spark.read.format("jdbc").option("dbtable", f"msdb.dbo.{name}").options(**options).load()


def history_above(history: DataFrame, since: Column | int) -> DataFrame:
    """Incremental read of run history; the comparison reaches the scan."""
    return history.filter(F.col("instance_id") > since)


def _pages(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
        .select(F.col(field).alias("items"), "total_entries")
    )


def dag_pages(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, schemas.DAG_PAGE, "dags")


def dag_run_pages(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, schemas.DAG_RUN_PAGE, "dag_runs")


def items(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("items").alias("item")).select("item.*")


def updated_since(dag_runs: DataFrame, since: Column) -> DataFrame:
    """Runs updated at or after an instant; runs without an update time are kept."""
    return dag_runs.filter(F.col("updated_at").isNull() | (F.col("updated_at") >= since))


def completeness(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per listing: items landed, items announced, and whether all are there.

    A short listing, or one with no readable page, must fail the sync: it is not an empty catalogue.
    """
    none = F.array().cast(pages.schema["items"].dataType)
    landed = F.coalesce(F.sum(F.size(F.coalesce("items", none))), F.lit(0)).cast("bigint")
    return pages.groupBy(*(keys or [])).agg(
        landed.alias("landed"), F.max("total_entries").cast("bigint").alias("announced")
    ).withColumn("complete", F.coalesce(F.col("landed") >= F.col("announced"), F.lit(False)))
