"""What a poll reads: agent exports, or landed listings of a DAG scheduler."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from opslake.functions import time
from opslake.operators import catalog, health, runs
from opslake.plans.poll import Collected
from opslake.sources import scheduler


def _first(spark: SparkSession, expression: Column):
    return spark.range(1).select(expression).first()[0]


def agent(spark: SparkSession, root: str, source_id: int, zone: str = "UTC") -> Callable[[str | None], Collected]:
    """Reader of agent table exports below ``root``.

    History is read from the first step that no outcome has taken yet, runs are reported above the
    watermark: completed ones in history order, then the ones in flight.
    """

    def collect(watermark: str | None) -> Collected:
        table = {name: scheduler.agent_table(spark, root, name) for name in scheduler.AGENT_TABLES}
        history, activity, sessions = table["sysjobhistory"], table["sysjobactivity"], table["syssessions"]
        mark = F.lit(watermark).cast("string")
        since = _first(spark, time.history_position(mark))
        start = runs.read_position(history, since).first().read_from
        done = runs.fold_history(scheduler.history_above(history, start), zone).filter(F.col("instance_id") > since)
        top = done.agg(F.coalesce(F.max("instance_id") + 1, F.lit(0)).alias("top")).first().top
        flying = runs.in_flight(activity, sessions, zone).withColumn("seq", F.lit(top).cast("bigint"))
        reports = done.withColumnRenamed("instance_id", "seq").unionByName(flying)
        gaps = health.purge_gap(
            history.withColumn("source_id", F.lit(source_id)),
            spark.createDataFrame([(source_id, since)], "source_id int, since bigint"),
        )
        jobs = catalog.agent_jobs(table["sysjobs"], table["sysjobservers"], activity, sessions, zone)
        return Collected(jobs, reports, runs.history_watermark(history, mark).first().watermark, gaps)

    return collect


def dags(
    spark: SparkSession, dag_pages: str, run_pages: str, poll_started: str, lookback_seconds: int = 86400
) -> Callable[[str | None], Collected]:
    """Reader of landed listing pages.

    A listing with pages missing is an error, not a small catalogue. The new watermark is the start
    of the poll, so the next poll reads an overlap, which the run lifecycle ignores.
    """

    def whole(pages, what: str):
        if not scheduler.completeness(pages).first().complete:
            raise RuntimeError(f"{what} listing is incomplete")
        return scheduler.items(pages)

    def collect(watermark: str | None) -> Collected:
        polled = F.lit(poll_started).cast("timestamp")
        since = time.poll_position(F.lit(watermark).cast("string"), polled, lookback_seconds)
        jobs = catalog.dag_jobs(whole(scheduler.dag_pages(spark, dag_pages), "DAG"))
        raw = scheduler.updated_since(whole(scheduler.dag_run_pages(spark, run_pages), "DAG run"), since)
        seen = F.coalesce("updated_at", "end_date", "start_date", "logical_date", "execution_date", polled)
        reports = runs.dag_runs_to_runs(raw.withColumn("seq", F.unix_micros(seen)), polled, ["seq"])
        return Collected(jobs, reports, poll_started)

    return collect
