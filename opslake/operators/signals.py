"""From failures to causes: grouping, classes, trends, downstream cones, detection time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslake import session, vocab
from opslake.functions import fingerprint as fp
from opslake.operators import alerts


def grouped_failures(runs: DataFrame, top: int | None = None) -> DataFrame:
    """Failed runs by fingerprint: how often, since when, how many jobs."""
    groups = (
        runs.filter(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.min("started_at").alias("first_seen"),
            F.max("started_at").alias("last_seen"),
            F.count_distinct("native_job_id").alias("jobs"),
        )
    )
    return groups if top is None else groups.orderBy(F.col("occurrences").desc(), "fingerprint").limit(top)


def failure_events(runs: DataFrame, seq: Column) -> DataFrame:
    """One raise per failed run, keyed by root cause: the alert type and the fingerprint."""
    return runs.filter(F.col("fingerprint").isNotNull()).select(
        fp.dedup_key(F.lit(vocab.JOB_FAILED), F.col("fingerprint")).alias("dedup_key"),
        F.lit(vocab.JOB_FAILED).alias("type"), F.lit(alerts.RAISE).alias("kind"),
        F.coalesce("ended_at", "started_at").alias("at"), seq.alias("seq"),
        fp.shape(F.col("error_text")).alias("message"),
    )


def feed_events(found: DataFrame, kind: str, at: Column, seq: Column) -> DataFrame:
    """One raise per finding row, keyed by alert type and feed (FeedLate, SchemaDrift)."""
    return found.select(
        fp.dedup_key(F.lit(kind), F.col("feed_name")).alias("dedup_key"),
        F.lit(kind).alias("type"), F.lit(alerts.RAISE).alias("kind"), at.alias("at"), seq.alias("seq"),
        F.concat(F.col("feed_name"), F.lit(": "), F.lit(kind)).alias("message"),
    )


# The nine classes and what a message of each looks like, tried in this order.
CLASSES = (
    ("connection-credential", r"(?i)login failed|access denied|permission|credential|connection (?:refused|reset)|timed? ?out"),
    ("filemask drift", r"(?i)unexpected file ?name|file ?mask|does not match (?:mask|pattern)"),
    ("schema drift", r"(?i)schema drift|invalid column|column .{0,80}(?:renamed|missing|added|removed)"),
    ("data violation", r"(?i)cannot insert .{0,40}null|truncat|conversion failed|constraint|duplicate key"),
    ("schedule collision", r"(?i)already running|deadlock|lock request|previous (?:run|execution)"),
    ("upstream failed", r"(?i)upstream"),
    ("file late", r"(?i)file .{0,80}(?:late|not yet)"),
    ("file missing", r"(?i)could not find file|file not found|no such file"),
)
CODE_BUG = "code bug"


def message_class(error: Column) -> Column:
    result = F.lit(CODE_BUG)
    for name, pattern in reversed(CLASSES):
        result = F.when(error.rlike(pattern), F.lit(name)).otherwise(result)
    return result


def enrich_with_arrivals(failures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Attach what the landing zone saw for the failure's feed and day: files and last arrival."""
    log = arrivals.groupBy("feed_name", "day").agg(
        F.count(F.lit(1)).alias("files_arrived"), F.max("arrived_at").alias("last_arrival")
    )
    return failures.join(log, ["feed_name", "day"], "left").withColumn(
        "files_arrived", F.coalesce("files_arrived", F.lit(0)).cast("bigint")
    )


def classify(failures: DataFrame, downstream: DataFrame | None = None) -> DataFrame:
    """Give each failure its class.

    The text decides first. "File missing" turns into "file late" if the file did come, after the
    run had started. A code bug downstream of a failed job is "upstream failed".
    Needs error_text, started_at, last_arrival; ``downstream`` holds the job ids of the cone.
    """
    first = message_class(F.col("error_text"))
    came_later = F.col("last_arrival") > F.col("started_at")
    failures = failures.withColumn(
        "class", F.when((first == "file missing") & came_later, F.lit("file late")).otherwise(first)
    )
    if downstream is None:
        return failures
    below = downstream.select(F.col("job_id").alias("__below")).distinct()
    joined = failures.join(below, F.col("job_id") == F.col("__below"), "left")
    return joined.withColumn(
        "class",
        F.when((F.col("class") == CODE_BUG) & F.col("__below").isNotNull(), F.lit("upstream failed")).otherwise(
            F.col("class")
        ),
    ).drop("__below")


def class_share(failures: DataFrame) -> DataFrame:
    """Share of each class among a month's failures."""
    counted = failures.groupBy(F.trunc("day", "month").alias("month"), "class").agg(F.count(F.lit(1)).alias("failures"))
    # Nine classes a month: the window sees counts, not failures.
    whole = F.sum("failures").over(W.partitionBy("month"))
    return counted.withColumn("share", F.col("failures") / whole)


def top_offenders(failures: DataFrame, n: int = 5) -> DataFrame:
    """The feeds with most failures in each month. The row-number filter limits before the shuffle."""
    counted = failures.groupBy(F.trunc("day", "month").alias("month"), "feed_name").agg(
        F.count(F.lit(1)).alias("failures")
    )
    place = F.row_number().over(W.partitionBy("month").orderBy(F.col("failures").desc(), "feed_name"))
    return counted.withColumn("place", place).filter(F.col("place") <= n)


def detection_time(alert_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Seconds from the end of a failed run, by the scheduler's own clock, to its alert.

    The first failed run of a root cause is the one its alert was raised for.
    """
    key = fp.dedup_key(F.lit(vocab.JOB_FAILED), F.col("fingerprint"))
    first_end = (
        runs.filter(F.col("fingerprint").isNotNull() & F.col("ended_at").isNotNull())
        .groupBy(key.alias("dedup_key")).agg(F.min("ended_at").alias("ended_at"))
    )
    lag = F.unix_seconds("first_seen") - F.unix_seconds("ended_at")
    return alert_rows.join(first_end, "dedup_key").withColumn("detect_seconds", lag)


def detection_summary(alert_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean time to detect by source and month of the alert, with the median and the 95th percentile.

    The source is that of the first failed run of the root cause. Needs ``source_id`` in ``runs``.
    """
    key = fp.dedup_key(F.lit(vocab.JOB_FAILED), F.col("fingerprint")).alias("dedup_key")
    ended = runs.filter(F.col("fingerprint").isNotNull() & F.col("ended_at").isNotNull())
    source = ended.groupBy(key).agg(F.min_by("source_id", F.struct("ended_at", "source_id")).alias("source_id"))
    timed = detection_time(alert_rows, runs).join(source, "dedup_key")
    lag = F.col("detect_seconds")
    return timed.groupBy("source_id", F.trunc(F.col("first_seen"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("alerts"), F.avg(lag).alias("mean_seconds"),
        F.percentile(lag, 0.5).alias("median_seconds"), F.percentile(lag, 0.95).alias("p95_seconds"),
    )


def cone(edges: DataFrame, failed: DataFrame, max_depth: int | None = None, hops: int = 4) -> DataFrame:
    """Every job downstream of a failed one with its distance; the failed jobs have distance 0.

    ``edges``: upstream, downstream; ``failed``: job_id. Breadth first, ``hops`` layers a round: each
    round walks on from the last layer and keeps jobs not seen before, so cycles end. What a round finds
    is written to the shared folder, which keeps the plan short and survives lost executors. Within a
    round a job is one row after every hop, however many edges lead to it. Where cones are asked for
    often, ``plans.dependencies`` keeps all distances.
    """
    spark = edges.sparkSession
    edges = edges.filter(F.col("upstream") != F.col("downstream")).select("upstream", "downstream").distinct()
    # a job stays where it is or goes one edge on
    one = edges.withColumn("step", F.lit(1))
    moves = one.unionByName(edges.select("upstream", F.col("upstream").alias("downstream"), F.lit(0).alias("step")).distinct())
    root = session.scratch(spark, "cone")
    layer = failed.select("job_id").distinct().withColumn("depth", F.lit(0))
    layer.write.parquet(f"{root}/round=0")
    schema = layer.schema
    n, depth = 0, 0
    while max_depth is None or depth < max_depth:
        seen = spark.read.schema(schema).parquet(*[f"{root}/round={i}" for i in range(n + 1)])
        walk = spark.read.schema(schema).parquet(f"{root}/round={n}").filter(F.col("depth") == depth)
        ahead = hops if max_depth is None else min(hops, max_depth - depth)
        for i in range(ahead):
            to = walk.join(moves if i else one, F.col("job_id") == F.col("upstream"), "left" if i else "inner")
            to = to.select(F.coalesce("downstream", "job_id").alias("job_id"), (F.col("depth") + F.coalesce("step", F.lit(0))).alias("depth"))
            walk = to.groupBy("job_id").agg(F.min("depth").alias("depth"))
        n, depth = n + 1, depth + ahead
        walk.join(seen.select("job_id"), "job_id", "left_anti").write.parquet(f"{root}/round={n}")
        if spark.read.schema(schema).parquet(f"{root}/round={n}").filter(F.col("depth") == depth).isEmpty():
            break
    return spark.read.schema(schema).parquet(*[f"{root}/round={i}" for i in range(n + 1)])
