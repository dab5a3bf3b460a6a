"""Whole plans over the driver's tables: polls of an export into a store, rebinds, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import Tables, query
from opslake import session
from opslake.functions import contract as fn
from opslake.functions import time
from opslake.operators import validate
from opslake.plans import bindings, collect, poll, quarantine
from opslake.sources import landing, scheduler
from opslake.store import Store


def _polled(t: Tables) -> tuple[Store, list]:
    """An export of the events, polled when it held half of the history and again when it held all."""
    store, root = Store(t.spark, session.scratch(t.spark, "store")), session.scratch(t.spark, "export")
    history = i.history(t.events)
    half = history.agg(F.floor(F.max("instance_id") / 2).cast("bigint")).scalar()
    known = F.col("user_id") % 10 != 3
    users = t.events.select("user_id").distinct()
    tables = {
        "sysjobs": users.filter(known).select(
            i.text("JOB-", F.col("user_id")).alias("job_id"), i.text("load ", F.col("user_id")).alias("name"),
            F.lit(1).cast("tinyint").alias("enabled"),
            F.when(F.col("user_id") % 2 == 0, i.text("Owner: T", F.col("user_id") % 5)).alias("description"),
        ),
        "sysjobservers": users.select(
            i.text("JOB-", F.col("user_id")).alias("job_id"), F.lit(0).alias("server_id"), F.lit(0).alias("last_run_date"), F.lit(0).alias("last_run_time")
        ),
        "sysjobactivity": t.spark.createDataFrame([], scheduler.AGENT_TABLES["sysjobactivity"]),
        "syssessions": t.spark.range(1).select(F.lit(1).alias("session_id")),
    }
    results = []
    for batch, upto in ((1, half), (2, F.lit(1 << 60))):
        rows = {**tables, "sysjobhistory": history.filter(F.col("instance_id") <= upto)}
        for name, df in rows.items():
            df.select(*t.spark.createDataFrame([], scheduler.AGENT_TABLES[name]).columns).write.parquet(f"{root}/{batch}/{name}")
        read = collect.agent(t.spark, f"{root}/{batch}", 7)
        results.append(poll.cycle(store, 7, "agent", batch, f"2026-09-03 0{batch}:00:00", read))
        if not results[-1].ok:
            raise RuntimeError(results[-1].error)
    return store, results


@query("poll_agent", f"""WITH {i.HISTORY_SQL}, half AS (SELECT (max(instance_id) // 2) AS h FROM hist),
late AS (SELECT * FROM runs, half WHERE instance_id > h),
jobs AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 3),
summary AS (SELECT CAST((SELECT max(instance_id) FROM hist WHERE step_id = 0) AS VARCHAR) AS watermark, '2026-09-03 02:00:00' AS heartbeat,
  (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE user_id % 2 = 1) AS unowned,
  (SELECT count(*) FROM late) AS reports,
  (SELECT count(DISTINCT native_job_id) FROM late WHERE CAST(substr(native_job_id, 5) AS BIGINT) % 10 = 3) AS orphans,
  (SELECT count(*) FROM jobs WHERE user_id % 2 = 0) AS owned_now, (SELECT count(*) FROM jobs) AS bindings),
done AS (SELECT native_run_id, arg_min(status, instance_id) AS status, arg_min(error_text, instance_id) AS error_text,
  {i.ts_sql("min(started_at)")} AS started_at, {i.ts_sql("arg_min(ended_at, instance_id)")} AS ended_at
  FROM runs WHERE CAST(substr(native_job_id, 5) AS BIGINT) % 10 <> 3 GROUP BY native_run_id)
SELECT * FROM done, summary""")
def poll_agent(t):
    """The runs in the store after two polls, the second of which reads on from the watermark of the first.

    Beside them what the second poll reports and leaves: watermark, heartbeat, jobs without owner, orphans,
    ownership by job, bindings.
    """
    store, (_, second) = _polled(t)
    rows = store.current("run").select("native_run_id", "status", "error_text", "started_at", "ended_at")
    owned = store.current("ownership").filter("sync_id = 2 and team_id is not null").join(store.current("job").select("job_id"), "job_id")
    known = bindings.believed(store.current("binding"))
    state = store.current("source_state").select("watermark", i.ts_text("last_heartbeat").alias("heartbeat")).first()
    counts = {
        "jobs": second.jobs, "unowned": second.unowned, "reports": second.runs, "orphans": second.orphans,
        "owned_now": owned.count(), "bindings": known.count(),
    }
    summary = {"watermark": F.lit(state.watermark), "heartbeat": F.lit(state.heartbeat), **{n: F.lit(c).cast("bigint") for n, c in counts.items()}}
    return rows.withColumns({**{c: i.ts_text(c) for c in ("started_at", "ended_at")}, **summary})


def _rebound(t: Tables) -> Store:
    """Jobs of customers; two batches of commands, the second of which is about a time before the first, each sent twice."""
    store = Store(t.spark, session.scratch(t.spark, "store"))
    k = F.col("c_custkey")
    day = lambda d: F.lit(d).cast("timestamp")
    jobs = t.customer.select(
        F.col("c_nationkey").alias("source_id"), i.text("N", k).alias("native_id"), i.text("J", k).alias("job_id"), day("2024-01-01").alias("bound_at")
    )
    store.commit(1, {"binding": bindings.points(jobs, day("2024-01-02"))}, "poll")
    command = lambda name, source, native, at: t.customer.select(
        i.text(name, k).alias("command_id"), i.text("J", k).alias("job_id"), F.lit(source).alias("source_id"), i.text(native, k).alias("native_id"),
        F.col("c_name").alias("native_name"), day(at).alias("at"), F.lit("dba").alias("who"), "c_mktsegment", "c_custkey",
    )
    moved = command("m", 99, "dag_", "2024-03-01").filter("c_mktsegment in ('BUILDING', 'MACHINERY')")
    late = command("l", 98, "old_", "2024-02-01").filter("c_mktsegment = 'MACHINERY'").unionByName(
        command("t", 99, "DAG_", "2024-03-10").filter("c_mktsegment = 'FURNITURE'").withColumn("native_id", i.text("dag_", F.col("c_custkey") + 1))
    )
    for n, (rows, now) in enumerate([(moved, "2024-03-02"), (moved, "2024-03-05"), (late, "2024-04-01"), (late, "2024-04-02")], 1):
        bindings.rebind(store, rows, n, now)
    return store


@query("binding_two_times", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer),
tenant AS (SELECT k + 1 AS k FROM c WHERE s IN ('BUILDING', 'MACHINERY')),
f AS (SELECT k FROM c WHERE s = 'FURNITURE' AND k + 1 NOT IN (SELECT k FROM c WHERE s IN ('BUILDING', 'MACHINERY'))),
v AS (SELECT '2024-03-15' AS known, k, n AS source_id, 'N' || k AS native_id, '2024-01-01' AS bound_at,
    CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN '2024-03-01' END AS unbound_at FROM c
  UNION ALL SELECT '2024-03-15', k, 99, 'dag_' || k, '2024-03-01', NULL FROM c WHERE s IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT '2024-05-01', k, n, 'N' || k, '2024-01-01',
    CASE WHEN s = 'BUILDING' THEN '2024-03-01' WHEN s = 'MACHINERY' THEN '2024-02-01' WHEN k IN (SELECT k FROM f) THEN '2024-03-10' END FROM c
  UNION ALL SELECT '2024-05-01', k, 99, 'dag_' || k, '2024-03-01', NULL FROM c WHERE s IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT '2024-05-01', k, 98, 'old_' || k, '2024-02-01', '2024-03-01' FROM c WHERE s = 'MACHINERY'
  UNION ALL SELECT '2024-05-01', k, 99, 'dag_' || (k + 1), '2024-03-10', NULL FROM f)
SELECT known, 'J' || k AS job_id, source_id, native_id, bound_at, unbound_at FROM v""")
def binding_two_times(t):
    """Bindings as they were known in March and in May, when a command about February had come."""
    facts = _rebound(t).current("binding")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    seen = lambda d: bindings.believed(facts, F.lit(d).cast("timestamp")).select(
        F.lit(d).alias("known"), "job_id", "source_id", "native_id", day("bound_at"), day("unbound_at")
    )
    return seen("2024-03-15").unionByName(seen("2024-05-01"))


@query("command_log", """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer)
SELECT 'm' || k AS command_id, 'Done' AS outcome, '2024-03-02' AS recorded, 'dba' AS who FROM c WHERE s IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'l' || k, 'Done', '2024-04-01', 'dba' FROM c WHERE s = 'MACHINERY'
UNION ALL SELECT 't' || k, CASE WHEN k + 1 IN (SELECT k FROM c WHERE s IN ('BUILDING', 'MACHINERY')) THEN 'Refused' ELSE 'Done' END, '2024-04-01', 'dba'
FROM c WHERE s = 'FURNITURE'""")
def command_log(t):
    return _rebound(t).current("command").select("command_id", "outcome", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded"), "who")


@query("landed_listing", """SELECT 'day=' || strftime(o_orderdate, '%Y-%m') AS folder,
  CAST(sum(strlen('order ' || o_orderkey || ' of ' || o_custkey) + 1) AS BIGINT) AS bytes FROM orders GROUP BY 1""")
def landed_listing(t):
    """Files landed in a folder a month, listed with their sizes by tasks."""
    root = session.scratch(t.spark, "landing")
    lines = t.orders.select(i.text("order ", F.col("o_orderkey"), " of ", F.col("o_custkey")).alias("value"), F.date_format("o_orderdate", "yyyy-MM").alias("day"))
    lines.repartition("day").write.partitionBy("day").text(root)
    listed = landing.relative_key(landing.arrivals(t.spark, root, "*.txt"), root.removeprefix("file://"))
    return listed.groupBy(F.substring_index("key", "/", 1).alias("folder")).agg(F.sum("size_bytes").alias("bytes"))


@query("landed_names", """SELECT p_partkey, p_partkey % 2 = 0 AS fixed_width FROM part WHERE p_size % 3 <> 0""")
def landed_names(t):
    """Names say how a file is read, and that it is still to come."""
    kind = F.when(F.col("p_partkey") % 2 == 0, F.when(F.col("p_size") % 2 == 0, ".txt").otherwise(".TXT")).otherwise(".csv")
    late = F.when(F.col("p_size") % 3 == 0, ".late").otherwise("")
    named = t.part.select("p_partkey", i.text("landing/F", F.col("p_partkey"), kind, late).alias("key"))
    return validate.landed(named).select("p_partkey", fn.is_fixed_width(F.col("key")).alias("fixed_width"))


@query("watermark_positions", f"""SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS BIGINT) ELSE 0 END AS position,
  {i.ts_sql("CASE o_orderkey % 4 WHEN 1 THEN o_orderdate ELSE TIMESTAMP '2026-09-02 02:00:00' END")} AS since FROM orders""")
def watermark_positions(t):
    """Stored marks of history readers and of pollers; what can't be read counts as none."""
    k = F.col("o_orderkey")
    mark = i.pick(k % 4, [F.col("o_custkey").cast("string"), i.ts_text(F.col("o_orderdate").cast("timestamp")), i.text("x", k), F.lit(None).cast("string")])
    polled = F.lit("2026-09-03 02:00:00").cast("timestamp")
    since = F.when(k % 4 == 0, F.lit("2026-09-02 02:00:00").cast("timestamp")).otherwise(time.poll_position(mark, polled))
    return t.orders.select("o_orderkey", time.history_position(mark).alias("position"), i.ts_text(since).alias("since"))


@query("ambiguous_masks", """SELECT 'landing/p' || (p_partkey % 50) || '/' AS landing_prefix, 'f' || (p_partkey % 70) || '_{yyyymmdd}.csv' AS mask,
  string_agg('P' || p_partkey, ',' ORDER BY 'P' || p_partkey) AS feeds FROM part GROUP BY ALL HAVING count(*) > 1""")
def ambiguous_masks(t):
    """Feeds whose files can't be told apart by name; masks differ by case only."""
    k = F.col("p_partkey")
    feeds = t.part.select(
        i.text("landing/p", k % 50, "/").alias("landing_prefix"), i.text("P", k).alias("feed_name"),
        F.concat(F.when(k % 2 == 0, "F").otherwise("f"), (k % 70).cast("string"), F.lit("_{yyyyMMdd}.csv")).alias("file_mask"),
    )
    return validate.ambiguous_masks(feeds).withColumn("feeds", F.array_join("feeds", ","))


@query("quarantine_places", """SELECT 'day=' || strftime(o_orderdate, '%Y-%m') AS folder,
  CASE WHEN month(o_orderdate) % 3 = 0 THEN 'Aside' ELSE 'Landed' END AS place, count(*) AS lines,
  CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL""")
def quarantine_places(t):
    """Files of every third month set aside, by a run that first died after its intents; lines are read at their places."""
    store, root = Store(t.spark, session.scratch(t.spark, "store")), session.scratch(t.spark, "landing")
    aside = session.scratch(t.spark, "aside")
    lines = t.orders.select(F.col("o_orderkey").cast("string").alias("value"), F.date_format("o_orderdate", "yyyy-MM").alias("day"))
    lines.repartition("day").write.partitionBy("day").text(root)
    plain = root.removeprefix("file://")
    files = landing.relative_key(landing.arrivals(t.spark, root, "*.txt"), plain)
    folder = F.substring_index("key", "/", 1)
    bad = F.substring_index(folder, "-", -1).cast("int") % 3 == 0
    judged = files.select("*", folder.alias("feed_name"), F.when(bad, "Quarantined").otherwise("Validated").alias("disposition"))
    store.commit(1, {"arrival": judged}, "landing")
    quarantine.intend(store, plain, aside, 1, "2026-01-01")
    quarantine.run(store, plain, aside, 2, "2026-01-02")
    places = quarantine.places(store, plain).select(F.col("feed_name").alias("folder"), "place", "path")
    one = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/")
    read = t.spark.read.text([plain, aside], recursiveFileLookup=True).select(F.col("value").cast("bigint").alias("k"), F.url_decode(one).alias("at"))
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return places.withColumn("at", at).join(read, "at").groupBy("folder", "place").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("k").alias("keys")
    )
