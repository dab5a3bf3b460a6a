"""Runs: fold, lifecycle, times, catalogue, orphans, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import Tables, query
from opslake.functions import time
from opslake.operators import catalog, runs, scan, signals


def folded(t: Tables):
    return runs.with_fingerprint(runs.fold_history(i.history(t.events)))


def _text_times(df):
    return df.withColumns({c: i.ts_text(c) for c in ("started_at", "ended_at") if c in df.columns})


@query("run_fold", f"""WITH {i.HISTORY_SQL}
SELECT instance_id, native_job_id, native_run_id, {i.ts_sql('started_at')} AS started_at,
  {i.ts_sql('ended_at')} AS ended_at, status, error_text, fingerprint FROM runs""")
def run_fold(t):
    return _text_times(folded(t))


@query("grouped_failures", f"""WITH {i.HISTORY_SQL}
SELECT fingerprint, count(*) AS occurrences, {i.ts_sql('min(started_at)')} AS first_seen,
  {i.ts_sql('max(started_at)')} AS last_seen, count(DISTINCT native_job_id) AS jobs
FROM runs WHERE fingerprint IS NOT NULL GROUP BY fingerprint""")
def grouped_failures(t):
    groups = signals.grouped_failures(folded(t))
    return groups.withColumns({c: i.ts_text(c) for c in ("first_seen", "last_seen")})


@query("top_failures", f"""WITH {i.HISTORY_SQL}
SELECT fingerprint, count(*) AS occurrences FROM runs WHERE fingerprint IS NOT NULL GROUP BY fingerprint
ORDER BY occurrences DESC, fingerprint LIMIT 20""")
def top_failures(t):
    return signals.grouped_failures(folded(t), top=20).select("fingerprint", "occurrences")


@query("history_positions", f"""WITH {i.HISTORY_SQL},
mark AS (SELECT CAST(max(instance_id) // 2 AS BIGINT) AS since FROM hist),
done AS (SELECT job_id, max(CASE WHEN step_id = 0 AND run_date > 0 THEN instance_id END) AS consumed FROM hist, mark WHERE instance_id <= since GROUP BY job_id),
top AS (SELECT max(CASE WHEN step_id = 0 THEN instance_id END) AS seen FROM hist),
lowest AS (SELECT min(h.instance_id) - 1 AS p FROM hist h JOIN done d USING (job_id), mark
  WHERE h.step_id <> 0 AND h.instance_id <= since AND (d.consumed IS NULL OR h.instance_id > d.consumed))
SELECT CASE WHEN seen > since THEN CAST(seen AS VARCHAR) ELSE CAST(since AS VARCHAR) END AS watermark,
  CAST(coalesce(p, since) AS BIGINT) AS read_from FROM top, lowest, mark""")
def history_positions(t):
    """The mark of the last poll is half-way through the history."""
    h = i.history(t.events)
    since = scan.bounds(h, "instance_id")["high"] // 2
    position = runs.read_position(h, since)
    return runs.history_watermark(h, F.lit(str(since))).withColumn("read_from", position.scalar())


@query("packed_time", """WITH p AS (
  SELECT o_orderkey, o_orderkey % 97 = 0 AS never,
    o_orderdate + to_seconds(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey * 7 % 60) AS local,
    (o_orderkey % 200) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 AS seconds FROM orders)
SELECT o_orderkey, CASE WHEN NOT never THEN strftime(local, '%Y-%m-%d %H:%M:%S') END AS started,
  CASE WHEN NOT never THEN strftime(local - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') END AS started_east,
  CAST(seconds AS BIGINT) AS duration_seconds,
  CASE WHEN NOT never THEN strftime(local + to_seconds(seconds), '%Y-%m-%d %H:%M:%S') END AS ended,
  CASE WHEN NOT never THEN 'order-' || o_orderkey || ':' || strftime(local, '%Y%m%d%H%M%S') END AS execution_key
FROM p""")
def packed_time(t):
    k = F.col("o_orderkey")
    packed = t.orders.select(
        k,
        F.when(k % 97 == 0, 0).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("d"),
        (k % 24 * 10000 + k % 60 * 100 + k * 7 % 60).cast("int").alias("h"),
        (k % 200 * 10000 + k % 60 * 100 + k % 59).cast("int").alias("p"),
    ).withColumn("start", time.packed_to_utc(F.col("d"), F.col("h")))
    return packed.select(
        "o_orderkey",
        i.ts_text("start").alias("started"),
        i.ts_text(time.packed_to_utc(F.col("d"), F.col("h"), "Asia/Kolkata")).alias("started_east"),
        time.packed_seconds(F.col("p")).alias("duration_seconds"),
        i.ts_text(F.col("start") + time.packed_interval(F.col("p"))).alias("ended"),
        time.execution_key(i.text("ORDER-", k), F.col("start")).alias("execution_key"),
    )


@query("run_lifecycle", f"""WITH {i.LIFECYCLE_SQL}
SELECT source_id, native_run_id, job_id, {i.ts_sql('started_at')} AS started_at, {i.ts_sql('ended_at')} AS ended_at,
  status, error_text, fingerprint, reports FROM lifecycle""")
def run_lifecycle(t):
    merged = runs.merge_lifecycle(i.reports(t.events), ["source_id", "native_run_id"], ["job_id"])
    return _text_times(merged).drop("last_seq")


@query("run_write_outcomes", f"""WITH {i.REPORTS_SQL},
walked AS (
  SELECT *, row_number() OVER w AS n, first_value(ended_at) OVER w AS born_end,
    max(CASE WHEN terminal AND ended_at IS NOT NULL THEN 1 ELSE 0 END) OVER (
      PARTITION BY source_id, native_run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shut
  FROM reports WINDOW w AS (PARTITION BY source_id, native_run_id ORDER BY seq)),
judged AS (
  SELECT status, CASE WHEN n = 1 THEN 'Inserted' WHEN terminal AND born_end IS NULL AND shut = 0 THEN 'Closed'
    ELSE 'Unchanged' END AS outcome FROM walked)
SELECT status, outcome, count(*) AS reports FROM judged GROUP BY ALL""")
def run_write_outcomes(t):
    events = i.reports(t.events)
    judged = runs.write_outcomes(events, ["source_id", "native_run_id"], scan.id_chunk("seq"))
    return judged.groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("reports"))


def activity(t: Tables):
    kind = F.col("event_type")
    return t.events.select(
        i.text("job-", F.col("user_id")).alias("job_id"), F.dayofmonth("ts").alias("session_id"),
        F.when(kind != "view", F.col("ts")).alias("start_execution_date"),
        F.when(kind.isin("click", "error"), F.col("ts")).alias("stop_execution_date"),
    )


@query("inflight_latest_session", f"""
SELECT 'job-' || user_id AS native_job_id, 'job-' || user_id || ':' || strftime(ts, '%Y%m%d%H%M%S') AS native_run_id,
  {i.ts_sql('ts')} AS started_at, 'Running' AS status
FROM events WHERE day(ts) = (SELECT max(day(ts)) FROM events) AND event_type NOT IN ('view', 'click', 'error')""")
def inflight_latest_session(t):
    a = activity(t)
    found = runs.in_flight(a, a.select("session_id"))
    return found.select("native_job_id", "native_run_id", i.ts_text("started_at").alias("started_at"), "status")


@query("job_catalogue", f"""WITH server AS (
  SELECT o_custkey, max(o_orderdate) AS d FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey),
next AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR AS due FROM events
  WHERE day(ts) = (SELECT max(day(ts)) FROM events) GROUP BY user_id)
SELECT 'job-' || c_custkey AS native_id, c_name AS native_name,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Team: ' || c_mktsegment END AS description, c_custkey % 5 <> 0 AS is_active,
  {i.ts_sql('d + to_seconds(c_custkey % 24 * 3600)')} AS last_run_at, {i.ts_sql("due")} AS next_run_at
FROM customer LEFT JOIN server ON o_custkey = c_custkey LEFT JOIN next ON user_id = c_custkey""")
def job_catalogue(t):
    k = F.col("c_custkey")
    jobs = t.customer.select(
        i.text("JOB-", k).alias("job_id"), F.col("c_name").alias("name"), (k % 5 != 0).cast("tinyint").alias("enabled"),
        F.when(k % 7 != 0, i.text("Team: ", F.col("c_mktsegment"))).alias("description"),
    )
    o = F.col("o_custkey")
    servers = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("d")).select(
        i.text("JOB-", o).alias("job_id"), (o % 2).cast("int").alias("server_id"),
        F.date_format("d", "yyyyMMdd").cast("int").alias("last_run_date"), (o % 24 * 10000).cast("int").alias("last_run_time"),
    )
    sessions = t.events.select(i.text("JOB-", F.col("user_id")).alias("job_id"), F.dayofmonth("ts").alias("session_id"), "ts")
    current = sessions.groupBy("job_id", "session_id").agg(
        (F.max("ts") + F.expr("INTERVAL '1' HOUR")).alias("next_scheduled_run_date")
    )
    found = catalog.agent_jobs(jobs, servers, current, sessions)
    return found.select(
        "native_id", "native_name", "description", "is_active", i.ts_text("last_run_at").alias("last_run_at"),
        i.ts_text("next_run_at").alias("next_run_at"),
    )


@query("orphan_runs", """
SELECT 'cust-' || user_id AS native_job_id, count(*) AS runs FROM events
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_mktsegment <> 'FURNITURE') GROUP BY ALL""")
def orphan_runs(t):
    bindings = t.customer.filter("c_mktsegment <> 'FURNITURE'").select(i.text("CUST-", F.col("c_custkey")).alias("native_id"))
    reported = t.events.select(i.text("Cust-", F.col("user_id")).alias("native_job_id"))
    lost = runs.orphans(reported, bindings)
    return lost.groupBy(F.lower("native_job_id").alias("native_job_id")).agg(F.count(F.lit(1)).alias("runs"))


@query("orphan_report", """
SELECT 'cust-' || user_id AS native_job_id, count(*) AS runs FROM events
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_mktsegment <> 'FURNITURE')
GROUP BY ALL ORDER BY native_job_id LIMIT 10""")
def orphan_report(t):
    """The ten lowest ids, as a poll reports them."""
    bindings = t.customer.filter("c_mktsegment <> 'FURNITURE'").select(i.text("CUST-", F.col("c_custkey")).alias("native_id"))
    reported = t.events.select(i.text("Cust-", F.col("user_id")).alias("native_job_id"))
    return runs.orphan_report(runs.orphans(reported, bindings))


def order_runs(t: Tables):
    k = F.col("o_orderkey")
    start = utc_start = i.utc("o_orderdate")
    return t.orders.select(
        F.col("o_custkey").alias("job_id"), i.text("order-", k).alias("native_run_id"), start.alias("started_at"),
        time.plus_seconds(utc_start, k % 7200).alias("ended_at"),
        i.pick(k % 3, ["Succeeded", "Failed", "Cancelled"]).alias("status"),
    )


_ORDER_RUNS_SQL = """runs AS (SELECT o_custkey AS job_id, 'order-' || o_orderkey AS native_run_id, o_orderdate AS started_at,
  o_orderdate + to_seconds(o_orderkey % 7200) AS ended_at,
  CASE o_orderkey % 3 WHEN 0 THEN 'Succeeded' WHEN 1 THEN 'Failed' ELSE 'Cancelled' END AS status FROM orders)"""


@query("timeline_newest", f"""WITH {_ORDER_RUNS_SQL}
SELECT job_id, c_name AS job_name, native_run_id, {i.ts_sql('started_at')} AS started_at, status,
  CAST(epoch(ended_at) - epoch(started_at) AS BIGINT) AS duration_seconds
FROM runs JOIN customer ON c_custkey = job_id ORDER BY runs.started_at DESC, native_run_id LIMIT 200""")
def timeline_newest(t):
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"))
    newest = runs.timeline(order_runs(t), jobs, newest=200)
    return newest.select(
        "job_id", "job_name", "native_run_id", i.ts_text("started_at").alias("started_at"), "status", "duration_seconds"
    )


@query("run_timeline", f"""WITH {_ORDER_RUNS_SQL}
SELECT c_name AS job_name, status, count(*) AS runs, CAST(sum(epoch(ended_at) - epoch(started_at)) AS BIGINT) AS busy_seconds
FROM runs JOIN customer ON c_custkey = job_id GROUP BY ALL""")
def run_timeline(t):
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"))
    return runs.timeline(order_runs(t), jobs).groupBy("job_name", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_seconds").alias("busy_seconds")
    )


@query("current_state", f"""WITH {_ORDER_RUNS_SQL},
best AS (SELECT job_id, arg_max({{'r': native_run_id, 's': started_at, 't': status}}, {{'s': started_at, 'r': native_run_id}}) AS l,
  count(*) AS runs FROM runs GROUP BY job_id)
SELECT job_id, l.r AS native_run_id, {i.ts_sql('l.s')} AS started_at, l.t AS status, runs FROM best""")
def current_state(t):
    latest = runs.current_state(order_runs(t))
    return latest.select("job_id", "native_run_id", i.ts_text("started_at").alias("started_at"), "status", "runs")


@query("schedule_collision", f"""WITH intervals AS (
  SELECT event_id, user_id, ts, ts + to_seconds(event_id * 37 % 90000) AS ended FROM events),
seen AS (SELECT *, max(ended) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM intervals)
SELECT user_id AS source_id, event_id AS native_run_id, {i.ts_sql('busy')} AS busy_until FROM seen WHERE busy > ts""")
def schedule_collision(t):
    started = t.events.select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("native_run_id"), i.utc("ts").alias("started_at"),
        time.plus_seconds(i.utc("ts"), F.col("event_id") * 37 % 90000).alias("ended_at"),
    )
    found = runs.collisions(started, ["source_id"], scan.time_chunk("started_at"))
    return found.select("source_id", "native_run_id", i.ts_text("busy_until").alias("busy_until"))


@query("dag_runs", f"""
SELECT 'dag_' || o_custkey AS native_job_id, 'dag_' || o_custkey || ':manual__' || o_orderkey AS native_run_id,
  {i.ts_sql('''CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 1 HOUR WHEN o_orderkey % 25 <> 0 THEN o_orderdate
    ELSE TIMESTAMP '2026-09-03 02:00:00' END''')} AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN {i.ts_sql('o_orderdate + INTERVAL 2 HOUR')} END AS ended_at,
  CASE o_orderkey % 6 WHEN 0 THEN 'Succeeded' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Running' WHEN 3 THEN 'Queued' ELSE 'Unknown' END AS status,
  CASE WHEN o_orderkey % 6 = 1 THEN 'Airflow DAG dag_' || o_custkey || ' run failed ('
    || CASE WHEN o_orderkey % 4 = 1 THEN 'scheduled' ELSE 'unknown trigger' END || ')'
    || CASE WHEN o_orderkey % 7 = 0 THEN ': ' || o_orderpriority ELSE '' END END AS error_text
FROM orders""")
def dag_runs(t):
    k = F.col("o_orderkey")
    raw = t.orders.select(
        i.text("dag_", F.col("o_custkey")).alias("dag_id"), i.text("manual__", k).alias("dag_run_id"),
        i.pick(k % 6, [F.lit("success"), F.lit("failed"), F.lit("running"), F.lit("queued"), F.lit("SUCCESS"), F.lit(None).cast("string")]).alias("state"),
        F.when(k % 4 == 1, "scheduled").alias("run_type"),
        F.when(k % 25 != 0, i.utc("o_orderdate")).alias("logical_date"),
        F.lit(None).cast("timestamp").alias("execution_date"),
        F.when(k % 5 != 0, time.plus_seconds(i.utc("o_orderdate"), F.lit(3600))).alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", time.plus_seconds(i.utc("o_orderdate"), F.lit(7200))).alias("end_date"),
        F.when(k % 7 == 0, F.col("o_orderpriority")).when(k % 7 == 1, "  ").alias("note"),
    )
    return _text_times(runs.dag_runs_to_runs(raw, F.lit("2026-09-03 02:00:00").cast("timestamp")))


@query("binding_at_start", """WITH b AS (
  SELECT c_custkey AS k, 'A' AS job, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 5 AS INTEGER)) AS f,
    TIMESTAMP '2024-01-10' + to_days(CAST(c_custkey % 3 AS INTEGER)) AS u FROM customer
  UNION ALL SELECT c_custkey, 'B', TIMESTAMP '2024-01-14' + to_days(CAST(c_custkey % 7 AS INTEGER)), NULL FROM customer)
SELECT user_id, job AS job_id, count(*) AS runs
FROM events LEFT JOIN b ON k = user_id AND ts >= f AND (u IS NULL OR ts < u) GROUP BY ALL""")
def binding_at_start(t):
    k = F.col("c_custkey")
    day = lambda d, m: time.plus_seconds(F.lit(d).cast("timestamp"), k % m * 86400)
    side = lambda job, f, u: t.customer.select(
        F.lit(1).alias("source_id"), i.text("U", k).alias("native_id"), F.lit(job).alias("job_id"),
        f.alias("bound_at"), u.alias("unbound_at"),
    )
    bindings = side("A", day("2024-01-01", 5), day("2024-01-10", 3)).unionByName(
        side("B", day("2024-01-14", 7), F.lit(None).cast("timestamp"))
    )
    started = t.events.select(
        F.lit(1).alias("source_id"), i.text("u", F.col("user_id")).alias("native_job_id"), "user_id",
        F.col("event_id").cast("string").alias("native_run_id"), i.utc("ts").alias("started_at"),
    )
    return catalog.bound_at_start(started, bindings).groupBy("user_id", "job_id").agg(F.count(F.lit(1)).alias("runs"))
