"""Health checks and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import query
from driver.run_queries import folded
from opslake import vocab
from opslake.functions import time
from opslake.functions.fingerprint import dedup_key
from opslake.operators import alerts, health, scan, signals

_SYNCS_SQL = """span AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events),
users AS (SELECT DISTINCT user_id FROM events),
days AS (SELECT user_id AS source_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS h FROM span, users),
counted AS (SELECT user_id AS source_id, date_trunc('day', ts) AS h, count(*) AS n FROM events GROUP BY ALL),
syncs AS (SELECT source_id, h, source_id * 100000 + CAST(epoch(h) AS BIGINT) // 86400 AS sync_id,
  CASE WHEN (source_id + CAST(epoch(h) AS BIGINT) // 86400) % 13 = 0 THEN 'Failed' ELSE 'Completed' END AS status, coalesce(n, 0) AS n
  FROM days LEFT JOIN counted USING (source_id, h)),
closed AS (SELECT *, CASE WHEN status = 'Failed' THEN 0 ELSE n END AS job_count FROM syncs)"""


def syncs(t):
    """One sync per user and day; its job count is the number of events, 0 where there are none."""
    day = F.date_trunc("day", i.utc("ts"))
    counted = t.events.groupBy(F.col("user_id").alias("source_id"), day.alias("started_at")).agg(F.count(F.lit(1)).alias("n"))
    span = t.events.agg(F.sequence(F.min(day), F.max(day), F.expr("INTERVAL 1 DAY")).alias("days"))
    days = t.events.select(F.col("user_id").alias("source_id")).distinct().select(
        "source_id", F.explode(span.scalar()).alias("started_at")
    )
    number = F.floor(F.unix_seconds("started_at") / 86400)
    failed = (F.col("source_id") + number) % 13 == 0
    return days.join(counted, ["source_id", "started_at"], "left").select(
        "source_id", (F.col("source_id") * 100000 + number).alias("sync_id"), "started_at",
        F.when(failed, vocab.FAILED).otherwise(vocab.COMPLETED).alias("status"),
        F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("job_count"),
    )


@query("zero_rows", f"WITH {_SYNCS_SQL} SELECT source_id, sync_id FROM closed WHERE status = 'Completed' AND job_count = 0")
def zero_rows(t):
    return health.zero_rows(syncs(t)).select("source_id", "sync_id")


@query("sharp_drop", f"""WITH {_SYNCS_SQL},
compared AS (SELECT *, count(*) OVER w AS samples, avg(job_count) OVER w AS baseline FROM closed
  WHERE status = 'Completed' AND job_count > 0
  WINDOW w AS (PARTITION BY source_id ORDER BY h ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT source_id, sync_id, job_count, samples, round(baseline, 4) AS baseline FROM compared
WHERE samples >= 3 AND job_count < baseline * 0.5""")
def sharp_drop(t):
    found = health.sharp_drop(syncs(t), scan.time_chunk("started_at", 8 * 86400))
    return found.select("source_id", "sync_id", "job_count", "samples", F.round("baseline", 4).alias("baseline"))


@query("purge_gap", """WITH marks AS (SELECT user_id, coalesce(max(event_id) FILTER (day(ts) < 10 + user_id % 15) + 1, 0) AS since FROM events GROUP BY user_id),
kept AS (SELECT user_id, min(event_id + 1) AS oldest FROM events WHERE day(ts) >= 20 GROUP BY user_id)
SELECT user_id AS source_id, oldest, since, oldest - since - 1 AS missed FROM kept JOIN marks USING (user_id)
WHERE since <> 0 AND oldest > since + 1""")
def purge_gap(t):
    e = t.events.select(F.col("user_id").alias("source_id"), (F.col("event_id") + 1).alias("instance_id"), F.dayofmonth("ts").alias("d"))
    read = F.max(F.when(F.col("d") < 10 + F.col("source_id") % 15, F.col("instance_id")))
    marks = e.groupBy("source_id").agg(F.coalesce(read, F.lit(0)).alias("since"))
    return health.purge_gap(e.filter("d >= 20"), marks)


@query("stale_sources", f"""WITH beats AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY user_id)
SELECT c_custkey AS source_id, {i.ts_sql('beat')} AS last_heartbeat,
  beat IS NULL OR beat < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR AS stale
FROM customer LEFT JOIN beats ON user_id = c_custkey""")
def stale_sources(t):
    beats = health.last_heartbeats(t.events.select(F.col("user_id").alias("source_id"), i.utc("ts").alias("at")))
    sources = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name")).join(beats, "source_id", "left")
    swept = health.stale_sources(sources, F.lit("2024-01-30 12:00:00").cast("timestamp"), 6 * 3600)
    return swept.select("source_id", i.ts_text("last_heartbeat").alias("last_heartbeat"), "stale")


def user_alert_events(t):
    kind = F.col("event_type")
    return t.events.filter(kind.isin("error", "purchase")).select(
        dedup_key(F.lit(vocab.JOB_FAILED), F.col("user_id")).alias("dedup_key"), F.lit(vocab.JOB_FAILED).alias("type"),
        F.when(kind == "error", alerts.RAISE).otherwise(alerts.RESOLVE).alias("kind"), i.utc("ts").alias("at"),
        F.col("event_id").alias("seq"), i.text("job ", F.col("user_id")).alias("message"),
    )


def stored_alerts(t):
    k = F.col("c_custkey")
    old = F.lit("2023-12-01").cast("timestamp")
    return t.customer.filter(F.col("c_acctbal") < 2500).select(
        dedup_key(F.lit(vocab.JOB_FAILED), k).alias("dedup_key"), F.lit(vocab.JOB_FAILED).alias("type"),
        i.pick(k % 3, [vocab.FIRING, vocab.ACKNOWLEDGED, vocab.RESOLVED]).alias("status"),
        F.lit(None).cast("string").alias("routed_to"), F.lit("old").alias("message"), old.alias("first_seen"),
        old.alias("last_occurrence"), (k % 5 + 1).alias("occurrences"), F.lit(None).cast("string").alias("acked_by"),
        F.lit(None).cast("timestamp").alias("acked_at"),
    )


_ALERTS_SQL = """ev AS (SELECT 'JobFailed|' || user_id AS k, arg_max(event_type, event_id) AS last_kind,
  count(*) FILTER (event_type = 'error') AS raises, min(ts) FILTER (event_type = 'error') AS a, max(ts) FILTER (event_type = 'error') AS b
  FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id),
st AS (SELECT 'JobFailed|' || c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Firing' WHEN 1 THEN 'Acknowledged' ELSE 'Resolved' END AS status,
  TIMESTAMP '2023-12-01' AS old, c_custkey % 5 + 1 AS n FROM customer WHERE c_acctbal < 2500),
merged AS (SELECT coalesce(st.k, ev.k) AS k, CASE WHEN last_kind = 'error' THEN 'Firing'
    WHEN last_kind = 'purchase' AND (raises > 0 OR status = 'Firing') THEN 'Resolved' ELSE status END AS status,
  coalesce(old, a) AS first_seen, coalesce(b, old) AS last_occurrence, coalesce(n, 0) + coalesce(raises, 0) AS occurrences
  FROM st FULL JOIN ev ON ev.k = st.k WHERE st.k IS NOT NULL OR raises > 0)"""


@query("alert_state", f"""WITH {_ALERTS_SQL}
SELECT upper(sha256(k)) AS dedup_key, status, {i.ts_sql('first_seen')} AS first_seen, {i.ts_sql('last_occurrence')} AS last_occurrence,
  CAST(occurrences AS BIGINT) AS occurrences FROM merged""")
def alert_state(t):
    merged = alerts.merge(stored_alerts(t), user_alert_events(t))
    return merged.select(
        "dedup_key", "status", i.ts_text("first_seen").alias("first_seen"),
        i.ts_text("last_occurrence").alias("last_occurrence"), "occurrences",
    )


@query("alert_acknowledge", f"""WITH {_ALERTS_SQL},
acks AS (SELECT 'JobFailed|' || user_id AS k, arg_min({{'w': 'op' || (event_id % 3), 't': ts}}, ts) AS a FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT upper(sha256(merged.k)) AS dedup_key, CASE WHEN status = 'Firing' AND a IS NOT NULL THEN 'Acknowledged' ELSE status END AS status,
  CASE WHEN status = 'Firing' THEN a.w END AS acked_by, CASE WHEN status = 'Firing' THEN {i.ts_sql('a.t')} END AS acked_at
FROM merged LEFT JOIN acks ON acks.k = merged.k""")
def alert_acknowledge(t):
    acks = t.events.filter("event_type = 'signup'").select(
        dedup_key(F.lit(vocab.JOB_FAILED), F.col("user_id")).alias("dedup_key"),
        i.text("op", F.col("event_id") % 3).alias("acked_by"), i.utc("ts").alias("acked_at"),
    )
    merged = alerts.acknowledge(alerts.merge(stored_alerts(t), user_alert_events(t)), acks)
    return merged.select("dedup_key", "status", "acked_by", i.ts_text("acked_at").alias("acked_at"))


@query("failure_alerts", f"""WITH {i.HISTORY_SQL}
SELECT upper(sha256('JobFailed|' || fingerprint)) AS dedup_key, 'Firing' AS status, {i.shape_sql('min(error_text)')} AS message,
  {i.ts_sql('min(ended_at)')} AS first_seen, {i.ts_sql('max(ended_at)')} AS last_occurrence, count(*) AS occurrences
FROM runs WHERE fingerprint IS NOT NULL GROUP BY fingerprint""")
def failure_alerts(t):
    raised = signals.failure_events(folded(t), F.col("instance_id"))
    none = t.spark.createDataFrame([], alerts.empty_state_schema())
    return alerts.merge(none, raised).select(
        "dedup_key", "status", "message", i.ts_text("first_seen").alias("first_seen"),
        i.ts_text("last_occurrence").alias("last_occurrence"), "occurrences",
    )


@query("detection_time", f"""WITH {i.HISTORY_SQL},
g AS (SELECT fingerprint, min(ended_at) AS e FROM runs WHERE fingerprint IS NOT NULL GROUP BY fingerprint)
SELECT upper(sha256('JobFailed|' || fingerprint)) AS dedup_key,
  CAST(epoch(date_trunc('hour', e) + INTERVAL 1 HOUR) - epoch(e) AS BIGINT) AS detect_seconds FROM g""")
def detection_time(t):
    """Alerts are raised by the poll on the next full hour."""
    done = folded(t)
    next_poll = time.plus_seconds(F.date_trunc("hour", "at"), F.lit(3600))
    raised = signals.failure_events(done, F.col("instance_id")).withColumn("at", next_poll)
    none = t.spark.createDataFrame([], alerts.empty_state_schema())
    return signals.detection_time(alerts.merge(none, raised), done).select("dedup_key", "detect_seconds")


@query("detection_summary", f"""WITH {i.HISTORY_SQL},
g AS (SELECT fingerprint, min(ended_at) AS e, arg_min(CAST(substr(native_job_id, 5) AS INTEGER) % 10, {{'e': ended_at, 's': CAST(substr(native_job_id, 5) AS INTEGER) % 10}}) AS source_id
  FROM runs WHERE fingerprint IS NOT NULL GROUP BY fingerprint),
d AS (SELECT source_id, date_trunc('hour', e) + INTERVAL 1 HOUR AS seen, epoch(date_trunc('hour', e) + INTERVAL 1 HOUR) - epoch(e) AS lag FROM g)
SELECT CAST(source_id AS INTEGER) AS source_id, strftime(date_trunc('month', seen), '%Y-%m') AS month, count(*) AS alerts,
  round(avg(lag), 3) AS mean_seconds, round(quantile_cont(lag, 0.5), 3) AS median_seconds, round(quantile_cont(lag, 0.95), 3) AS p95_seconds
FROM d GROUP BY ALL""")
def detection_summary(t):
    """The same alerts by source (a number in the job's name) and month."""
    done = folded(t).withColumn("source_id", (F.substring("native_job_id", 5, 20).cast("int") % 10))
    next_poll = time.plus_seconds(F.date_trunc("hour", "at"), F.lit(3600))
    raised = signals.failure_events(done, F.col("instance_id")).withColumn("at", next_poll)
    none = t.spark.createDataFrame([], alerts.empty_state_schema())
    found = signals.detection_summary(alerts.merge(none, raised), done)
    three = lambda c: F.round(c, 3).alias(c)
    return found.select("source_id", F.date_format("month", "yyyy-MM").alias("month"), "alerts", three("mean_seconds"), three("median_seconds"), three("p95_seconds"))


@query("sync_log", f"""WITH ev AS (SELECT event_id // 2 AS sync_id, event_id % 2 AS closing, ts, event_type, user_id, event_id FROM events
  WHERE event_id % 2 = 0 OR event_type <> 'view')
SELECT sync_id, {i.ts_sql('min(ts) FILTER (closing = 0)')} AS started_at, {i.ts_sql('min(ts) FILTER (closing = 1)')} AS completed_at,
  CASE WHEN max(closing) = 0 THEN 'Running' WHEN max(event_type) FILTER (closing = 1) = 'error' THEN 'Failed' ELSE 'Completed' END AS status,
  CAST(coalesce(max(user_id) FILTER (closing = 1 AND event_type <> 'error'), 0) AS BIGINT) AS job_count,
  max('source said no') FILTER (closing = 1 AND event_type = 'error') AS error_text FROM ev GROUP BY sync_id""")
def sync_log(t):
    e, kind = F.col("event_id"), F.col("event_type")
    failed = kind == "error"
    events = t.events.filter((e % 2 == 0) | (kind != "view")).select(
        F.floor(e / 2).alias("sync_id"), F.lit(1).alias("source_id"),
        F.when(e % 2 == 0, "open").otherwise("close").alias("kind"), i.utc("ts").alias("at"),
        F.when(failed, vocab.FAILED).otherwise(vocab.COMPLETED).alias("status"),
        F.when(failed, 0).otherwise(F.col("user_id")).alias("job_count"), F.lit(0).alias("unowned_count"),
        F.when(failed, "source said no").alias("error_text"),
    )
    log = health.sync_log(events)
    return log.select(
        "sync_id", i.ts_text("started_at").alias("started_at"), i.ts_text("completed_at").alias("completed_at"), "status",
        "job_count", "error_text",
    )
