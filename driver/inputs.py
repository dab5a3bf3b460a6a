"""Scheduler data derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an error text holds that differs from run to run
VOLATILE_SQL = (
    r"\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2}|0x[0-9a-fA-F]+|\b\d+(?:\.\d+)?[a-zA-Z]{0,2}\b"
    r"""|''[^'']*''|"[^"]*\""""
)


def shape_sql(x: str) -> str:
    return f"upper(trim(regexp_replace(regexp_replace({x}, '{VOLATILE_SQL}', '', 'g'), '\\s+', ' ', 'g')))"


def fingerprint_sql(x: str) -> str:
    return f"upper(substr(sha256({shape_sql(x)}), 1, 32))"


def ts_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def ts_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def utc(c: str) -> Column:
    return F.col(c).cast("timestamp")


def text(*parts: Column | str) -> Column:
    """Concatenation; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(value: Column, options: list) -> Column:
    """The option with the number of ``value``; the last one stands for the rest."""
    result = options[-1] if isinstance(options[-1], Column) else F.lit(options[-1])
    for i, option in reversed(list(enumerate(options[:-1]))):
        result = F.when(value == i, option if isinstance(option, Column) else F.lit(option)).otherwise(result)
    return result


SUBJECTS = ["eligibility", "claims", "members", "providers"]
SUBJECT_SQL = "CASE user_id % 4 WHEN 0 THEN 'eligibility' WHEN 1 THEN 'claims' WHEN 2 THEN 'members' ELSE 'providers' END"


def history(events: DataFrame) -> DataFrame:
    """Events as agent history: views and clicks are step rows, a click is a failed step."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    outcome = ~kind.isin("view", "click")
    step_text = F.when(e % 17 != 0, text(
        "Could not find file '/landing/feed_", u % 7, "_", F.date_format("ts", "yyyyMMdd"), ".csv' at ",
        ts_text("ts"), " while loading ", pick(u % 4, SUBJECTS), " (code ", e % 13, ")",
    ))
    job_text = text("The job failed.  Step ", e % 9, " of Table", u % 5, " took ", e % 100, "s")
    return events.select(
        (e + 1).alias("instance_id"),
        text("job-", u).alias("job_id"),
        F.when(kind == "view", 1).when(kind == "click", 2).otherwise(0).alias("step_id"),
        F.lit("step").alias("step_name"),
        F.when(kind.isin("click", "error"), 0).when(kind == "signup", 3).otherwise(1).alias("run_status"),
        F.when(outcome & (e % 50 == 0), 0).otherwise(F.date_format("ts", "yyyyMMdd").cast("int")).alias("run_date"),
        F.date_format("ts", "HHmmss").cast("int").alias("run_time"),
        ((e % 3) * 10000 + (e % 60) * 100 + e % 59).cast("int").alias("run_duration"),
        F.when(kind == "click", step_text).when(outcome, job_text).alias("message"),
    )


HISTORY_SQL = f"""
hist AS (
  SELECT event_id + 1 AS instance_id, 'job-' || user_id AS job_id,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS step_id,
    CASE WHEN event_type IN ('click', 'error') THEN 0 WHEN event_type = 'signup' THEN 3 ELSE 1 END AS run_status,
    CASE WHEN event_type NOT IN ('view', 'click') AND event_id % 50 = 0 THEN 0
         ELSE CAST(strftime(ts, '%Y%m%d') AS INTEGER) END AS run_date,
    date_trunc('second', ts) AS local_start,
    (event_id % 3) * 3600 + (event_id % 60) * 60 + event_id % 59 AS seconds,
    CASE WHEN event_type = 'click' AND event_id % 17 = 0 THEN NULL
         WHEN event_type = 'click' THEN 'Could not find file ''/landing/feed_' || (user_id % 7) || '_'
           || strftime(ts, '%Y%m%d') || '.csv'' at ' || {ts_sql('ts')} || ' while loading ' || {SUBJECT_SQL}
           || ' (code ' || (event_id % 13) || ')'
         WHEN event_type <> 'view' THEN 'The job failed.  Step ' || (event_id % 9) || ' of Table' || (user_id % 5)
           || ' took ' || (event_id % 100) || 's' END AS message
  FROM events),
marked AS (
  SELECT *, coalesce(sum(CASE WHEN step_id = 0 AND run_date > 0 THEN 1 ELSE 0 END) OVER (
      PARTITION BY job_id ORDER BY instance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch
  FROM hist),
steps AS (
  SELECT job_id, epoch, arg_max({{'m': message}}, instance_id) AS s
  FROM marked WHERE step_id <> 0 AND run_status = 0 GROUP BY ALL),
folded AS (
  SELECT o.instance_id, o.job_id AS native_job_id,
    o.job_id || ':' || strftime(o.local_start, '%Y%m%d%H%M%S') AS native_run_id,
    o.local_start AS started_at, o.local_start + to_seconds(o.seconds) AS ended_at,
    CASE o.run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' ELSE 'Cancelled' END AS status,
    CASE WHEN o.run_status = 0 THEN coalesce(s.s.m, o.message) END AS error_text
  FROM marked o LEFT JOIN steps s ON s.job_id = o.job_id AND s.epoch = o.epoch
  WHERE o.step_id = 0 AND o.run_date > 0),
runs AS (
  SELECT *, CASE WHEN status = 'Failed' THEN {fingerprint_sql('error_text')} END AS fingerprint FROM folded)
"""


def reports(events: DataFrame) -> DataFrame:
    """Events of a user and day as the reports of one run."""
    e, kind = F.col("event_id"), F.col("event_type")
    terminal = kind.isin("error", "purchase", "signup")
    return events.select(
        (F.col("user_id") % 10).alias("source_id"),
        text("run-", F.col("user_id"), "-", F.date_format("ts", "yyyyMMdd")).alias("native_run_id"),
        F.col("user_id").alias("job_id"),
        utc("ts").alias("started_at"),
        F.when((terminal & (e % 4 != 0)) | ((kind == "click") & (e % 11 == 0)), utc("ts")).alias("ended_at"),
        F.when(kind == "view", "Queued").when(kind == "click", "Running").when(kind == "error", "Failed")
        .when(kind == "purchase", "Succeeded").otherwise("Cancelled").alias("status"),
        F.when(kind == "error", text("Login failed for user 'svc", e % 5, "' after ", e % 90, "s on Server", e % 3)).alias("error_text"),
        e.alias("seq"),
    )


REPORTS_SQL = """
reports AS (
  SELECT user_id % 10 AS source_id, 'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS native_run_id,
    user_id AS job_id, ts AS started_at,
    CASE WHEN (event_type IN ('error', 'purchase', 'signup') AND event_id % 4 <> 0)
           OR (event_type = 'click' AND event_id % 11 = 0) THEN ts END AS ended_at,
    CASE event_type WHEN 'view' THEN 'Queued' WHEN 'click' THEN 'Running' WHEN 'error' THEN 'Failed'
      WHEN 'purchase' THEN 'Succeeded' ELSE 'Cancelled' END AS status,
    CASE WHEN event_type = 'error' THEN 'Login failed for user ''svc' || (event_id % 5) || ''' after '
      || (event_id % 90) || 's on Server' || (event_id % 3) END AS error_text,
    event_id AS seq,
    event_type IN ('error', 'purchase', 'signup') AS terminal
  FROM events)
"""
LIFECYCLE_SQL = REPORTS_SQL + f""",
grouped AS (
  SELECT source_id, native_run_id, arg_min({{'j': job_id, 's': started_at, 'e': ended_at, 't': status, 'x': error_text}}, seq) AS f,
    arg_min({{'s': started_at, 'e': ended_at, 't': status, 'x': error_text}}, seq) FILTER (terminal AND ended_at IS NOT NULL) AS c,
    arg_max({{'s': started_at, 'e': ended_at, 't': status, 'x': error_text}}, seq) FILTER (terminal) AS l,
    count(*) AS reports
  FROM reports GROUP BY ALL),
chosen AS (
  SELECT source_id, native_run_id, f.j AS job_id, reports,
    CASE WHEN f.e IS NOT NULL THEN {{'s': f.s, 'e': f.e, 't': f.t, 'x': f.x}}
         ELSE coalesce(c, l, {{'s': f.s, 'e': f.e, 't': f.t, 'x': f.x}}) END AS r
  FROM grouped),
lifecycle AS (
  SELECT source_id, native_run_id, job_id, r.s AS started_at, r.e AS ended_at, r.t AS status, r.x AS error_text,
    CASE WHEN r.t = 'Failed' AND r.x IS NOT NULL THEN {fingerprint_sql('r.x')} END AS fingerprint, reports
  FROM chosen)
"""


def describe(c: DataFrame) -> DataFrame:
    """Customers as jobs whose descriptions, tags and declared owners come in many forms."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    low = F.lower(seg)
    description = pick(k % 9, [
        text("Owner: ", seg, " Team; Ticket: DE-", k), text("Nightly load. Ticket: DE-", k, ". See wiki"),
        text("Loads files #", low, " nightly"), text("team=", low, "-ops"), text("See #", k, " for details"),
        F.lit("No description available."), text("mail someone", k, "@example.com"),
        text("Owner: ETL #nightly ", k), text("Steam: engine ", k),
    ])
    tags = F.when(k % 2 == 0, F.array(F.lit("prod"), text("team:", low))).otherwise(F.array(F.lit("v2")))
    return c.select(
        F.col("c_nationkey").alias("source_id"), k.alias("job_id"), text("job-", k).alias("native_id"),
        F.col("c_name").alias("native_name"), description.alias("description"),
        (k % 5 != 0).alias("is_active"),
        F.when(k % 20 == 3, F.lit(" Finance ")).alias("declared_owner"), tags.alias("tags"),
        (k % 4).alias("sync_id"),
    )


_OWNER_RE = r"(?i)\b(?:owner|team)\s*[:=]\s*([^;,\r\n#@]+?)\s*(?:[;,#@\r\n]|\.\s|\.?$)"
_TICKET_RE = r"(?i)\bticket\s*[:=]\s*([^;,\r\n#@]+?)\s*(?:[;,#@\r\n]|\.\s|\.?$)"
_MENTION_RE = r"(?:^|\W)[#@]([A-Za-z][\w-]*)"


def owner_sql(x: str) -> str:
    clean = lambda v: f"trim(rtrim(trim({v}), '.,'))"
    return f"""CASE WHEN regexp_matches({x}, '{_OWNER_RE}') THEN {clean(f"regexp_extract({x}, '{_OWNER_RE}', 1)")}
      WHEN regexp_matches({x}, '{_TICKET_RE}') THEN {clean(f"regexp_extract({x}, '{_TICKET_RE}', 1)")}
      WHEN regexp_matches({x}, '{_MENTION_RE}') THEN regexp_extract({x}, '{_MENTION_RE}', 1) END"""


OWNERSHIP_SQL = f"""
described AS (
  SELECT c_nationkey AS source_id, c_custkey AS job_id, c_custkey % 4 AS sync_id,
    CASE WHEN c_custkey % 20 = 3 THEN ' Finance ' END AS declared,
    CASE c_custkey % 9 WHEN 0 THEN 'Owner: ' || c_mktsegment || ' Team; Ticket: DE-' || c_custkey
      WHEN 1 THEN 'Nightly load. Ticket: DE-' || c_custkey || '. See wiki'
      WHEN 2 THEN 'Loads files #' || lower(c_mktsegment) || ' nightly' WHEN 3 THEN 'team=' || lower(c_mktsegment) || '-ops'
      WHEN 4 THEN 'See #' || c_custkey || ' for details' WHEN 5 THEN ''
      WHEN 6 THEN 'mail someone' || c_custkey || '@example.com' WHEN 7 THEN 'Owner: ETL #nightly ' || c_custkey
      ELSE 'Steam: engine ' || c_custkey END AS evidence,
    CASE WHEN c_custkey % 2 = 0 THEN 'team:' || lower(c_mktsegment) END AS tag
  FROM customer),
parsed AS (SELECT *, {owner_sql('evidence')} AS d, {owner_sql('tag')} AS t,
    regexp_matches(evidence, '{_OWNER_RE}') AS by_owner, regexp_matches(evidence, '{_TICKET_RE}') AS by_ticket FROM described),
ownership AS (
  SELECT source_id, job_id, sync_id,
    CASE WHEN declared IS NOT NULL THEN trim(declared) ELSE coalesce(d, t) END AS team_id,
    CASE WHEN declared IS NOT NULL THEN 'Owner' WHEN d IS NOT NULL AND by_ticket AND NOT by_owner THEN 'Ticket'
      WHEN d IS NOT NULL THEN 'Description' WHEN t IS NOT NULL THEN 'Tags' ELSE 'None' END AS parsed_from,
    CASE WHEN declared IS NOT NULL THEN declared WHEN d IS NOT NULL THEN evidence WHEN t IS NOT NULL THEN tag
      ELSE evidence END AS raw_evidence
  FROM parsed)
"""
