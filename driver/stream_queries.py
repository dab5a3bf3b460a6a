"""The same results from Structured Streaming: events arrive in pieces, results equal the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.health_queries import user_alert_events
from driver.registry import SQL, Tables, query
from opslake import session
from opslake.operators import runs
from opslake.streaming import state
from opslake.streaming.changes import ChangeLog, start


class Streamed(Tables):
    """Tables whose ``events`` come as a stream: ``pieces`` in event order, each as eight files of shuffled rows."""

    def __init__(self, t: Tables, pieces: int = 2):
        super().__init__(t.spark, t.sf_dir)
        self.root = session.scratch(t.spark, "stream")
        source = Tables(t.spark, t.sf_dir).events
        self.schema = source.schema
        # Files come in the order of their times; batches of five files do not end where pieces do.
        piece = F.floor(F.col("event_id") * pieces / (source.agg(F.max("event_id") + 1).scalar()))
        for n in range(pieces):
            source.filter(piece == n).repartition(8, F.xxhash64("event_id")).write.mode("append").parquet(f"{self.root}/in")

    @property
    def events(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 5).parquet(f"{self.root}/in")

    def run(self, updates, sink, mode="update"):
        start(updates, sink, f"{self.root}/checkpoint", mode).awaitTermination()


@query("stream_run_lifecycle", SQL["run_lifecycle"])
def stream_run_lifecycle(t):
    s = Streamed(t)
    merge = state.RunMerge(f"{s.root}/runs", ["source_id", "native_run_id"], ["job_id"])
    s.run(i.reports(s.events), merge, "append")
    rows = merge.rows(t.spark).drop("last_seq")
    return rows.withColumns({c: i.ts_text(c) for c in ("started_at", "ended_at")})


@query("stream_run_fold", SQL["run_fold"])
def stream_run_fold(t):
    s = Streamed(t)
    fold = state.HistoryFold(t.spark, f"{s.root}/fold")
    s.run(i.history(s.events), fold, "append")
    rows = runs.with_fingerprint(fold.rows(t.spark))
    return rows.withColumns({c: i.ts_text(c) for c in ("started_at", "ended_at")})


@query("stream_alerts", f"""SELECT upper(sha256('JobFailed|' || user_id)) AS dedup_key,
  CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'Firing' ELSE 'Resolved' END AS status,
  {i.ts_sql("min(ts) FILTER (event_type = 'error')")} AS first_seen, {i.ts_sql("max(ts) FILTER (event_type = 'error')")} AS last_occurrence,
  count(*) FILTER (event_type = 'error') AS occurrences
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > 0""")
def stream_alerts(t):
    s = Streamed(t)
    log = ChangeLog(f"{s.root}/alerts", ["dedup_key"])
    s.run(state.alert_updates(user_alert_events(s)), log.write)
    rows = log.latest(t.spark).drop("type")
    return rows.withColumns({c: i.ts_text(c) for c in ("first_seen", "last_occurrence")})


@query("stream_without_overlap", """SELECT event_type, count(*) AS reports, count(DISTINCT event_id) AS distinct_reports FROM events GROUP BY event_type""")
def stream_without_overlap(t):
    """Every third report is read twice, as by overlapping polls, and counts once."""
    s = Streamed(t)
    twice = s.events.withColumn("n", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    once = state.Once(f"{s.root}/once", ["event_id"])
    s.run(twice.select("event_id", "event_type"), once, "append")
    return once.log.read(t.spark).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("event_id").alias("distinct_reports")
    )
