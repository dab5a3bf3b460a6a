"""Causes: classes, trends, cones, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import query
from opslake import session
from opslake.functions import fingerprint, time
from opslake.functions.owner import parse_owner
from opslake.operators import signals
from opslake.plans import dependencies
from opslake.store import Store

MESSAGES = [
    "Could not find file '/landing/x.csv'", "Schema drift: column PolicyDate renamed", "Cannot insert the value NULL into column",
    "Login failed for user 'svc'", "The job is already running", "Upstream job load_members failed", "Object reference not set",
    "file mask AETNA does not match pattern", "the vendor file came late",
]
_CLASSES_SQL = """CASE k % 9 WHEN 0 THEN 'file missing' WHEN 1 THEN 'schema drift' WHEN 2 THEN 'data violation' WHEN 3 THEN 'connection-credential'
  WHEN 4 THEN 'schedule collision' WHEN 5 THEN 'upstream failed' WHEN 6 THEN 'code bug' WHEN 7 THEN 'filemask drift' ELSE 'file late' END"""


def failures(t):
    """Orders as failures of 50 feeds; the key decides the message."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("run_id"), F.col("o_custkey").alias("job_id"), i.text("F", F.col("o_custkey") % 50).alias("feed_name"),
        F.to_date("o_orderdate").alias("day"), time.plus_seconds(i.utc("o_orderdate"), k * 11 % 86400).alias("started_at"),
        i.pick(k % 9, MESSAGES).alias("error_text"),
    )


def arrival_log(t):
    return t.lineitem.select(
        i.text("F", F.col("l_suppkey") % 50).alias("feed_name"), F.to_date("l_shipdate").alias("day"),
        time.plus_seconds(i.utc("l_shipdate"), F.col("l_orderkey") * 13 % 86400).alias("arrived_at"),
    )


_FAILURES_SQL = f"""fail AS (SELECT o_orderkey AS k, o_custkey AS job_id, o_custkey % 50 AS f, o_orderdate AS d,
  o_orderdate + to_seconds(o_orderkey * 11 % 86400) AS s FROM orders),
log AS (SELECT l_suppkey % 50 AS f, l_shipdate AS d, count(*) AS n, max(l_shipdate + to_seconds(l_orderkey * 13 % 86400)) AS a FROM lineitem GROUP BY ALL),
textual AS (SELECT fail.*, coalesce(n, 0) AS n, a, {_CLASSES_SQL} AS c FROM fail LEFT JOIN log USING (f, d)),
classed AS (SELECT *, CASE WHEN c = 'file missing' AND a > s THEN 'file late' ELSE c END AS c1 FROM textual)"""


def classified(t):
    return signals.classify(signals.enrich_with_arrivals(failures(t), arrival_log(t)))


@query("classify", f"""WITH {_FAILURES_SQL}
SELECT k AS run_id, 'F' || f AS feed_name, n AS files_arrived,
  CASE WHEN c1 = 'code bug' AND job_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'upstream failed' ELSE c1 END AS class FROM classed""")
def classify(t):
    below = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    enriched = signals.enrich_with_arrivals(failures(t), arrival_log(t))
    return signals.classify(enriched, below).select("run_id", "feed_name", "files_arrived", "class")


@query("class_share", f"""WITH {_FAILURES_SQL},
n AS (SELECT strftime(d, '%Y-%m') AS month, c1 AS class, count(*) AS failures FROM classed GROUP BY ALL)
SELECT *, round(failures / sum(failures) OVER (PARTITION BY month), 6) AS share FROM n""")
def class_share(t):
    shares = signals.class_share(classified(t))
    return shares.select(F.date_format("month", "yyyy-MM").alias("month"), "class", "failures", F.round("share", 6).alias("share"))


@query("trend_top5", f"""WITH {_FAILURES_SQL},
n AS (SELECT strftime(d, '%Y-%m') AS month, 'F' || f AS feed_name, count(*) AS failures FROM classed WHERE c1 IN ('file missing', 'file late') GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY failures DESC, feed_name) AS place FROM n)
SELECT month, feed_name, failures, place FROM p WHERE place <= 5""")
def trend_top5(t):
    vendor = classified(t).filter(F.col("class").isin("file missing", "file late"))
    top = signals.top_offenders(vendor, 5)
    return top.select(F.date_format("month", "yyyy-MM").alias("month"), "feed_name", "failures", F.col("place").cast("bigint").alias("place"))


@query("downstream_cone", """WITH RECURSIVE edges AS (
  SELECT p_partkey AS u, 2 * p_partkey + 1 AS v FROM part WHERE 2 * p_partkey + 1 < (SELECT count(*) FROM part)
  UNION ALL SELECT p_partkey, 2 * p_partkey + 2 FROM part WHERE 2 * p_partkey + 2 < (SELECT count(*) FROM part)),
walk(job_id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 7
  UNION SELECT v, depth + 1 FROM walk JOIN edges ON u = job_id)
SELECT job_id, min(depth) AS depth FROM walk GROUP BY job_id""")
def downstream_cone(t):
    k = F.col("p_partkey")
    n = t.part.agg(F.count(F.lit(1)).alias("n")).scalar()
    child = F.explode(F.array(2 * k + 1, 2 * k + 2))
    edges = t.part.select(k.alias("upstream"), child.alias("downstream")).filter(F.col("downstream") < n)
    return signals.cone(edges, t.part.filter(F.col("p_size") == 7).select(k.alias("job_id")))


@query("downstream_stored", """WITH RECURSIVE edges AS (
  SELECT p_partkey AS u, 2 * p_partkey + 1 AS v FROM part WHERE 2 * p_partkey + 1 < (SELECT count(*) FROM part)
  UNION ALL SELECT p_partkey, 2 * p_partkey + 2 FROM part WHERE 2 * p_partkey + 2 < (SELECT count(*) FROM part)),
walk(job_id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 7
  UNION SELECT v, depth + 1 FROM walk JOIN edges ON u = job_id)
SELECT 'P' || job_id AS job_id, min(depth) AS depth FROM walk GROUP BY job_id""")
def downstream_stored(t):
    """The edges of the cone above declared in two batches, of which the later joins many pieces; the cone is a lookup."""
    store = Store(t.spark, session.scratch(t.spark, "store"))
    k, name = F.col("k"), lambda c: F.concat(F.lit("P"), c.cast("string"))
    n = t.part.agg(F.count(F.lit(1)).alias("n")).scalar()
    both = t.part.select("p_brand", F.col("p_partkey").alias("k")).withColumn("child", F.explode(F.array(2 * k + 1, 2 * k + 2)))
    edges = both.filter(F.col("child") < n).select("k", name(k).alias("upstream"), name(F.col("child")).alias("downstream"), F.col("p_brand").alias("declared_by"))
    dependencies.declare(store, edges.filter(k % 16 != 5), 1, "2026-01-01")
    dependencies.declare(store, edges, 2, "2026-01-02")
    failed = t.part.filter(F.col("p_size") == 7).select(name(F.col("p_partkey")).alias("job_id"))
    return dependencies.downstream_of(store, failed)


_KEEP = "chr(57344)"
_SHAPE = i.shape_sql(f"replace(text, 'ß', {_KEEP})")


@query("text_fingerprints", f"""SELECT upper(substr(sha256(replace({_SHAPE}, {_KEEP}, 'ß')), 1, 32)) AS fingerprint, count(*) AS texts, min(doc_id) AS first_doc
FROM documents GROUP BY 1""")
def text_fingerprints(t):
    """Whole documents grouped by what is left of them without dates, numbers and quoted text."""
    return t.documents.groupBy(fingerprint.fingerprint(F.col("text")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first_doc")
    )


@query("text_owners", f"""WITH found AS (SELECT lang, {i.owner_sql('text')} AS owner FROM documents UNION ALL SELECT role, {i.owner_sql('text')} FROM conversations)
SELECT lang, owner, count(*) AS texts FROM found GROUP BY ALL""")
def text_owners(t):
    both = t.documents.select("lang", "text").unionByName(t.conversations.select(F.col("role").alias("lang"), "text"))
    return both.select("lang", parse_owner(F.col("text"))["owner"].alias("owner")).groupBy("lang", "owner").agg(
        F.count(F.lit(1)).alias("texts")
    )
