"""Catalogue: ownership, job merge, sources, routing, rebinding."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import query
from opslake import vocab
from opslake.functions import time
from opslake.operators import catalog, health, invariants, scan
from opslake.sources import scheduler


def ownership(t):
    return catalog.with_ownership(i.describe(t.customer)).select(
        "source_id", "job_id", "sync_id", "team_id", "parsed_from", "raw_evidence"
    )


@query("owner_parse", f"WITH {i.OWNERSHIP_SQL} SELECT job_id, team_id, parsed_from, raw_evidence FROM ownership")
def owner_parse(t):
    return ownership(t).drop("source_id", "sync_id")


@query("ownership_counts", f"""WITH {i.OWNERSHIP_SQL}
SELECT source_id, count(*) AS jobs, count(*) FILTER (team_id IS NULL) AS unowned FROM ownership GROUP BY source_id""")
def ownership_counts(t):
    return catalog.ownership_counts(ownership(t), ["source_id"])


@query("unowned_gap", f"""WITH {i.OWNERSHIP_SQL},
syncs AS (SELECT DISTINCT source_id, sync_id FROM ownership WHERE (source_id + sync_id) % 3 <> 0),
latest AS (SELECT source_id, max(sync_id) AS sync_id FROM syncs GROUP BY source_id)
SELECT source_id, sync_id, job_id, parsed_from FROM ownership JOIN latest USING (source_id, sync_id) WHERE team_id IS NULL""")
def unowned_gap(t):
    owned = ownership(t)
    syncs = owned.select("source_id", "sync_id").distinct().select(
        "source_id", "sync_id", time.plus_seconds(F.lit("2024-01-01").cast("timestamp"), F.col("sync_id")).alias("started_at"),
        F.when((F.col("source_id") + F.col("sync_id")) % 3 != 0, vocab.COMPLETED).otherwise(vocab.FAILED).alias("status"),
    )
    return catalog.gap_list(owned, syncs).select("source_id", "sync_id", "job_id", "parsed_from")


@query("ownership_replay", f"""WITH {i.OWNERSHIP_SQL},
old AS (SELECT *, CASE WHEN job_id % 6 = 0 THEN 'LEGACY' ELSE team_id END AS team FROM ownership)
SELECT parsed_from, CAST(count(*) FILTER (
    (CASE WHEN parsed_from = 'Owner' THEN team ELSE team_id END) IS DISTINCT FROM team) AS BIGINT) AS changed, count(*) AS jobs
FROM old GROUP BY parsed_from""")
def ownership_replay(t):
    old = ownership(t).withColumn("team_id", F.when(F.col("job_id") % 6 == 0, "LEGACY").otherwise(F.col("team_id")))
    return catalog.replay_ownership(old).groupBy("parsed_from").agg(
        F.count_if("changed").alias("changed"), F.count(F.lit(1)).alias("jobs")
    )


_TEAMS_SQL = """teams AS (SELECT o_custkey AS job_id, o_orderkey AS sync_id,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS team_id FROM orders)"""


def teams(t):
    p = F.col("o_orderpriority")
    return t.orders.select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("sync_id"),
        F.when(p != "4-NOT SPECIFIED", p).alias("team_id"), F.lit(vocab.FROM_TAGS).alias("parsed_from"),
    )


@query("ownership_history", f"""WITH {_TEAMS_SQL},
lagged AS (SELECT *, lag(team_id) OVER w AS previous_team, row_number() OVER w AS n
  FROM teams WINDOW w AS (PARTITION BY job_id ORDER BY sync_id))
SELECT job_id, sync_id, team_id, previous_team FROM lagged WHERE n = 1 OR team_id IS DISTINCT FROM previous_team""")
def ownership_history(t):
    return catalog.ownership_changes(teams(t), scan.id_chunk("sync_id")).drop("parsed_from")


@query("current_ownership", f"""WITH {_TEAMS_SQL}
SELECT job_id, arg_max({{'t': team_id}}, sync_id).t AS team_id, 'Tags' AS parsed_from, max(sync_id) AS sync_id
FROM teams GROUP BY job_id""")
def current_ownership(t):
    return catalog.current_ownership(teams(t))


@query("job_merge", """WITH known AS (SELECT c_nationkey AS source_id, 'Job-' || c_custkey AS native_id, 'J' || c_custkey AS job_id,
    c_name AS name, true AS is_active, '2024-01-01' AS first_seen FROM customer WHERE c_mktsegment <> 'FURNITURE'),
batch AS (SELECT c_nationkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN 'JOB-' ELSE 'job-' END || c_custkey AS native_id,
    CASE WHEN c_custkey % 3 = 0 THEN 'again ' || c_custkey WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS name,
    c_custkey % 7 <> 0 AS is_active
  FROM customer WHERE c_acctbal > 500)
SELECT coalesce(k.source_id, b.source_id) AS source_id, coalesce(k.native_id, b.native_id) AS native_id,
  k.job_id, k.job_id IS NULL AS minted, CASE WHEN b.native_id IS NULL THEN k.name ELSE b.name END AS name,
  CASE WHEN b.native_id IS NULL THEN k.is_active ELSE b.is_active END AS is_active,
  coalesce(k.first_seen, '2024-02-01') AS first_seen, CASE WHEN b.native_id IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS last_seen
FROM known k FULL JOIN batch b ON b.source_id = k.source_id AND lower(k.native_id) = lower(b.native_id)""")
def job_merge(t):
    k = F.col("c_custkey")
    old = F.lit("2024-01-01").cast("timestamp")
    known = t.customer.filter(F.col("c_mktsegment") != "FURNITURE").select(
        F.col("c_nationkey").alias("source_id"), i.text("Job-", k).alias("native_id"), i.text("J", k).alias("job_id"),
        F.col("c_name").alias("name"), F.lit(True).alias("is_active"), old.alias("first_seen"), old.alias("last_seen"),
        old.alias("bound_at"),
    )
    batch = t.customer.filter(F.col("c_acctbal") > 500).select(
        F.col("c_nationkey").alias("source_id"), i.text("job-", k).alias("native_id"),
        F.when(k % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("native_name"),
        (k % 7 != 0).alias("is_active"), F.lit(1).alias("place"),
    )
    # the same ids in other letters, some listed before and some after
    again = batch.withColumns({
        "native_id": F.upper("native_id"), "native_name": F.concat(F.lit("again "), F.substring("native_id", 5, 20)),
        "place": F.when(F.substring("native_id", 5, 20).cast("bigint") % 3 == 0, 2).otherwise(0),
    })
    batch = batch.unionByName(again)
    merged = catalog.merge_jobs(known, batch, F.lit("2024-02-01").cast("timestamp"))
    minted = F.col("job_id").rlike(r"\A[0-9A-HJKMNP-TV-Z]{26}\z")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return merged.select(
        "source_id", "native_id", F.when(~minted, F.col("job_id")).alias("job_id"), minted.alias("minted"), "name",
        "is_active", day("first_seen"), day("last_seen"),
    )


@query("register_sources", """WITH known AS (SELECT s_suppkey + 1 AS source_id, s_name AS name FROM supplier WHERE s_acctbal <= 4000),
fresh AS (SELECT s_name AS name, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN 'Airflow' ELSE 'SQLAgent' END, s_name) AS n
  FROM supplier WHERE s_acctbal > 4000)
SELECT CAST(source_id AS INTEGER) AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Airflow' ELSE 'SQLAgent' END AS type, s_name AS name,
  'db' || s_nationkey AS config FROM supplier JOIN known ON name = s_name
UNION ALL SELECT CAST((SELECT max(source_id) FROM known) + n AS INTEGER), CASE WHEN s_suppkey % 3 = 0 THEN 'Airflow' ELSE 'SQLAgent' END,
  s_name, 'db' || s_nationkey FROM supplier JOIN fresh ON name = s_name""")
def register_sources(t):
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "Airflow").otherwise("SQLAgent")
    known = t.supplier.filter(F.col("s_acctbal") <= 4000).select(
        (k + 1).cast("int").alias("source_id"), kind.alias("type"), F.col("s_name").alias("name"), F.lit("old").alias("config")
    )
    wanted = t.supplier.select(kind.alias("type"), F.col("s_name").alias("name"), i.text("db", F.col("s_nationkey")).alias("config"))
    return catalog.register_sources(known, wanted)


@query("rebind", """WITH b AS (SELECT 'J' || c_custkey AS job_id, c_nationkey AS source_id, 'n' || c_custkey AS native_id,
    c_custkey, c_mktsegment, '2024-01-01' AS bound_at FROM customer)
SELECT job_id, source_id, native_id, bound_at, CASE WHEN c_mktsegment = 'BUILDING' THEN '2024-03-01' END AS unbound_at FROM b
UNION ALL SELECT job_id, 99, 'dag_' || c_custkey, '2024-03-01', NULL FROM b WHERE c_mktsegment = 'BUILDING'""")
def rebind(t):
    k = F.col("c_custkey")
    bindings = t.customer.select(
        i.text("J", k).alias("job_id"), F.col("c_nationkey").alias("source_id"), i.text("n", k).alias("native_id"),
        F.col("c_name").alias("native_name"), F.lit("2024-01-01").cast("timestamp").alias("bound_at"),
        F.lit(None).cast("timestamp").alias("unbound_at"),
    )
    commands = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(
        i.text("J", k).alias("job_id"), F.lit(99).alias("source_id"), i.text("dag_", k).alias("native_id"),
        F.col("c_name").alias("native_name"), F.lit("2024-03-01").cast("timestamp").alias("at"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return catalog.rebind(bindings, commands).select("job_id", "source_id", "native_id", day("bound_at"), day("unbound_at"))


@query("alert_routing", f"""WITH {i.OWNERSHIP_SQL},
raised AS (SELECT user_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'N' || (user_id % 30) END AS feed_name FROM events WHERE event_type = 'error')
SELECT coalesce(o.team_id, CASE WHEN raised.feed_name = 'N' || n_nationkey THEN n_name END) AS routed_to, count(*) AS alerts
FROM raised LEFT JOIN ownership o USING (job_id) LEFT JOIN nation ON raised.feed_name = 'N' || n_nationkey GROUP BY ALL""")
def alert_routing(t):
    u = F.col("user_id")
    raised = t.events.filter("event_type = 'error'").select(
        u.alias("job_id"), F.when(F.col("event_id") % 3 == 0, i.text("N", u % 30)).alias("feed_name")
    )
    feeds = t.nation.select(i.text("N", F.col("n_nationkey")).alias("feed_name"), F.col("n_name").alias("team_id"))
    return catalog.route(raised, ownership(t), feeds).groupBy("routed_to").agg(F.count(F.lit(1)).alias("alerts"))


@query("data_age", f"""WITH beats AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY user_id)
SELECT c_custkey AS source_id, c_mktsegment AS segment, {i.ts_sql('beat')} AS as_of FROM customer LEFT JOIN beats ON user_id = c_custkey""")
def data_age(t):
    beats = health.last_heartbeats(t.events.select(F.col("user_id").alias("source_id"), F.col("ts").alias("at")))
    view = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("segment"))
    return health.as_of(view, beats).withColumn("as_of", i.ts_text("as_of"))


_DAG_SQL = """dags AS (SELECT 'dag_' || c_custkey AS dag_id, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS display, c_custkey AS k,
  CASE c_custkey % 5 WHEN 0 THEN ['airflow'] WHEN 1 THEN [' ' || lower(c_mktsegment) || ' ', 'Airflow', 'ops'] WHEN 2 THEN ['', 'data-eng']
    WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE NULL END AS owners, c_nationkey FROM customer)"""


def dags(t):
    k = F.col("c_custkey")
    owners = (
        F.when(k % 5 == 0, F.array(F.lit("airflow")))
        .when(k % 5 == 1, F.array(i.text(" ", F.lower("c_mktsegment"), " "), F.lit("Airflow"), F.lit("ops")))
        .when(k % 5 == 2, F.array(F.lit(""), F.lit("data-eng"))).when(k % 5 == 3, F.array().cast("array<string>"))
    )
    tag = lambda c: F.struct(c.alias("name"))
    return t.customer.select(
        i.text("dag_", k).alias("dag_id"), F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")).alias("dag_display_name"),
        F.lit(None).cast("string").alias("description"), (k % 4 == 0).alias("is_paused"),
        F.when(k % 6 != 0, k % 7 != 0).alias("is_active"), owners.alias("owners"),
        F.array(tag(F.lit("team:etl")), tag(F.lit(" ")), tag(F.lit(None).cast("string"))).alias("tags"),
        F.lit(None).cast("timestamp").alias("next_dagrun"), "c_nationkey", k,
    )


@query("dag_jobs", f"""WITH {_DAG_SQL},
named AS (SELECT *, list_transform(list_filter(owners, lambda o: trim(o) <> '' AND lower(o) <> 'airflow'), lambda o: trim(o)) AS o FROM dags)
SELECT dag_id AS native_id, CASE WHEN trim(display) = '' THEN dag_id ELSE display END AS native_name,
  coalesce(CASE WHEN k % 6 <> 0 THEN k % 7 <> 0 END, true) AND k % 4 <> 0 AS is_active,
  CASE WHEN len(o) > 0 THEN array_to_string(o, ', ') END AS declared_owner, 'team:etl' AS tags FROM named""")
def dag_jobs(t):
    found = catalog.dag_jobs(dags(t))
    return found.select("native_id", "native_name", "is_active", "declared_owner", F.array_join("tags", ",").alias("tags"))


@query("page_completeness", """SELECT c_nationkey AS listing, count(*) AS landed,
  count(*) + CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS announced, c_nationkey % 4 <> 0 AS complete FROM customer GROUP BY c_nationkey""")
def page_completeness(t):
    # A page is a slice of 100 consecutive keys of one listing, so it holds 100 items at most.
    slots = dags(t).withColumn("page", F.floor(F.col("c_custkey") / 100))
    size = t.customer.groupBy(F.col("c_nationkey").alias("listing")).agg(F.count(F.lit(1)).alias("n"))
    pages = slots.groupBy(F.col("c_nationkey").alias("listing"), "page").agg(F.collect_list("dag_id").alias("items"))
    announced = (F.col("n") + F.when(F.col("listing") % 4 == 0, 1).otherwise(0)).cast("int")
    return scheduler.completeness(pages.join(size, "listing").withColumn("total_entries", announced), ["listing"])


@query("edge_invariants", """WITH e AS (SELECT l_partkey % 2000 AS u, l_suppkey AS d FROM lineitem)
SELECT 'self' AS rule, u AS upstream, d AS downstream, count(*) AS rows FROM e WHERE u = d GROUP BY ALL
UNION ALL SELECT 'repeated', u, d, count(*) FROM e GROUP BY ALL HAVING count(*) > 1""")
def edge_invariants(t):
    edges = t.lineitem.select((F.col("l_partkey") % 2000).alias("upstream"), F.col("l_suppkey").alias("downstream"))
    own = invariants.self_edges(edges).groupBy("upstream", "downstream").agg(F.count(F.lit(1)).alias("rows"))
    return own.withColumn("rule", F.lit("self")).unionByName(
        invariants.repeated_edges(edges).withColumn("rule", F.lit("repeated"))
    )


@query("binding_invariants", """WITH b AS (SELECT o_custkey % 25 AS s, 'J' || o_custkey AS j, lower('N' || (o_orderkey // 3)) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT 'job' AS shared, s AS source_id, j AS id, count(*) AS rows FROM b GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'native', s, n, count(*) FROM b GROUP BY ALL HAVING count(*) > 1""")
def binding_invariants(t):
    k = F.col("o_orderkey")
    native = F.call_function("div", k, F.lit(3))
    bindings = t.orders.select(
        (F.col("o_custkey") % 25).alias("source_id"), i.text("J", F.col("o_custkey")).alias("job_id"),
        F.when(k % 2 == 0, i.text("N", native)).otherwise(i.text("n", native)).alias("native_id"),
        F.when(F.col("o_orderstatus") == "F", i.utc("o_orderdate")).alias("unbound_at"),
    )
    return invariants.double_bindings(bindings)
