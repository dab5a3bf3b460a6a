"""Contracts: rules, versions, feeds, versions in force."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import query
from opslake.functions import contract as fn
from opslake.functions import time
from opslake.operators import contracts, scan

_COLUMN = "struct<name:string,type:string,nullable:boolean,max_length:int>"


def specs(t):
    """Parts as contracts; the last digit of the key decides which rule is broken."""
    k = F.col("p_partkey")
    d = k % 12
    broken = lambda n, bad, good: F.when(d == n, bad).otherwise(good)
    column = lambda name, kind, null, length: F.struct(
        name.alias("name"), kind.alias("type"), F.lit(null).alias("nullable"), F.lit(length).cast("int").alias("max_length")
    ).cast(_COLUMN)
    key = column(broken(8, F.lit(" "), F.lit("Id")), F.lit("string"), False, 50)
    value = column(F.col("p_brand"), broken(9, F.lit(""), F.lit("decimal")), True, None)
    return t.part.select(
        k, broken(0, F.lit("  "), i.text("PART-", k)).alias("feed_id"), broken(1, F.lit(""), F.col("p_type")).alias("owner"),
        broken(2, F.lit(None).cast("string"), i.text("landing/p", k % 50, "/")).alias("landing_prefix"),
        broken(3, F.lit(" "), i.text("PART", k, "_{yyyyMMdd}.csv")).alias("file_mask"),
        broken(4, F.lit(30000), (k % 5 * 3600).cast("int")).alias("window_start"),
        broken(5, F.lit(0), F.lit(25200)).cast("int").alias("window_end"),
        broken(6, F.lit(""), i.text("Schema_", F.col("p_size"))).alias("schema_name"),
        broken(7, F.array().cast(f"array<{_COLUMN}>"), F.array(key, value)).alias("columns"),
    )


@query("contract_rules", """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'feedId is required'
  WHEN 1 THEN f || 'owner is required' WHEN 2 THEN f || 'landingPrefix is required' WHEN 3 THEN f || 'fileMask is required'
  WHEN 4 THEN f || 'arrival window start must be before end' WHEN 5 THEN f || 'arrival window start must be before end'
  WHEN 6 THEN f || 'schema name is required' WHEN 7 THEN f || 'schema must declare at least one column'
  WHEN 8 THEN f || 'a column is missing a name' WHEN 9 THEN f || 'column ''' || p_brand || ''' is missing a type' END AS error
FROM (SELECT *, 'feed ''PART-' || p_partkey || ''': ' AS f FROM part)""")
def contract_rules(t):
    return contracts.check_rules(specs(t)).select("p_partkey", "error")


@query("contract_hash", """SELECT p_partkey, upper(sha256('{"FeedId":"PART-' || p_partkey || '","Owner":"' || p_type
  || '","LandingPrefix":"landing/p' || (p_partkey % 50) || '/","FileMask":"PART' || p_partkey
  || '_{yyyyMMdd}.csv","ArrivalWindow":{"Start":"0' || (p_partkey % 5) || ':00:00","End":"07:00:00"},"Schema":{"Name":"Schema_' || p_size
  || '","Columns":[{"Name":"Id","Type":"string","Nullable":false,"MaxLength":50},{"Name":"' || p_brand
  || '","Type":"decimal","Nullable":true,"MaxLength":null}]}}')) AS spec_hash FROM part WHERE p_partkey % 12 >= 10""")
def contract_hash(t):
    good = contracts.check_rules(specs(t)).filter(F.col("error").isNull())
    return contracts.with_hash(good).select("p_partkey", "spec_hash")


def order_specs(t):
    return t.orders.select(
        i.text("FEED-", F.col("o_custkey")).alias("feed_id"), "o_orderkey", "o_orderdate", "o_totalprice",
        F.upper(F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256)).alias("spec_hash"),
    )


def stored_versions(t):
    k = F.col("c_custkey")
    old = t.customer.filter(F.col("c_acctbal") < 2500).select(
        i.text("FEED-", k).alias("feed_id"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("version")
    )
    return old.withColumn(
        "spec_hash", F.when(F.col("version") == 2, F.upper(F.sha2(F.lit("O|1-URGENT"), 256))).otherwise("OLDER")
    )


@query("contract_versions", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, upper(sha256(o_orderstatus || '|' || o_orderpriority)) AS spec_hash,
    c_acctbal IS NOT NULL AS stored FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 2500),
c AS (SELECT *, coalesce(lag(spec_hash) OVER w, CASE WHEN stored THEN upper(sha256('O|1-URGENT')) END) AS prev
  FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
m AS (SELECT *, spec_hash IS DISTINCT FROM prev AS created FROM c)
SELECT 'FEED-' || o_custkey AS feed_id, o_orderkey, created, CAST(CASE WHEN stored THEN 2 ELSE 0 END
  + sum(CAST(created AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version FROM m""")
def contract_versions(t):
    chunk = scan.day_chunk("o_orderdate", "o_orderkey", **scan.bounds(t.orders, "o_orderkey"))
    numbered = contracts.next_versions(order_specs(t), stored_versions(t), ["o_orderdate", "o_orderkey"], chunk)
    return numbered.select("feed_id", "o_orderkey", "created", "version")


@query("contract_sync_summary", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus || '|' || o_orderpriority AS spec, c_acctbal IS NOT NULL AS stored
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 2500 WHERE o_totalprice <= 400000),
c AS (SELECT *, coalesce(lag(spec) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), CASE WHEN stored THEN 'O|1-URGENT' END) AS prev FROM s)
SELECT (SELECT count(*) FROM orders) AS synced, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS failed,
  count(*) FILTER (spec IS DISTINCT FROM prev) AS created, count(*) FILTER (spec IS NOT DISTINCT FROM prev) AS unchanged FROM c""")
def contract_sync_summary(t):
    bad = F.when(F.col("o_totalprice") > 400000, "owner is required")
    checked = order_specs(t).withColumn("path", i.text("c/", F.col("o_orderkey"), ".yaml")).withColumn("error", bad)
    chunk = scan.day_chunk("o_orderdate", "o_orderkey", **scan.bounds(t.orders, "o_orderkey"))
    good = checked.filter(F.col("error").isNull())
    numbered = contracts.next_versions(good, stored_versions(t), ["o_orderdate", "o_orderkey"], chunk)
    return contracts.sync_summary(contracts.sync_results(checked, numbered))


@query("feed_upsert", """WITH s AS (SELECT o_custkey % 1500 AS k, arg_max({'o': o_orderpriority, 'p': o_orderstatus}, {'d': o_orderdate, 'k': o_orderkey}) AS l FROM orders GROUP BY ALL),
f AS (SELECT s_suppkey AS k, s_name FROM supplier)
SELECT 'F' || coalesce(f.k, s.k) AS feed_name, coalesce(l.o, s_name) AS team_id, coalesce('landing/' || l.p || '/', 'old/') AS landing_prefix
FROM f FULL JOIN s ON s.k = f.k""")
def feed_upsert(t):
    feeds = t.supplier.select(
        i.text("F", F.col("s_suppkey")).alias("feed_name"), F.col("s_name").alias("team_id"), F.lit("old/").alias("landing_prefix"),
        F.lit(True).alias("is_active"),
    )
    wanted = t.orders.select(
        i.text("F", F.col("o_custkey") % 1500).alias("feed_id"), F.col("o_orderpriority").alias("owner"),
        i.text("landing/", F.col("o_orderstatus"), "/").alias("landing_prefix"), "o_orderdate", "o_orderkey",
    )
    return contracts.merge_feeds(feeds, wanted, ["o_orderdate", "o_orderkey"]).drop("is_active")


@query("arrival_version_asof", """WITH v AS (SELECT s_suppkey, n AS version,
    TIMESTAMP '1995-06-01' + to_days(CAST(n * 300 + s_suppkey % 50 AS INTEGER)) AS at0 FROM supplier, range(1, 9) r(n))
SELECT l_suppkey AS feed_id, version, count(*) AS arrivals FROM lineitem ASOF LEFT JOIN v ON s_suppkey = l_suppkey AND l_shipdate >= at0 GROUP BY ALL""")
def arrival_version_asof(t):
    k = F.col("s_suppkey")
    versions = t.supplier.select(k.alias("feed_id"), F.explode(F.sequence(F.lit(1), F.lit(8)).cast("array<bigint>")).alias("version"))
    start = F.lit("1995-06-01").cast("timestamp")
    versions = versions.withColumn(
        "effective_from", time.plus_seconds(start, (F.col("version") * 300 + F.col("feed_id") % 50) * 86400)
    )
    came = t.lineitem.select(
        F.col("l_suppkey").alias("feed_id"), F.col("l_orderkey").alias("arrival_id"), i.utc("l_shipdate").alias("arrived_at")
    )
    placed = contracts.version_in_force(came, versions, chunk_seconds=30 * 86400)
    return placed.groupBy("feed_id", "version").agg(F.count(F.lit(1)).alias("arrivals"))


@query("expected_names", """SELECT o_orderkey, 'N' || (o_custkey % 25) || '_ELIG_' || strftime(o_orderdate, '%Y%m%d') || '.csv' AS expected_name,
  strftime(o_orderdate + to_seconds((4 * 3600 + o_custkey % 25 * 600)), '%Y-%m-%d %H:%M:%S') AS closes_at FROM orders""")
def expected_names(t):
    f = F.col("o_custkey") % 25
    return t.orders.select(
        "o_orderkey", fn.expected_name(i.text("N", f, "_ELIG_{yyyyMMdd}.csv"), F.col("o_orderdate")).alias("expected_name"),
        i.ts_text(fn.window_close(F.col("o_orderdate"), 4 * 3600 + f * 600)).alias("closes_at"),
    )


@query("feed_schemas", """SELECT p_partkey, 'S' || (p_size % 60) AS schema_id, CASE WHEN p_size % 60 >= 40 THEN 'unknown schema: S' || (p_size % 60) END AS error FROM part""")
def feed_schemas(t):
    feeds = t.part.select("p_partkey", i.text("S", F.col("p_size") % 60).alias("schema_id"))
    known = t.part.filter("p_size < 40").select(i.text("S", F.col("p_size")).alias("schema_id")).distinct()
    return contracts.with_schema(feeds, known.withColumn("columns", F.array(F.lit("a")))).select("p_partkey", "schema_id", "error")


@query("feeds_by_carrier", "SELECT p_brand AS carrier_name, count(*) AS feeds FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_brand")
def feeds_by_carrier(t):
    return contracts.by_carrier(t.part.select(F.col("p_brand").alias("carrier_name"), (F.col("p_partkey") % 5 != 0).alias("is_active")))
