"""Checks of landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import query
from opslake import session, vocab
from opslake.functions import contract as fn
from opslake.functions import time
from opslake.operators import validate
from opslake.sources import landing


def nation_feeds(t):
    """Two feeds per nation below one prefix, told apart by their masks."""
    k = F.col("n_nationkey")
    kind = F.explode(F.array(F.lit("ELIG"), F.lit("CLAIMS")))
    return t.nation.withColumn("kind", kind).select(
        i.text("N", k, "-", F.col("kind")).alias("feed_name"), i.text("landing/n", k, "/").alias("landing_prefix"),
        i.text("N", k, "_", F.col("kind"), "_{yyyyMMdd}.", F.when(F.col("kind") == "ELIG", "csv").otherwise("txt")).alias("file_mask"),
        k.alias("nation"), "kind",
    )


@query("mask_conformance", """WITH a AS (SELECT o_orderkey AS k, o_custkey % 25 AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'ELIG' ELSE 'CLAIMS' END AS kind,
    CASE WHEN o_orderkey % 2 = 0 THEN 'csv' ELSE 'txt' END AS ext, o_orderdate AS d FROM orders)
SELECT k AS arrival_id, CASE WHEN k % 29 = 0 THEN NULL WHEN k % 17 = 0 THEN 'N' || n || '-ELIG' ELSE 'N' || n || '-' || kind END AS feed_name,
  CASE WHEN k % 29 = 0 OR k % 17 = 0 THEN NULL WHEN k % 13 = 0 AND k % 11 = 0 THEN 'case_and_date' WHEN k % 13 = 0 THEN 'case'
    WHEN k % 11 = 0 THEN 'date_format' ELSE 'exact' END AS name_fit FROM a""")
def mask_conformance(t):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 25
    kind = F.when(k % 2 == 0, "ELIG").otherwise("CLAIMS")
    ext = F.when(k % 2 == 0, "csv").otherwise("txt")
    day = F.when(k % 11 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    name = i.text("N", n, "_", kind, "_", day, ".", ext)
    name = F.when(k % 17 == 0, "README.md").when(k % 13 == 0, F.lower(name)).otherwise(name)
    root = F.when(k % 29 == 0, "inbox/").otherwise(i.text("landing/n", n, "/"))
    came = t.orders.select(k.alias("arrival_id"), F.concat(root, name).alias("key"))
    return validate.attribute(came, nation_feeds(t)).select("arrival_id", "feed_name", "name_fit")


def daily_feeds(t):
    k = F.col("n_nationkey")
    return t.nation.select(
        i.text("N", k).alias("feed_name"), (4 * 3600 + k * 600).alias("window_end"), (k % 9 != 8).alias("is_active")
    )


def daily_arrivals(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        i.text("N", F.col("o_custkey") % 25).alias("feed_name"), F.to_date("o_orderdate").alias("day"),
        time.plus_seconds(i.utc("o_orderdate"), k * 7919 % 86400).alias("arrived_at"), k.alias("arrival_id"),
    )


@query("late_files", """SELECT 'N' || (o_custkey % 25) AS feed_name, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS files FROM orders
WHERE o_orderkey * 7919 % 86400 > 4 * 3600 + o_custkey % 25 * 600 GROUP BY ALL""")
def late_files(t):
    found = validate.late(daily_arrivals(t).join(daily_feeds(t), "feed_name"))
    return found.groupBy("feed_name", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("files"))


@query("missing_files", """WITH span AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders),
cal AS (SELECT n_nationkey, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM span, nation WHERE n_nationkey % 9 <> 8)
SELECT 'N' || n_nationkey AS feed_name, strftime(d, '%Y-%m-%d') AS day FROM cal, span
WHERE d + to_seconds(4 * 3600 + n_nationkey * 600) <= b + INTERVAL 5 HOUR
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey % 25 = n_nationkey AND o_orderdate = d)""")
def missing_files(t):
    span = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    expected = validate.expected_days(
        daily_feeds(t).withColumn("a", span.select("a").scalar()).withColumn("b", span.select("b").scalar()), F.col("a"), F.col("b")
    )
    gone = validate.missing(expected, daily_arrivals(t), time.plus_seconds(F.col("b").cast("timestamp"), F.lit(5 * 3600)))
    return gone.select("feed_name", F.date_format("day", "yyyy-MM-dd").alias("day"))


ROW_SPEC = [
    {"name": "shipped", "type": "date", "nullable": False, "max_length": None},
    {"name": "quantity", "type": "decimal", "nullable": True, "max_length": None},
    {"name": "line", "type": "int", "nullable": False, "max_length": None},
    {"name": "flag", "type": "string", "nullable": False, "max_length": 1},
    {"name": "status", "type": "string", "nullable": True, "max_length": 5},
]


def file_rows(t):
    """Line items as the text rows of one file per supplier, with defects by key."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return t.lineitem.select(
        F.col("l_suppkey").alias("arrival_id"),
        F.when(o % 101 == 0, "NOT_A_DATE").when(o % 211 == 0, F.substring(day, 1, 4)).when(o % 307 == 0, None).otherwise(day).alias("shipped"),
        F.when(p % 97 == 0, "NOT_A_DECIMAL").otherwise((F.col("l_quantity") / 4).cast("string")).alias("quantity"),
        F.when(p % 89 == 0, "NOT_A_INT").when(p % 83 == 0, None).otherwise(F.col("l_linenumber").cast("string")).alias("line"),
        F.when(o % 79 == 0, None).when(o % 73 == 0, "XXXX").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(p % 71 == 0, "XXXXXXXXXXXX").when(p % 67 == 0, None).otherwise(F.col("l_linestatus")).alias("status"),
    )


_FINDINGS_SQL = """marks AS (SELECT l_suppkey AS arrival_id, l_orderkey AS o, l_partkey AS p FROM lineitem),
findings AS (
  SELECT arrival_id, 'NullInNotNullColumn' AS "check", 'shipped' AS column_name, count(*) AS occurrences FROM marks WHERE o % 307 = 0 AND o % 101 <> 0 AND o % 211 <> 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'DataTypeMismatch', 'shipped', count(*) FROM marks WHERE o % 101 = 0 OR o % 211 = 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'DataTypeMismatch', 'quantity', count(*) FROM marks WHERE p % 97 = 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'DataTypeMismatch', 'line', count(*) FROM marks WHERE p % 89 = 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'NullInNotNullColumn', 'line', count(*) FROM marks WHERE p % 83 = 0 AND p % 89 <> 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'NullInNotNullColumn', 'flag', count(*) FROM marks WHERE o % 79 = 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'TruncatedData', 'flag', count(*) FROM marks WHERE o % 73 = 0 AND o % 79 <> 0 GROUP BY ALL
  UNION ALL SELECT arrival_id, 'TruncatedData', 'status', count(*) FROM marks WHERE p % 71 = 0 GROUP BY ALL)"""


@query("null_type_length", f"WITH {_FINDINGS_SQL} SELECT * FROM findings")
def null_type_length(t):
    return validate.value_findings(file_rows(t), ROW_SPEC)


def _contract_columns():
    kind = "struct<name:string,type:string,nullable:boolean,max_length:int>"
    one = lambda c: F.struct(
        F.lit(c["name"]).alias("name"), F.lit(c["type"]).alias("type"), F.lit(c["nullable"]).alias("nullable"),
        F.lit(c["max_length"]).cast("int").alias("max_length"),
    ).cast(kind)
    return F.array(*[one(c) for c in ROW_SPEC])


def _field_findings(t):
    fields = file_rows(t).select(
        "arrival_id", (F.col("arrival_id") % 4).alias("schema_key"), F.array(*[c["name"] for c in ROW_SPEC]).alias("values")
    )
    declared = t.supplier.select((F.col("s_suppkey") % 4).alias("schema_key")).distinct().withColumn("columns", _contract_columns())
    return validate.field_findings(fields, declared)


@query("field_findings", f"WITH {_FINDINGS_SQL} SELECT * FROM findings")
def field_findings(t):
    return _field_findings(t)


@query("findings", f"""WITH {_FINDINGS_SQL},
n AS (SELECT arrival_id, count(*) AS n, CAST(sum(occurrences) AS BIGINT) AS occurrences, string_agg("check" || ':' || column_name, ',' ORDER BY "check", column_name) AS document FROM findings GROUP BY ALL)
SELECT s_suppkey AS arrival_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Error' WHEN n IS NOT NULL THEN 'Failed' ELSE 'Passed' END AS result,
  CASE WHEN s_suppkey % 10 = 0 THEN 'Pending' WHEN n IS NOT NULL THEN 'Quarantined' WHEN s_suppkey % 7 = 0 THEN 'Late' ELSE 'Validated' END AS disposition,
  coalesce(document, '') AS document FROM supplier LEFT JOIN n ON arrival_id = s_suppkey""")
def findings(t):
    k = F.col("s_suppkey")
    came = t.supplier.select(
        k.alias("arrival_id"), i.text("F", k).alias("feed_name"), F.when(k % 10 != 0, 1).alias("version"), (k % 7 == 0).alias("is_late")
    )
    judged = validate.verdicts(came, validate.value_findings(file_rows(t), ROW_SPEC))
    lines = F.transform(F.coalesce("findings", F.array().cast("array<struct<check:string,column_name:string,occurrences:bigint>>")),
                        lambda f: F.concat(f["check"], F.lit(":"), f["column_name"]))
    return judged.select("arrival_id", "result", "disposition", F.array_join(lines, ",").alias("document"))


@query("quarantine_split", f"""WITH {_FINDINGS_SQL}, bad AS (SELECT DISTINCT arrival_id FROM findings WHERE "check" = 'TruncatedData')
SELECT CASE WHEN arrival_id IS NULL THEN 'on' ELSE 'aside' END AS way, count(*) AS files FROM supplier LEFT JOIN bad ON arrival_id = s_suppkey GROUP BY ALL""")
def quarantine_split(t):
    came = t.supplier.select(F.col("s_suppkey").alias("arrival_id"), F.lit("F").alias("feed_name"), F.lit(1).alias("version"), F.lit(False).alias("is_late"))
    long_values = validate.value_findings(file_rows(t), ROW_SPEC).filter(F.col("check") == vocab.V_LENGTH)
    on, aside = validate.quarantine(validate.verdicts(came, long_values))
    both = on.withColumn("way", F.lit("on")).unionByName(aside.withColumn("way", F.lit("aside")))
    return both.groupBy("way").agg(F.count(F.lit(1)).alias("files"))


@query("violation_report", f"""WITH {_FINDINGS_SQL}
SELECT 'F' || (arrival_id % 20) AS feed_name, '2024-01-' || lpad(CAST(arrival_id % 28 + 1 AS VARCHAR), 2, '0') AS day, "check",
  CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT arrival_id) AS files FROM findings GROUP BY ALL""")
def violation_report(t):
    k = F.col("s_suppkey")
    came = t.supplier.select(
        k.alias("arrival_id"), i.text("F", k % 20).alias("feed_name"),
        i.text("2024-01-", F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("day"),
    )
    return validate.violation_report(validate.value_findings(file_rows(t), ROW_SPEC), came)


@query("duplicate_rows", """WITH g AS (SELECT l_returnflag AS arrival_id, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber, l_linestatus HAVING count(*) > 1)
SELECT arrival_id, CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) AS repeated_kinds FROM g GROUP BY arrival_id""")
def duplicate_rows(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("arrival_id"), "l_orderkey", "l_linenumber", "l_linestatus")
    return validate.duplicate_rows(rows, "arrival_id", ["arrival_id", "l_orderkey", "l_linenumber", "l_linestatus"])


def drifted_headers(t):
    """Headers of one file per part; the key decides which drift it has."""
    k = F.col("p_partkey")
    names = ["MemberId", "EffectiveDate", "Gender", "GroupNumber", "Plan"]
    declared = F.array(*[F.lit(n) for n in names])
    swap = lambda at, name: F.transform(declared, lambda n, x: F.when(x == at, name).otherwise(n))
    added = F.array_append(declared, i.text("Unexpected_Column_", k))
    header = i.pick(k % 8, [
        declared, swap(1, F.lit("Effective_Date")), F.filter(declared, lambda n: n != "GroupNumber"), added,
        swap(2, F.lit("Gender_New")), F.filter(added, lambda n: n != "Gender"), swap(3, F.lit("Other")),
        F.transform(F.array(*[F.lit(n) for n in ["MemberId", "Gender", "Effective_Date", "GroupNumber", "Plan"]]), lambda n: n),
    ])
    return t.part.select(k.alias("arrival_id"), header.alias("header"), declared.alias("declared"))


@query("schema_diff", """SELECT p_partkey AS arrival_id, CASE p_partkey % 8 WHEN 2 THEN 'SchemaDriftRemovedColumn' WHEN 3 THEN 'SchemaDriftAddedColumn' ELSE 'SchemaDriftRenamedColumn' END AS "check",
  CASE p_partkey % 8 WHEN 1 THEN 'EffectiveDate' WHEN 2 THEN 'GroupNumber' WHEN 3 THEN 'Unexpected_Column_' || p_partkey WHEN 4 THEN 'Gender' WHEN 6 THEN 'GroupNumber' WHEN 7 THEN 'EffectiveDate' END AS column_name,
  CASE p_partkey % 8 WHEN 1 THEN 'Effective_Date' WHEN 4 THEN 'Gender_New' WHEN 6 THEN 'Other' WHEN 7 THEN 'Effective_Date' END AS detail FROM part WHERE p_partkey % 8 NOT IN (0, 5)
UNION ALL SELECT p_partkey, 'SchemaDriftRemovedColumn', 'Gender', NULL FROM part WHERE p_partkey % 8 = 5
UNION ALL SELECT p_partkey, 'SchemaDriftAddedColumn', 'Unexpected_Column_' || p_partkey, NULL FROM part WHERE p_partkey % 8 = 5""")
def schema_diff(t):
    return validate.schema_diff(drifted_headers(t))


@query("feed_alerts", """WITH drift AS (SELECT 'P' || (p_partkey % 30) AS f, count(*) AS n FROM part WHERE p_partkey % 8 NOT IN (0, 5) GROUP BY ALL
  UNION ALL SELECT 'P' || (p_partkey % 30), 2 * count(*) FROM part WHERE p_partkey % 8 = 5 GROUP BY ALL)
SELECT upper(sha256('SchemaDrift|' || f)) AS dedup_key, 'Firing' AS status, f || ': SchemaDrift' AS message, CAST(sum(n) AS BIGINT) AS occurrences FROM drift GROUP BY f""")
def feed_alerts(t):
    from opslake.operators import alerts, signals

    found = validate.schema_diff(drifted_headers(t)).withColumn("feed_name", i.text("P", F.col("arrival_id") % 30))
    raised = signals.feed_events(found, vocab.SCHEMA_DRIFT, F.lit("2024-01-01").cast("timestamp"), F.col("arrival_id"))
    none = t.spark.createDataFrame([], alerts.empty_state_schema())
    return alerts.merge(none, raised).select("dedup_key", "status", "message", "occurrences")


FIXED_SPEC = [
    {"name": "c_custkey", "type": "int"}, {"name": "c_name", "type": "string", "max_length": 15},
    {"name": "c_acctbal", "type": "decimal"}, {"name": "c_mktsegment", "type": "string", "max_length": None},
]


def _fixed_columns():
    kind = "struct<name:string,type:string,max_length:int>"
    return F.array(*[
        F.struct(F.lit(c["name"]).alias("name"), F.lit(c["type"]).alias("type"), F.lit(c.get("max_length")).cast("int").alias("max_length")).cast(kind)
        for c in FIXED_SPEC
    ])


@query("fixed_width_parse", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, substr(c_name, 1, 15) AS c_name,
  CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_acctbal, c_mktsegment FROM customer""")
def fixed_width_parse(t):
    rows = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey").cast("string")))
    lines = rows.select(landing.render_fixed_width(rows, FIXED_SPEC).alias("line"))
    cut = lines.select(landing.cut_fields(F.col("line"), landing.with_offsets(_fixed_columns())).alias("v"))
    return cut.select(*[F.get("v", F.lit(n)).alias(c["name"]) for n, c in enumerate(FIXED_SPEC)])


_LANDED_SQL = """SELECT c_nationkey AS nation, {header} AS header, count(*) AS lines, count(*) FILTER (c_custkey % 6 = 0) AS empty_fields,
  CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer GROUP BY c_nationkey"""


def _per_file(rows, headers):
    """File counts summed by the directory the file lies in."""
    nation = F.regexp_extract("arrival_id", "c_nationkey=([0-9]+)", 1).cast("int")
    counted = rows.groupBy(nation.alias("nation")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.get("values", F.lit(1)).isNull()).alias("empty_fields"),
        F.sum(F.get("values", F.lit(0)).cast("bigint")).alias("key_sum"),
    )
    names = headers.groupBy(nation.alias("nation")).agg(F.max("header").alias("header"))
    return counted.join(names, "nation")


@query("landed_delimited", _LANDED_SQL.format(header="'c_custkey,c_name,c_mktsegment'"))
def landed_delimited(t):
    """Customers written as CSV files by nation and read back as a landing zone."""
    root = session.scratch(t.spark, "landed-csv")
    name = F.when(F.col("c_custkey") % 6 != 0, F.col("c_name"))
    t.customer.select("c_custkey", name.alias("c_name"), "c_mktsegment", "c_nationkey").write.partitionBy("c_nationkey").option(
        "header", True).csv(root)
    headers = landing.delimited_headers(t.spark, root).withColumn("header", F.array_join("header", ","))
    return _per_file(landing.delimited_rows(t.spark, root, 3), headers)


@query("landed_fixed_width", _LANDED_SQL.format(header="'c_custkey c_name         c_acctbal   c_mktsegment'"))
def landed_fixed_width(t):
    """The same as fixed-width files; the one column's name is the header line."""
    root = session.scratch(t.spark, "landed-txt")
    rows = t.customer.withColumn("c_name", F.when(F.col("c_custkey") % 6 != 0, F.col("c_name"))).withColumn("c_acctbal", F.lit("1"))
    head = "".join(c["name"].ljust(w)[:w] for c, w in zip(FIXED_SPEC, (10, 15, 12, 20), strict=True))
    lines = rows.select(landing.render_fixed_width(rows, FIXED_SPEC).alias(head), "c_nationkey")
    lines.write.partitionBy("c_nationkey").option("header", True).option("sep", "\u0001").option("quote", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    cut = landing.cut_fields(F.col("line"), landing.with_offsets(_fixed_columns()))
    read = landing.fixed_width_lines(t.spark, root, "*.csv").withColumn("values", cut)
    headers = landing.fixed_width_headers(t.spark, root, "*.csv").withColumn("header", F.rtrim("header_line"))
    return _per_file(read, headers)


@query("json_structure", """SELECT event_type AS arrival_id, 'SchemaDriftRemovedColumn' AS "check", 'member' AS column_name, count(*) AS occurrences FROM events GROUP BY ALL
UNION ALL SELECT event_type, 'SchemaDriftAddedColumn', 'extra', count(*) FROM events WHERE event_id % 7 = 0 AND event_id % 31 <> 0 GROUP BY ALL
UNION ALL SELECT event_type, 'SchemaDriftRemovedColumn', 'k', count(*) FROM events WHERE event_id % 7 = 0 AND event_id % 31 <> 0 GROUP BY ALL""".replace(
    "'member' AS column_name, count(*) AS occurrences FROM events GROUP BY ALL",
    "'member' AS column_name, count(*) AS occurrences FROM events WHERE event_id % 31 <> 0 GROUP BY ALL") + """
UNION ALL SELECT event_type, 'unreadable', '', count(*) FROM events WHERE event_id % 31 = 0 GROUP BY ALL""")
def json_structure(t):
    e = F.col("event_id")
    line = F.when(e % 31 == 0, "{broken").when(e % 7 == 0, '{"extra": 1}').otherwise(F.col("props"))
    return landing.json_structure(t.events.select(F.col("event_type").alias("arrival_id"), line.alias("value")), ["k", "member"])


@query("contract_widths", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 10 ELSE CASE WHEN p_partkey % 8 = 3 THEN p_size ELSE 20 END END AS width FROM part""")
def contract_widths(t):
    k = F.col("p_partkey")
    kind = i.pick(k % 4, ["date", "decimal", "int", "string"])
    return t.part.select(k, fn.field_width(kind, F.when(k % 8 == 3, F.col("p_size"))).alias("width"))
