"""The store: batches, replays and current rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import inputs as i
from driver.registry import Tables, query
from opslake import session
from opslake.store import Store


def _versions(t: Tables, batch: int):
    """Orders as runs: a batch holds those whose key has as many versions; the status tells which."""
    k = F.col("o_orderkey")
    rows = t.orders if batch == 1 else t.orders.filter(k % batch == 0)
    none = F.lit(None)
    return rows.select(
        (F.col("o_custkey") % 7).cast("int").alias("source_id"), i.text("run-", k).alias("native_run_id"),
        i.text("job-", F.col("o_custkey")).alias("job_id"), i.utc("o_orderdate").alias("started_at"),
        none.cast("timestamp").alias("ended_at"), F.lit(f"v{batch}").alias("status"),
        none.cast("string").alias("error_text"), none.cast("string").alias("fingerprint"),
    )


_CURRENT = """SELECT CAST(o_custkey % 7 AS INTEGER) AS source_id, 'run-' || o_orderkey AS native_run_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'v3' WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS status FROM orders"""


@query("store_current", _CURRENT)
def store_current(t):
    """Three batches, folded up to the second one."""
    store = Store(t.spark, session.scratch(t.spark, "store"))
    for batch in (1, 2, 3):
        store.commit(batch, {"run": _versions(t, batch)})
    store.compact()
    return store.current("run").select("source_id", "native_run_id", "status")


@query("store_replay", """SELECT batch, count(*) AS rows FROM (SELECT 1 AS batch FROM orders
  UNION ALL SELECT 2 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 3 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY batch""")
def store_replay(t):
    """Every batch runs twice; readers see one attempt of each."""
    store = Store(t.spark, session.scratch(t.spark, "store"))
    for batch in (1, 2, 2, 3, 1):
        store.commit(batch, {"run": _versions(t, batch)})
    return store.log("run").groupBy(F.col("batch").cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("rows"))


def _counted(t: Tables, writer: str, batch: int):
    """Per source how many orders a writer's batch brings, as a heartbeat row."""
    half = t.orders.filter((F.col("o_orderkey") % 2 == int(writer == "odd")) & (F.floor(F.col("o_orderkey") / 2) % 2 == batch - 1))
    return half.groupBy((F.col("o_custkey") % 7).cast("int").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))


@query("store_two_writers", """SELECT CAST(o_custkey % 7 AS INTEGER) AS source_id, count(*) AS orders,
  count(DISTINCT o_orderkey % 2) AS writers FROM orders GROUP BY 1""")
def store_two_writers(t):
    """Two writers add to the same rows: each commit of one comes while the other has read and not yet committed."""
    store = Store(t.spark, session.scratch(t.spark, "store"))

    def build(writer: str, batch: int, meanwhile=None):
        def rows(past: Store):
            fresh = _counted(t, writer, batch)
            had = past.touched("source_state", fresh.withColumn("watermark", F.lit("")))
            total = F.col("n") + F.coalesce(F.col("watermark").cast("bigint"), F.lit(0))
            merged = fresh.join(had.select("source_id", "watermark"), "source_id", "left").select(
                "source_id", total.cast("string").alias("watermark"), F.lit(None).cast("timestamp").alias("last_heartbeat")
            )
            none = F.lit(None).cast("string")
            named = fresh.select("source_id", F.lit(writer).alias("native_id"), none.alias("job_id"), none.alias("name"))
            held = named.withColumns({"is_active": F.lit(True), **{c: F.lit(None).cast("timestamp") for c in ("first_seen", "last_seen", "bound_at")}})
            if meanwhile is not None and not done:
                done.append(meanwhile())
            return {"source_state": merged, "job": held}

        done: list = []
        return rows

    for batch in (1, 2):
        store.transact("odd", batch, build("odd", batch, lambda b=batch: store.transact("even", b, build("even", b))))
    writers = store.current("job").groupBy("source_id").agg(F.count(F.lit(1)).alias("writers"))
    return store.current("source_state").join(writers, "source_id").select(
        "source_id", F.col("watermark").cast("bigint").alias("orders"), "writers"
    )


@query("store_touched", """SELECT CAST(o_custkey % 7 AS INTEGER) AS source_id, 'run-' || o_orderkey AS native_run_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'v3' WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS status FROM orders
WHERE o_orderstatus = 'P' OR o_totalprice < 20000""")
def store_touched(t):
    """What a merge reads: the last versions of some keys, from levels and from a batch that has not been folded."""
    store = Store(t.spark, session.scratch(t.spark, "store"), file_rows=1 << 14)
    for batch in (1, 2):
        store.commit(batch, {"run": _versions(t, batch)}, f"writer-{batch}")
        store.commit(batch + 10, {"run": _versions(t, 10**9)}, f"writer-{batch}")
    store.compact()
    store.settle()
    store.commit(3, {"run": _versions(t, 3)})
    asked = t.orders.filter((F.col("o_orderstatus") == "P") | (F.col("o_totalprice") < 20000)).select(
        (F.col("o_custkey") % 7).cast("int").alias("source_id"), i.text("run-", F.col("o_orderkey")).alias("native_run_id")
    )
    return store.touched("run", asked).select("source_id", "native_run_id", "status")
