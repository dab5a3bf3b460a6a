"""Chunked running values equal plain windows, whatever the chunk and however hot the key."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslake.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(None if i % 40 == 0 else ("hot" if r.random() < 0.5 else f"k{r.randrange(9)}"), i, r.choice([None, 1, 2, 3, 4])) for i in range(1500)]
    return spark.createDataFrame(data, "k string, id bigint, v int")


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_window(rows, width, inclusive):
    got = scan.running(
        rows, ["k"], ["id"], scan.id_chunk("id", width),
        {
            "l": scan.last(F.col("v")), "t": scan.total(F.col("v")), "h": scan.high(F.col("v")), "m": scan.low(F.col("v")),
        },
        inclusive,
    )
    w = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select(
        "*", F.last("v", ignorenulls=True).over(w).alias("l"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("t"),
        F.max("v").over(w).alias("h"), F.min("v").over(w).alias("m"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("block", [1, 2, 3, 50, 1 << 18])
def test_trailing_equals_window(rows, block):
    aggs = {"n": lambda f: F.count("v").over(f), "a": lambda f: F.sum("v").over(f)}
    got = scan.trailing(rows, ["k"], ["id"], scan.id_chunk("id", 13), 5, aggs, block)
    w = W.partitionBy("k").orderBy("id").rowsBetween(-5, -1)
    want = rows.select("*", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("a"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("slices", "low", "high"), [(1, 0, 10), (7, 100, 1500), (64, 0, 1 << 40), (16, None, None)])
def test_day_chunks_follow_the_order(rows, slices, low, high):
    dated = rows.withColumn("d", F.date_add(F.lit("1969-12-30").cast("date"), (F.col("id") * 7 % 5).cast("int")))
    ends = scan.bounds(rows, "id") if low is None else {"low": low, "high": high}
    chunk = scan.day_chunk("d", "id", slices, **ends)
    got = scan.ranked(dated, ["k"], ["d", "id"], chunk, "n")
    want = dated.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("d", "id")).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ranked_without_loss(rows):
    got = scan.ranked(rows, ["k"], ["id"], scan.id_chunk("id", 11), "n").groupBy("k").agg(
        F.count("*").alias("c"), F.max("n").alias("m"), F.count_distinct("n").alias("d")
    )
    assert all(r.c == r.m == r.d for r in got.collect())


def test_hot_group_spreads_over_tasks(spark):
    """Half of all rows in one key: no task of the big window sees more than its chunk."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, F.col("id").cast("string"))
    df = spark.range(20_000).select(key.alias("k"), "id")
    chunked = df.withColumn("c", scan.id_chunk("id", 1000)).groupBy("k", "c").count()
    assert chunked.agg(F.max("count")).first()[0] == 500  # half of 1000 ids
    plan = scan.running(df, ["k"], ["id"], scan.id_chunk("id", 1000), {"t": scan.total(F.lit(1))})._jdf.queryExecution().toString()
    assert re.search(r"windowspecdefinition\(__g0#\d+, __z#\d+, __chunk#\d+L, id#", plan)
    # One shuffle of the rows, which the join of what came before uses too, and one of the totals.
    physical = plan.split("== Physical Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(__g0#\d+, __z#\d+, __chunk#\d+L, ", physical)) == 2


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("started", [False, True])
def test_numbered_changes_equal_windows(spark, rows, width, started):
    start = spark.createDataFrame([("hot", 3, 10), ("k1", None, 5)], "k string, start_value int, start_number bigint") if started else None
    got = scan.numbered_changes(rows, ["k"], ["id"], scan.id_chunk("id", width), F.col("v"), start)
    want, state = [], {"hot": (3, 10), "k1": (None, 5)} if started else {}
    for k, i, v in sorted(map(tuple, rows.collect()), key=lambda r: r[1]):
        seen, n = state.get(k, ("nothing", 0))
        n += seen != v
        want.append((k, i, v, seen != v, n, None if seen == "nothing" else seen))
        state[k] = (v, n)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_a_hot_day_is_split(spark):
    day = spark.range(1 << 35, (1 << 35) + 6400).select("id", F.lit("2026-09-03").cast("date").alias("d"))
    chunks = day.groupBy(scan.day_chunk("d", "id", 64, **scan.bounds(day, "id")).alias("c")).count().collect()
    assert len(chunks) == 64 and {r["count"] for r in chunks} == {100}
    assert scan.bounds(day.limit(0), "id") == {"low": 0, "high": 0}


def test_names_with_one_beginning_spread(spark):
    names = spark.range(5000).select(F.format_string("Supplier#%012d", F.col("id")).alias("name"))
    got = scan.numbered(names.repartition(7), ["name"], "n")
    assert [r.n for r in got.orderBy("name").collect()] == list(range(1, 5001))
    ranges = names.repartitionByRange(4, "name").groupBy(F.spark_partition_id()).count().count()
    assert ranges > 1
    assert scan.numbered(names.limit(0), ["name"], "n").count() == 0
