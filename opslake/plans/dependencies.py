"""Declared dependencies of jobs, and how far each job reaches, kept up to date as edges are declared.

The store keeps the edges and the closure: for each pair of jobs that a chain of edges joins, the length
of the shortest one. The closure is stored twice, to be looked up by its upper and by its lower end. A
cone is then one lookup, without rounds. The closure has a row for each pair that is joined, so it suits
graphs in which jobs reach a bounded part of the others; ``signals.cone`` needs no closure.

Edges are declared and stay; a pair's distance can only become shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session
from opslake.store import Store

PAIR = ["upstream", "downstream"]


def declare(store: Store, edges: DataFrame, batch: int, now: str, writer: str = "dependencies") -> bool:
    """Add edges (upstream, downstream, declared_by), and what they join to the closure.

    Edges that are known keep who declared them first; edges of a job to itself and edges without an end
    are left out. Of the closure only rows above and below the new edges are read. Two writers may declare
    at once: the later one adds its edges on top of the other's. Returns False if the batch had been folded.
    """
    at = F.lit(now).cast("timestamp")
    given = edges.filter(F.col("upstream") != F.col("downstream"))
    given = session.cut(given.groupBy(*PAIR).agg(F.min("declared_by").alias("declared_by")))

    def build(past: Store) -> dict[str, DataFrame]:
        known = past.touched("edge", given).select(*PAIR)
        fresh = session.cut(given.join(known, PAIR, "left_anti"))
        above = past.touched("reached", fresh.select(F.col("upstream").alias("downstream")))
        below = past.touched("reach", fresh.select(F.col("downstream").alias("upstream")))
        pairs = session.cut(joined(fresh, above, below))
        had = past.touched("reach", pairs).withColumnRenamed("depth", "had")
        pairs = pairs.join(had, PAIR, "left").filter(F.col("had").isNull() | (F.col("depth") < F.col("had"))).drop("had")
        pairs = session.cut(pairs)
        return {"edge": fresh.withColumn("declared_at", at), "reach": pairs, "reached": pairs}

    return store.transact(writer, batch, build, reads=("edge",))


def joined(fresh: DataFrame, above: DataFrame, below: DataFrame) -> DataFrame:
    """upstream, downstream, depth: the pairs that new edges join, with the shortest ways over any of them.

    ``fresh``: upstream, downstream. ``above``: the known pairs whose lower end is the upper end of a new
    edge. ``below``: those whose upper end is the lower end of one.
    """
    paths = chains(fresh, below)
    down = F.col("p.depth") + F.col("k.depth")
    from_above = above.alias("k").join(paths.alias("p"), F.col("k.downstream") == F.col("p.upstream")).select(
        "k.upstream", "p.downstream", down.alias("depth")
    )
    reach = _least(paths.select(*PAIR, "depth").unionByName(from_above))
    to_below = reach.alias("p").join(below.alias("k"), F.col("p.downstream") == F.col("k.upstream")).select(
        "p.upstream", "k.downstream", down.alias("depth")
    )
    return _least(reach.unionByName(to_below))


def chains(fresh: DataFrame, below: DataFrame) -> DataFrame:
    """The shortest ways that begin and end with a new edge, with known pairs in between.

    Paths double each round: those of exactly 2^k new edges are followed by those of up to as many.
    Among ways of one length the one of the fewest new edges counts, and so do its parts; that makes
    every pair of more than 2^k edges appear in the round that reaches its number. A chain of 1,000 new
    edges takes ten rounds, and rows are formed once for each middle, not for each way to cut a path.
    """
    new = fresh.select(*PAIR, F.lit(1).alias("depth"), F.lit(1).alias("hops"))
    starts = fresh.select(F.col("upstream").alias("downstream")).distinct()
    same = fresh.select(F.col("downstream").alias("upstream")).distinct().join(
        starts.withColumn("upstream", F.col("downstream")), "upstream"
    ).select(*PAIR, F.lit(0).alias("depth"))
    between = session.cut(below.join(starts, "downstream").select(*PAIR, "depth").unionByName(same))
    paths, reach = session.cut(new), 1
    while not (longest := paths.filter(F.col("hops") == reach)).isEmpty():
        onward = longest.alias("a").join(between.alias("b"), F.col("a.downstream") == F.col("b.upstream")).select(
            "a.upstream", F.col("b.downstream").alias("via"), (F.col("a.depth") + F.col("b.depth")).alias("far"), F.col("a.hops").alias("so")
        )
        longer = onward.alias("a").join(paths.alias("p"), F.col("a.via") == F.col("p.upstream")).select(
            "a.upstream", "p.downstream", (F.col("far") + F.col("p.depth")).alias("depth"), (F.col("so") + F.col("p.hops")).alias("hops")
        )
        both = paths.unionByName(longer.filter(F.col("upstream") != F.col("downstream")))
        least = F.min(F.struct("depth", "hops"))
        paths, reach = session.cut(both.groupBy(*PAIR).agg(least.alias("way")).select(*PAIR, "way.*")), 2 * reach
        session.release(paths.sparkSession)
    return paths


def _least(pairs: DataFrame) -> DataFrame:
    there = pairs.filter(F.col("upstream") != F.col("downstream"))
    return there.groupBy(*PAIR).agg(F.min("depth").cast("int").alias("depth"))


def downstream_of(store: Store, failed: DataFrame) -> DataFrame:
    """job_id, depth: every job downstream of a failed one with its distance; the failed jobs have 0."""
    return _ends(store, "reach", failed, "upstream", "downstream")


def upstream_of(store: Store, late: DataFrame) -> DataFrame:
    """job_id, depth: every job that one of these jobs waits for, with its distance; they have 0."""
    return _ends(store, "reached", late, "downstream", "upstream")


def _ends(store: Store, table: str, jobs: DataFrame, start: str, end: str) -> DataFrame:
    own = session.cut(jobs.select(F.col("job_id").cast("string")).filter("job_id is not null").distinct())
    far = store.touched(table, own.select(F.col("job_id").alias(start))).select(F.col(end).alias("job_id"), "depth")
    all_ = far.unionByName(own.withColumn("depth", F.lit(0)))
    return all_.groupBy("job_id").agg(F.min("depth").alias("depth"))
