"""Nearest neighbours by cosine: shifted space-filling curves.

Each of several orderings projects the unit vectors on a few random directions, shifts the grid at random and takes
the place of the cell on a Hilbert curve. Spark sorts all vectors by that place, for every ordering in one range
partitioning. A query looks at the vectors within a window of places on either side of its own; blocks of the sorted
vectors meet the queries whose windows touch them, and the best of all orderings are merged and ranked again by the
cosine of the original vectors.

How wide the window has to be depends on the data, so it is measured: for a bounded sample of queries the exact
neighbours are found by brute force, and the window is as wide as ``RECALL`` of them need. On data without structure
that is a fixed share of all rows; on clustered data it is narrow.

Equal vectors are one entry with its smallest ids, so a vector of many copies costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake import session
from opslake.llm.common import map_batches, single

#: Orderings, directions of each, and bits of a direction; directions times bits stay below 63.
CURVES, DIRECTIONS, BITS = 16, 8, 7
#: Rows of a sorted block; queries of the sample; share of their neighbours that the window has to hold.
BLOCK, SAMPLE, RECALL = 4096, 200, 0.96
_SEED = 20_240_229


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of whole numbers below 2^bits).

    The axes are turned into the transposed index bit by bit from the highest: each bit inverts or swaps the lower
    bits, a Gray code over the axes follows, and the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        top, low = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):
            swapped = np.where(x[i] & top, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & top, low, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | ((axis >> bit) & 1)
    return place


def orderings(dimension: int, curves: int = CURVES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shifts of each ordering; the same wherever they are made."""
    make = np.random.default_rng([_SEED, dimension])
    count = min(DIRECTIONS, dimension)
    return [(np.linalg.qr(make.normal(size=(dimension, count)))[0], make.uniform(0, 0.5, count)) for _ in range(curves)]


def places(unit: np.ndarray, ordering: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where unit vectors stand on an ordering's curve: projections of up to four deviations fill half the grid."""
    directions, shift = ordering
    spread = unit @ directions * (np.sqrt(unit.shape[1]) / 16) + 0.25
    cells = np.clip((np.clip(spread, 0, 0.5) + shift) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = single(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosines of each row with a vector, the same for a pair in whichever batch it is."""
    return (many * one).sum(axis=1) / (np.sqrt((many * many).sum(axis=1)) * np.sqrt((one * one).sum()))


def best_rows(query: np.ndarray, unit: np.ndarray, vectors: np.ndarray, ids: np.ndarray, allowed: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows nearest to a query among those allowed, with their cosines; ties to smaller ids."""
    at = np.flatnonzero(allowed)
    rough = unit[at]
    if len(at) > 4 * keep:  # all that could be among the best but for rounding
        least = np.partition(rough, len(at) - keep)[len(at) - keep]
        at = at[rough >= least - 1e-9]
    exact = cosine(vectors[at], query)
    order = np.lexsort((ids[at], -exact))[:keep]
    return at[order], exact[order]


def valid(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite components that aren't all zero."""
    vec = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.coalesce(F.size(vec) > 0, F.lit(False)) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    return embeddings.where(fine).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))


def _entries(rows: DataFrame, every: int, keep: int) -> DataFrame:
    """One row for each distinct vector: rep (its smallest id), ids (its ``keep`` smallest), asked (whether a query has it), vec."""
    pairs = rows.groupBy("vec", "id").agg(F.lit(1).alias("one"))
    small = pairs.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("place") <= keep)
    ids = small.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("vec").agg(F.lit(True).alias("asked"))
    return ids.join(queries, "vec", "left").select(F.col("ids")[0].alias("rep"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "vec")


def _sorted(entries: DataFrame, dimension: int, curves: int) -> DataFrame:
    """(curve, rank, rep, asked, vec): the entries in each ordering, ranked from 0."""
    made = orderings(dimension, curves)

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit = unit_rows(matrix(batch.column(2)))
        for c, ordering in enumerate(made):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(places(unit, ordering)), *batch.columns], names=["curve", "place", "rep", "asked", "vec"])

    kind = entries.schema["vec"].dataType.simpleString()
    rows = map_batches(entries.select("rep", "asked", "vec"), keyed, f"curve int, place long, rep long, asked boolean, vec {kind}")
    rows = rows.repartitionByRange("curve", "place", "rep").sortWithinPartitions("curve", "place", "rep")
    rows = session.cut(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")))
    # a row for each ordering and partition
    counts = rows.groupBy("curve", "part").agg(F.count("*").alias("many"), F.min("n").alias("first"))
    before = F.sum("many").over(Window.partitionBy("curve").orderBy("part")) - F.col("many")
    counts = counts.select("curve", "part", (before - F.col("first")).alias("offset"))
    return rows.join(F.broadcast(counts), ["curve", "part"]).select("curve", (F.col("n") + F.col("offset")).alias("rank"), "rep", "asked", "vec")


def _nearest_of(sample: list, entries: DataFrame, keep: int) -> list[tuple[int, int]]:
    """(query, neighbour) by brute force for a bounded list of (rep, vector)."""
    spark = entries.sparkSession
    given = spark.sparkContext.broadcast((np.array([r for r, _ in sample]), np.array([v for _, v in sample], np.float64)))

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        reps, vectors = given.value
        ids, found = single(batch.column(0)).to_numpy(), matrix(batch.column(1))
        unit = unit_rows(found)
        out = []
        for rep, vector in zip(reps, vectors, strict=True):
            at, score = best_rows(vector, unit @ (vector / np.linalg.norm(vector)), found, ids, ids != rep, keep)
            out += [(int(rep), int(ids[i]), float(s)) for i, s in zip(at, score, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["q", "rep", "score"])

    rows = map_batches(entries.select("rep", "vec"), search, "q long, rep long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    return [(r.q, r.rep) for r in rows.withColumn("place", place).where(F.col("place") <= keep).collect()]


def window_width(ranked: DataFrame, entries: DataFrame, keep: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """Places on either side of a query that hold ``recall`` of the sampled queries' neighbours, in the ordering where they are nearest."""
    asked = [(r.rep, r.vec) for r in entries.where("asked").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "vec").collect()]
    if not asked:
        return 0
    pairs = _nearest_of(asked, entries, keep)
    if not pairs:
        return 0
    reps = entries.sparkSession.createDataFrame([(r,) for r in sorted({x for p in pairs for x in p})], "rep long")
    rank: dict[int, dict[int, int]] = {}
    for r in ranked.select("curve", "rank", "rep").join(F.broadcast(reps), "rep").collect():
        rank.setdefault(r.rep, {})[r.curve] = r["rank"]
    away = sorted(min(abs(rank[a][c] - rank[b][c]) for c in rank[a]) for a, b in pairs)
    return away[min(len(away) - 1, int(np.ceil(recall * len(away))))] + 8


def _searched(ranked: DataFrame, width: int, keep: int) -> DataFrame:
    """(q, rep, score): for each query the best entries of each block that its windows touch."""
    block = lambda c: F.call_function("div", c, F.lit(BLOCK).cast("long"))
    rows = ranked.select("curve", block(F.col("rank")).alias("block"), "rank", "rep", "vec")
    touched = F.sequence(block(F.greatest(F.col("rank") - width, F.lit(0).cast("long"))), block(F.col("rank") + width))
    queries = ranked.where("asked").select(F.col("curve").alias("c"), F.explode(touched).alias("b"), F.col("rank").alias("at"), F.col("rep").alias("q"), F.col("vec").alias("asked"))

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and block.num_rows:
            ids, rank, vectors = block["rep"].to_numpy(), block["rank"].to_numpy(), matrix(block["vec"])
            unit = unit_rows(vectors)
            their_ids, their_rank, theirs = asked["q"].to_numpy(), asked["at"].to_numpy(), matrix(asked["asked"])
            for low in range(0, len(theirs), 256):
                scores = unit_rows(theirs[low : low + 256]) @ unit.T
                for i, score in enumerate(scores, low):
                    at, exact = best_rows(theirs[i], score, vectors, ids, (np.abs(rank - their_rank[i]) <= width) & (ids != their_ids[i]), keep)
                    out += [(int(their_ids[i]), int(ids[j]), float(s)) for j, s in zip(at, exact, strict=True)]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["q", "rep", "score"])

    return queries.groupBy("c", "b").cogroup(rows.groupBy("curve", "block")).applyInArrow(meet, "q long, rep long, score double")


def search(embeddings: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, width: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Candidates are all rows but those of the query's id; fewer than ``k`` give all. Nearest first, ties to smaller ids.
    Rows whose id is null, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    Vectors of different lengths don't meet. Repeated rows count once; of an id with several vectors each is a query and
    a candidate, and the id is found once, by its nearest. Other columns are not looked at.
    """
    rows = session.cut(valid(embeddings, key, vector))
    found = None
    for (dimension,) in sorted(tuple(r) for r in rows.select(F.size("vec")).distinct().collect()):
        part = _searched_of(rows.where(F.size("vec") == dimension), dimension, k, every, curves, width)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched_of(rows: DataFrame, dimension: int, k: int, every: int, curves: int, width: int | None) -> DataFrame:
    keep = k + 1
    entries = session.cut(_entries(rows, every, keep))
    ranked = _sorted(entries, dimension, curves)
    if width is None:
        width = window_width(ranked, entries, keep)
    near = _searched(ranked, width, keep).distinct()
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    near = near.withColumn("place", place).where(F.col("place") <= keep).select("q", "rep", "score")
    ids = entries.select(F.col("rep"), F.explode("ids").alias("vec_id"))
    # copies of the query's own vector are at its own cosine with itself
    itself = map_batches(entries.where("asked").select("rep", "vec"), _own_cosine, "q long, rep long, score double")
    offered = near.unionAll(itself).join(ids, "rep").select("q", "vec_id", "score")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    offered = offered.withColumn("place", best).where(F.col("place") <= 2 * keep).select("q", "vec_id", "score")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).distinct().join(entries.select("rep", "vec"), "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    return queries.join(offered, "q").where("query_id != vec_id").select("query_id", "vec_id", "score")


def _own_cosine(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Vectors' cosines with themselves, in the same steps as any other pair's."""
    vectors = matrix(batch.column(1))
    own = np.array([cosine(v[None, :], v)[0] for v in vectors])
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array(own)], names=["q", "rep", "score"])
