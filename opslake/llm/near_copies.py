"""Near copies by weighted MinHash: BagMinHash signatures, bands, and a check of the multisets.

A text is the multiset of its shingles of five words; two texts are near copies if the weighted Jaccard similarity of
their multisets, the sum of the lower counts over that of the higher ones, is at least 0.8.

Signatures follow BagMinHash. The weights of a shingle are cut into levels [0, 1), [1, 2), [2, 4), [4, 8) ...; each
level of each shingle has a Poisson process of its own, seeded by both, whose rate is the level's width. Points of the
process carry a weight within the level and a component; a text takes the points below its count of the shingle, and
a component's value is its earliest point. So a count costs as many processes as it has levels, two texts agree in a
component with the probability of their weighted Jaccard similarity, and a process ends once its next point comes after
all components have earlier ones.

Texts of one multiset are one entry. Bands of components put entries into buckets. In a bucket each entry is compared
with the smallest one only; verified pairs make classes; then entries of a bucket that are in different classes are
compared with one another, in blocks, so that no link between classes is missed. Pairs whose signatures are far from
the threshold are passed over; the rest are verified on the multisets themselves, the most similar ones first: what
those link needs no further pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake import session
from opslake.llm import words as W
from opslake.llm.common import Bitmap, map_batches, mix, pieces, single
from opslake.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8^5)^24, below one in ten thousand.
BANDS, ROWS = 24, 5
#: Components of a signature; the first of them make the bands, and all of them the sketch.
COMPONENTS = 360
#: Share of components that a pair has to agree in to be verified: four deviations below the threshold.
LIKELY = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / COMPONENTS) ** 0.5
#: Candidates of other classes that an entry is verified with, round by round; the last round takes all that are left.
ROUNDS = (4, None)
#: Entries of a bucket that meet in one task, and multisets of either side that do.
BLOCK, MULTISETS = 1024, 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def counted_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of a column, sorted. A text of fewer than five words, but not none, is one shingle."""
    read = W.read(column)
    size = np.diff(read.first)
    text = read.text
    found, of = [], []
    for n in range(1, SHINGLE + 1):
        run = W.runs(read.hash, n)
        at = np.arange(len(run))
        inside = (at + n <= read.first[1:][text[: len(run)]]) & ((size == n) if n < SHINGLE else (size >= n))[text[: len(run)]]
        found.append(run[inside] ^ mix(np.full(1, n, np.uint64)))
        of.append(text[: len(run)][inside])
    shingle, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return of[first], shingle[first], np.diff(np.append(first, len(of)))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, components: int = COMPONENTS) -> np.ndarray:
    """The earliest point of each component, by text; infinite for texts without shingles."""
    levels = np.frexp(np.maximum(count - 1, 0).astype(np.float64))[1] + 1  # levels that begin below the count
    at = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    width = np.where(level == 0, 1.0, low)
    of, limit = text[at], (count[at] - low) / width
    with np.errstate(over="ignore"):
        seed = mix(shingle[at] ^ mix((level + 1).astype(np.uint64) * _GOLDEN))
    time = np.zeros(len(at))
    earliest = np.full(texts * components, np.inf)
    last = np.full(texts, np.inf)
    step = 0
    while len(of):
        step += 1
        with np.errstate(over="ignore"):
            a = mix(seed + np.uint64(2 * step) * _GOLDEN)
            b = mix(seed + np.uint64(2 * step + 1) * _GOLDEN)
        # 53 bits of one number make the wait; the other gives the component and the weight within the level
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        component = (b >> np.uint64(32)) % np.uint64(components)
        weight = (b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        taken = weight < limit
        np.minimum.at(earliest, of[taken] * components + component[taken].astype(np.int64), time[taken])
        running = np.unique(of) if step > 8 else slice(None)
        last[running] = earliest.reshape(texts, components)[running].max(axis=1)
        on = time < last[of]
        of, seed, time, width, limit = of[on], seed[on], time[on], width[on], limit[on]
    return earliest.reshape(texts, components)


def agreement(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands, and eight bits of each component."""
    bits = mix(signature.view(np.uint64))
    bands = np.zeros((len(bits), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            bands = mix(bands * _GOLDEN + bits[:, row * BANDS : (row + 1) * BANDS])
    return bands, (bits >> np.uint64(56)).astype(np.uint8)


def units(text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, unit): a shingle that occurs n times has n units, the same ones in every text, so that multisets compare as sets."""
    at = np.repeat(np.arange(len(text)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return text[at], mix(shingle[at] + mix(nth.astype(np.uint64)))


def _lists(of: np.ndarray, values: np.ndarray, texts: int) -> pa.Array:
    offsets = np.searchsorted(of, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def signed(rows: DataFrame) -> DataFrame:
    """(id, a, b, n, bands, sketch) of (id, text) with words: a, b and n stand for the multiset."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = single(batch.column(0)), single(batch.column(1))
        for low, high in pieces(texts, rows=4096):
            of, shingle, count = counted_shingles(texts[low:high])
            many = high - low
            total = np.bincount(of, count, many).astype(np.int64)
            sums = []
            with np.errstate(over="ignore"):
                for salt in (1, 2):
                    sums.append(np.zeros(many, np.uint64))
                    np.add.at(sums[-1], of, mix(mix(shingle + np.uint64(salt)) + count.astype(np.uint64)))
            bands, sketch = agreement(signatures(of, shingle, count, many))
            worded = pa.array(total > 0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            sketches = pa.array([s.tobytes() for s in sketch], pa.binary())
            columns = [ids[low:high], *[pa.array(s.view(np.int64)) for s in sums], pa.array(total), flat, sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "n", "bands", "sketch"]).filter(worded)

    return map_batches(rows, run, "id long, a long, b long, n long, bands array<long>, sketch binary")


def _likely(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b, ...) of those whose sizes and signatures allow the threshold."""
    one = entries.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    two = entries.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    joined = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for i in (2, 3))
        yield batch.filter(pa.array((one == two).mean(axis=1) >= LIKELY)).select(["a", "b"])

    return map_batches(joined.select("a", "b", "sketch_a", "sketch_b"), run, "a long, b long")


def _multisets(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, units) of at least the rows whose ids are asked for. ``rows``: (id, text)."""
    wanted = rows.sparkSession.sparkContext.broadcast(Bitmap.of(ids, "id"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = single(batch.column(0)).to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(wanted.value.has(ids.astype(np.int64).view(np.uint64))))
        ids, texts = single(batch.column(0)), single(batch.column(1))
        for low, high in pieces(texts):
            of, unit = units(*counted_shingles(texts[low:high]))
            yield pa.RecordBatch.from_arrays([ids[low:high], _lists(of, unit.view(np.int64), high - low)], names=["id", "units"])

    return map_batches(rows, run, "id long, units array<long>")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) of the pairs of ids whose multisets are near copies."""
    multisets = _multisets(pairs.select(F.explode(F.array("a", "b")).alias("id")), rows)
    one = multisets.select(F.col("id").alias("a"), F.col("units").alias("one"))
    two = multisets.select(F.col("id").alias("b"), F.col("units").alias("two"))
    joined = pairs.join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("one", "two"))
    return joined.where(shared >= THRESHOLD * (F.size("one") + F.size("two") - shared)).select("a", "b")


def verified_in_blocks(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for (main, a, b) with many pairs of the same entries: a multiset moves once for each block that it meets.

    The entries of either side of a ``main`` are dealt over blocks; a task has a block of each and their pairs.
    """
    counts = pairs.groupBy("main").agg(F.count_distinct("a").alias("many_a"), F.count_distinct("b").alias("many_b"))
    counts = counts.withColumnRenamed("main", "m")
    block = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col(f"many_{c}") / MULTISETS))
    dealt = session.cut(pairs.join(counts, F.col("main") == F.col("m")).select("main", block("a").alias("of_a"), block("b").alias("of_b"), "a", "b"))
    keys = ["main", "of_a", "of_b"]
    asked = dealt.select(*keys, F.col("a").alias("id")).unionAll(dealt.select(*keys, "b"))
    needed = asked.distinct()
    units_of = _multisets(asked.select("id"), rows).withColumnRenamed("id", "of")
    held = needed.join(units_of, F.col("id") == F.col("of")).select(*[F.col(k).alias(f"{k}_") for k in keys], "id", "units")

    def meet(wanted: pa.Table, have: pa.Table) -> pa.Table:
        multisets: dict[int, list[np.ndarray]] = {}
        for i, u in zip(have["id"].to_pylist(), have["units"].combine_chunks() if have.num_rows else [], strict=True):
            multisets.setdefault(i, []).append(np.sort(u.values.to_numpy()))

        def close(one: np.ndarray, two: np.ndarray) -> bool:
            at = np.minimum(np.searchsorted(two, one), len(two) - 1)
            shared = int((two[at] == one).sum())
            return shared >= THRESHOLD * (len(one) + len(two) - shared)

        asked = zip(wanted["a"].to_pylist(), wanted["b"].to_pylist(), strict=True)
        near = [(a, b) for a, b in asked if any(close(one, two) for one in multisets.get(a, []) for two in multisets.get(b, []))]
        return pa.table([pa.array([x[i] for x in near], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.groupBy(*keys).cogroup(held.groupBy(*[f"{k}_" for k in keys])).applyInArrow(meet, "a long, b long")


def _across(buckets: DataFrame, classes: DataFrame, entries: DataFrame, most: int | None) -> DataFrame:
    """(main, a, b): likely pairs of entries that share a bucket and are of different classes; of an entry the ``most`` similar ones.

    ``main`` is the class that most entries of such a bucket are of.

    In each bucket the entries outside its most frequent class are asked against all entries of the bucket, in blocks.
    """
    named = buckets.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    sizes = named.groupBy("band", "bucket", "class").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("band", "bucket").agg(F.max_by("class", F.struct("size", "class")).alias("main"), F.count("*").alias("classes"), F.sum("size").alias("size")).where("classes > 1")
    members = session.cut(named.join(mixed.select("band", "bucket", "main", "size"), ["band", "bucket"]).join(entries.select("id", "sketch", "n", "bands"), "id"))
    blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("size") / BLOCK))
    have = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    ask = members.where("class != main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    ask = ask.select(*[F.col(c).alias(f"{c}_") for c in ("band", "bucket", "block", "id", "class", "sketch", "n", "bands")])

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        out_a, out_b, out_share, main = [], [], [], []
        if asked.num_rows and block.num_rows:
            ids, cls, n = (block[c].to_numpy() for c in ("id", "class", "n"))
            sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint8).reshape(-1, COMPONENTS)
            band, bands = block["band"][0].as_py(), np.array(block["bands"].to_pylist(), np.int64)
            waits = cls == block["main"][0].as_py()
            for i, c, m, s, b in zip(*(asked[f"{x}_"].to_pylist() for x in ("id", "class", "n", "sketch", "bands")), strict=True):
                # a pair counts in the first bucket that it shares; of two that ask for one another, the greater asks
                sizes = np.minimum(n, m) >= THRESHOLD * np.maximum(n, m)
                earlier = (bands[:, :band] == np.array(b[:band], np.int64)).any(axis=1)
                fits = np.flatnonzero((cls != c) & sizes & ~earlier & (waits | (ids < i)))
                agreed = (sketch[fits] == np.frombuffer(s, np.uint8)).mean(axis=1)
                near = np.flatnonzero(agreed >= LIKELY)
                if most is not None and len(near) > most:
                    near = near[np.argsort(-agreed[near], kind="stable")[:most]]
                out_a += [i] * len(near)
                out_b += ids[fits[near]].tolist()
                out_share += agreed[near].tolist()
            main = [block["main"][0].as_py()] * len(out_a)
        return pa.table([pa.array(main, pa.int64()), pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_share, pa.float64())], names=["main", "a", "b", "share"])

    keys = ["band", "bucket", "block"]
    found = ask.groupBy(*[f"{k}_" for k in keys]).cogroup(have.groupBy(*keys)).applyInArrow(meet, "main long, a long, b long, share double")
    found = found.groupBy("a", "b").agg(F.min("main").alias("main"), F.max("share").alias("share"))
    if most is not None:
        best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("share"), "b"))
        found = found.withColumn("place", best).where(F.col("place") <= most)
    return found.select("main", "a", "b")


def _classes(docs: DataFrame, key: str) -> DataFrame:
    """(id, class) of the ids that have a text with words, each once: ``class`` is the smallest id that links lead to.

    What a step has shuffled or written is released before the next one that shuffles much.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), "text")
    entries_all = session.cut(signed(known))
    copies = entries_all.groupBy("a", "b", "n").agg(F.min("id").alias("rep"))
    membership = session.cut(entries_all.select("id", "a", "b", "n").join(copies, ["a", "b", "n"]).select("id", "rep").distinct())
    # an id that is the first of several multisets has an entry for each of them
    reps = entries_all.join(copies, ["a", "b", "n"]).where("id = rep").dropDuplicates(["id", "a", "b", "n"])
    entries = session.cut(reps.select("id", "n", "bands", "sketch"))
    del entries_all, copies, reps
    session.release(spark)
    banded = entries.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = banded.groupBy("band", "bucket").agg(F.min("id").alias("hub"), F.count("*").alias("many")).where("many > 1").select("band", "bucket", "hub")
    buckets = session.cut(banded.join(hubs, ["band", "bucket"]))
    session.release(spark)
    first = session.cut(_likely(buckets.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), entries))
    session.release(spark)
    first_of = membership.groupBy("id").agg(F.min("rep").alias("a"))
    several = membership.join(first_of, "id").where("a != rep").select("a", F.col("rep").alias("b"))
    classes = components(verified(first, known).unionAll(several))
    for most in ROUNDS:
        session.release(spark)
        more = session.cut(_across(buckets, classes, entries, most))
        if more.isEmpty():  # nor does a later round find any
            break
        session.release(spark)
        # a node and its class stand for all links that led there
        held = classes.select(F.col("node").alias("a"), F.col("class").alias("b"))
        classes = components(held.unionAll(verified_in_blocks(more, known)))
    session.release(spark)
    return first_of.join(classes, F.col("a") == F.col("node"), "left").select("id", F.coalesce("class", "a").alias("class"))


def classes_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``key``, class_id: the smallest id of the documents that links lead to.

    Null texts and texts without words are near copies of nothing. Rows of one id are one document, near to what any of
    its texts is a copy of; rows without an id have no class. Other columns are not looked at.
    """
    joined = docs.select(F.col(key).alias("key")).join(_classes(docs, key), F.col("key") == F.col("id"), "left")
    return joined.select(F.col("key").alias(key), F.coalesce("class", F.col("key").cast("long")).alias("class_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't near copies of a document with a smaller id, as they are; rows without an id stay."""
    copies = _classes(docs.select(key, "text"), key).where("id != class").select(F.col("id").alias(key))
    return docs.join(copies, key, "left_anti").select(*docs.columns)
