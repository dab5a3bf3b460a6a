"""Benchmark passages in documents: Wu-Manber search over words.

The patterns are the windows of ten words of each benchmark item (an item of fewer words is one window). For each
length of pattern there is a table of shifts by hashed block of two words: how far the search may go on when the
text shows that block at its position. A shift of nothing selects, by the block that ends them, the patterns that may
end there; their words are then compared one by one, spelled out. Many positions, one for each stretch of a text,
advance in step as arrays.

Patterns reach tasks in blocks of bounded size. More patterns than one block holds make further passes over the
documents, whose hits are merged; no pattern is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session
from opslake.llm import words as W
from opslake.llm.common import mix, pieces, single

#: Words of a window.
WINDOW = 10
#: Texts of benchmark items that one pass over the documents looks for, in bytes.
BLOCK_BYTES = 8 << 20
#: Words of text that one search position covers.
STRETCH = 256
_SHIFT_BITS = 20
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


class Patterns:
    """Windows of one length with their tables."""

    def __init__(self, spelled: list[tuple[bytes, ...]], items: list[list[str]], hashes: np.ndarray):
        self.spelled, self.items, self.words = spelled, items, hashes
        self.length = hashes.shape[1]
        self.block = min(2, self.length)
        self.shift = np.full(1 << _SHIFT_BITS, self.length - self.block + 1, np.int64)
        for end in range(self.block, self.length + 1):
            at = self._slot(self._joined(hashes[:, end - self.block : end]))
            self.shift[at] = np.minimum(self.shift[at], self.length - end)
        suffix = self._joined(hashes[:, self.length - self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _joined(self, block: np.ndarray) -> np.ndarray:
        return self.blocks(block.reshape(-1))[:: self.block]

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes) if self.block == 1 else W.runs(hashes, 2)

    def find(self, words: W.Words) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        blocks = self.blocks(words.hash)
        slots = self.shift[self._slot(blocks)]
        first, last = words.first[:-1], words.first[1:]
        long_enough = last - first >= self.length
        first, last = first[long_enough] + self.length, last[long_enough]
        # positions are where a window would end; each stretch of a text has its own
        many = -(-(last - first + 1) // STRETCH)
        text = np.repeat(np.arange(len(first)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = first[text] + nth * STRETCH
        stop = np.minimum(at + STRETCH, last[text] + 1)
        while len(at):
            step = slots[at - self.block]
            stand = at[step == 0]
            if len(stand):
                ended = blocks[stand - self.block]
                low, high = np.searchsorted(self.suffix, ended, "left"), np.searchsorted(self.suffix, ended, "right")
                many = high - low
                where = np.repeat(stand, many)
                nth = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
                which = self.order[np.repeat(low, many) + nth]
                for k in range(self.length):
                    same = self.words[which, k] == words.hash[where - self.length + k]
                    where, which = where[same], which[same]
                for end, pattern in zip(where.tolist(), which.tolist(), strict=True):
                    if all(words.spelled(end - self.length + k) == w for k, w in enumerate(self.spelled[pattern])):
                        yield end - self.length, pattern
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Tables of the windows of (id, text)s, by length. Items without words have no window."""
    found: dict[tuple[bytes, ...], tuple[np.ndarray, set[str]]] = {}
    for item, text in items:
        read = W.read(pa.array([text], pa.string()))
        spelled = [read.spelled(i) for i in range(len(read.hash))]
        size = min(window, len(spelled))
        for i in range(len(spelled) - size + 1 if size else 0):
            found.setdefault(tuple(spelled[i : i + size]), (read.hash[i : i + size], set()))[1].add(item)
    by_length: dict[int, list] = {}
    for spelled, (hashes, ids) in found.items():
        by_length.setdefault(len(spelled), []).append((spelled, sorted(ids), hashes))
    return [Patterns([x[0] for x in g], [x[1] for x in g], np.stack([x[2] for x in g])) for _, g in sorted(by_length.items())]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Distinct items in blocks of about ``limit`` bytes of text, so many as it takes."""
    rows = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).cast("long")).first()[0]
    count = max(1, -(-size // limit))
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [tuple(r) for r in part.collect()]


def _search(docs: DataFrame, patterns: list[Patterns], spans: bool) -> DataFrame:
    """Per document row: id, words, and either hit words and item ids, or the hit stretches themselves, for merging."""
    tables = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        for batch in batches:
            texts, ids = single(batch.column("text")), single(batch.column("row"))
            for low, high in pieces(texts):
                read = W.read(texts[low:high])
                mark = np.zeros(len(read.hash) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(high - low)]
                for table in tables.value:
                    for first, pattern in table.find(read):
                        mark[first] += 1
                        mark[first + table.length] -= 1
                        items[int(np.searchsorted(read.first, first, "right")) - 1].update(table.items[pattern])
                hit = np.cumsum(mark[:-1]) > 0
                n_words = np.diff(read.first)
                columns = [ids[low:high], pa.array(n_words)]
                if spans:
                    edges = [np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b], [0]]))) for a, b in zip(read.first[:-1], read.first[1:], strict=True)]
                    columns += [pa.array([[{"a": a, "b": b} for a, b in e.reshape(-1, 2).tolist()] for e in edges], _SPANS)]
                else:
                    total = np.concatenate([[0], np.cumsum(hit)])
                    columns += [pa.array(total[read.first[1:]] - total[read.first[:-1]])]
                columns += [pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "spans" if spans else "n_hit", "items"])

    return docs.mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, n_words long, " + ("spans array<struct<a:long,b:long>>" if spans else "n_hit long") + ", items array<string>")


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``key``, n_words, n_hit, items (sorted ids of items with occurring windows).

    Null and empty texts have no words. Equal item ids with different texts are one item. Items with a null id or
    text are passed over. Each row of ``docs`` gives a row; columns besides ``key`` and text are not looked at. With
    more than one block of patterns, rows of one key and text are taken as one document each, told apart by number.
    """
    rows = docs.select(F.col(key).alias("row"), F.col("text").alias("text"))
    blocks = _blocks(benchmark.select("item_id", "text"), block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _search(rows, build(first), spans=False).withColumnRenamed("row", key)
    numbered = session.cut(rows.select(F.struct("row", F.monotonically_increasing_id().alias("n")).alias("row"), "text"))
    parts = [_search(numbered, build(b), spans=True) for b in (first, second)] + [_search(numbered, build(b), spans=True) for b in blocks]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionAll(part)
    merged = merged.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # the union of stretches: sorted by start, each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")
        ), lambda s: s["n"],
    )
    return merged.select(F.col("row.row").alias(key), "n_words", covered.alias("n_hit"), "items")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result of ``search`` with the items as their number and a hash."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in whose text no window occurs, as they are."""
    for block in _blocks(benchmark.select("item_id", "text"), block_bytes):
        docs = _without(docs, build(block))
    return docs


def _without(docs: DataFrame, patterns: list[Patterns]) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        for batch in batches:
            texts, keep = single(batch.column("text")), np.ones(batch.num_rows, bool)
            for low, high in pieces(texts):
                read = W.read(texts[low:high])
                for table in tables.value:
                    for first, _ in table.find(read):
                        keep[low + int(np.searchsorted(read.first, first, "right")) - 1] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
