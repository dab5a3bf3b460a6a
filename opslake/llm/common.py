"""What the operators share: tables, Arrow batches cut by size, hashing, bounded bitmaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once, besides one text that is longer.
PIECE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and take Arrow batches of few texts at once.

    Joins split hot keys also where a grouping on the same keys stands before or after them.
    """
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def pieces(column: pa.Array, limit: int = PIECE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``rows`` and ``limit`` bytes of text, or of one longer row: (first row, end row)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(sizes, before + limit, side="right"))))
        yield start, end
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column after one another, and where each row begins (one more than rows). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def single(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


class Bitmap:
    """A Bloom filter of one hash in a fixed number of bits, built by an aggregation.

    What it lets through holds all keys it was built of, and more as it fills; results never depend on it.
    Its size does not grow with the data.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = int(len(words) * 64).bit_length() - 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    @staticmethod
    def of(df: DataFrame, key: str, bits: int = 24) -> Bitmap:
        """Of the long column ``key``: at most 2^(bits-6) rows reach the driver."""

        def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys = single(pc.drop_null(batch.column(0))).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(mix(keys) >> np.uint64(64 - bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        rows = map_batches(df.select(key), places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
        return Bitmap(words)
