"""Repeated byte strings, by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus (at a smaller id, or earlier
in the same document) is removed.

A rolling hash over ``TRIGGER`` bytes picks triggers: in each string of ``LENGTH`` bytes the trigger is where the hash
is least. It depends on the string's bytes only, so equal strings have equal triggers at equal places. All strings of
one trigger make a phrase, from the first byte of the first string to the last byte of the last. The parse is the list
of phrases of each document, the dictionary the distinct phrases with their first place. As in prefix-free parsing,
the order of the corpus' strings follows from the two:

- a phrase of the dictionary that stands at a later place is repeated as a whole, with all strings in it;
- at its first place, a phrase can only repeat strings of other phrases with the same trigger. The dictionary's
  phrases of a trigger are sorted by their suffixes' first ``LENGTH`` bytes (as hashes, so that equal ones are
  neighbours), and among equal ones by place in the parse; all but the first are repeated.

So every text is parsed once, and its phrases travel once, as hashes of fixed size. Places of phrases that share a
trigger go back to their texts by id, and only there bytes are read: those of a trigger's phrases meet in one group, but
for triggers of very many phrases, whose strings are dealt one by one. What else travels is counted by what repeats;
bitmaps of ids only spare texts the way that need not go. Equal hashes (128 bits) count as equal bytes.

What travels is packed: a row has up to ``TOGETHER`` records of one bucket, and a bucket has about as many whatever the
size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake import session
from opslake.llm.common import Bitmap, map_batches, mix, pieces, single, text_bytes
from opslake.operators import scan

#: Bytes of a string that counts as repeated, and of a trigger. They differ by less than 127.
LENGTH, TRIGGER = 100, 32
#: Phrases that a trigger has at least for its strings to be dealt one by one.
HOT = 20_000
#: Texts that one id may have; rows of a table that is broadcast.
VERSIONS, SMALL = 1 << 25, 1 << 21
#: Bytes that a task parses at once: its arrays fit a core's cache.
PIECE_BYTES = 64 << 10
#: Phrases that a task gathers before it deals them, records of a row, phrases with their bytes of a row, strings compared at once.
GATHERED, TOGETHER, SPELLED, COMPARED = 1 << 18, 256, 64, 1 << 18
#: Bytes of texts, and phrases with their bytes, that a task deals at once.
TEXT_BYTES, BYTES_OF = 8 << 20, 1 << 13
#: What travels: hashes at a place, a place to be removed, a phrase that shares its trigger.
_HASHED = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("place", "<i8")])
_LATER = np.dtype([("id", "<i8"), ("place", "<i8")])
_SHARED = np.dtype([("a", "<u8"), ("id", "<i8"), ("place", "<i8"), ("hot", "?")])
_KINDS = [_HASHED, _LATER, _SHARED]
_DEALT = "bucket int, kind int, head binary, bytes binary"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_LETTERS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(2, 256)


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if lane not in _POWERS or len(_POWERS[lane][0]) < n:
        base = _BASES[lane]
        with np.errstate(over="ignore"):
            _POWERS[lane] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[lane]


class Rolling:
    """Hashes of any stretch of some bytes, by sums of powers modulo 2^64."""

    def __init__(self, data: np.ndarray, lane: int):
        up, self.down = _powers(lane, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_LETTERS[lane][data] * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        count = max(0, len(self.total) - size)
        with np.errstate(over="ignore"):
            return mix((self.total[size:] - self.total[:count]) * self.down[:count])


@dataclass
class Phrases:
    """``low`` and ``high``: first and last place where a string of ``LENGTH`` bytes begins whose trigger is this phrase's."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trigger: np.ndarray
    first: Rolling
    data: np.ndarray

    @cached_property
    def second(self) -> Rolling:
        """Only the passes that hash phrases or strings need it."""
        return Rolling(self.data, 1)


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> Phrases | None:
    starts = len(data) - length + 1
    if starts <= 0:
        return None
    first = Rolling(data, 0)
    hashes = first.windows(trigger)
    reach = length - trigger + 1
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    key = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    # the least key of each ``reach`` in a row, of stretches that double
    least, size = key, 1
    while 2 * size <= reach:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[:starts], least[reach - size :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = row[:starts] == row[length - 1 :]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    low, high = np.flatnonzero(new), np.flatnonzero(ends)
    return Phrases(row[low], low, high, hashes[at[low]], first, data)


def place(low: np.ndarray, version: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A phrase's first byte, version of the text and strings as one number that sorts by the first."""
    return low.astype(np.int64) << 32 | version.astype(np.int64) << 7 | many


def _phrases(batch: pa.RecordBatch, length: int, trigger: int) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases, id, place, bytes) of each piece of a batch of (id, version, text). A long text is read in pieces that overlap by a string."""
    ids, versions = (single(batch.column(i)).to_numpy(zero_copy_only=False) for i in (0, 1))
    texts = single(batch.column(2))
    for first, end in pieces(texts, PIECE_BYTES):
        data, offsets = text_bytes(texts[first:end])
        step = len(data) if end - first > 1 else PIECE_BYTES
        for at in range(0, max(len(data), 1), max(step, 1)):
            part = data[at : at + step + length - 1] if step < len(data) else data
            found = parse(part, offsets if part is data else np.array([0, len(part)]), length, trigger)
            if found is not None and len(found.low):
                row = found.text + first
                inside = found.low - (offsets[found.text] if part is data else -at)
                yield found, ids[row], place(inside, versions[row], found.high - found.low + 1), part


def _records(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns["id"]), kind)
    for name, values in columns.items():
        out[name] = values
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _cells(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Bytes of ``values`` as binary cells, each from one of ``first`` to the next."""
    ends = np.append(first, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _runs(new: np.ndarray, limit: int) -> np.ndarray:
    """Where runs begin, cut after each ``limit`` places."""
    at = np.arange(len(new))
    return np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % limit == 0)


def _stretches(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another."""
    return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _dealt(keys: np.ndarray, buckets: int, rows: np.ndarray, data: np.ndarray | None = None, start: np.ndarray | None = None, sizes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Records as rows of ``_DEALT``, by the bucket of their key; with stretches of ``data`` if those are given."""
    if not len(rows):
        return
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    first = _runs(new, TOGETHER if data is None else SPELLED)
    if data is None:
        spelled = pa.nulls(len(first), pa.binary())
    else:
        sizes = sizes[order]
        spelled = _cells(data[_stretches(start[order], sizes)], (np.cumsum(sizes) - sizes)[first])
    kind = np.full(len(first), _KINDS.index(rows.dtype), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(kind), _cells(rows, first), spelled], names=["bucket", "kind", "head", "bytes"])


def _read(rows: pa.Table, kind: np.dtype) -> np.ndarray:
    cells = rows.filter(pc.equal(rows["kind"], _KINDS.index(kind)))["head"]
    return text_bytes(single(cells))[0].view(kind)


def _groups(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on whole buckets of sorted rows; the last bucket of a batch waits for the next batch."""

    def run(batches):
        waiting = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            borders = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            if waiting and len(bucket) and bucket[0] != waiting[-1].column("bucket")[0].as_py():
                borders = np.concatenate([[0], borders])
            if len(borders):
                at = int(borders[-1])
                yield from work(pa.Table.from_batches([*waiting, batch.slice(0, at)]))
                waiting, batch = [], batch.slice(at)
            if batch.num_rows:
                waiting.append(batch)
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


def _grouped(dealt: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups(work), schema)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of keys that occur once, and of all others."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    several = np.zeros(len(keys), bool)
    several[1:] = same
    several[:-1] |= same
    return order[~several], order[several]


def _apart(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of ``_HASHED`` rows: those whose ``a`` occurs once; the first place of each other (a, b), sorted; its other places."""
    alone, some = _repeated(rows["a"])
    some = some[np.lexsort([rows[c][some] for c in ("place", "id", "b", "a")])]
    a, b, ids, places = (rows[c][some] for c in ("a", "b", "id", "place"))
    new = np.ones(len(some), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    mine = first[np.cumsum(new) - 1]
    return alone, some[first], some[(ids != ids[mine]) | (places != places[mine])]


def _removed(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    return _dealt(rows["id"], buckets, _records(_LATER, id=rows["id"], place=rows["place"]))


def _hashed(rows: np.ndarray, by: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Deals the first place here of each (a, b); later ones can't be the first of all."""
    alone, first, later = _apart(rows)
    rest = rows[np.concatenate([alone, first])]
    yield from _dealt(rest[by], buckets, rest)
    yield from _removed(rows[later], buckets)


def _phrases_told(hot: int, buckets: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Of hashed phrases: later places of a phrase, and first places of phrases that share a trigger, dealt by id."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _removed(_read(rows, _LATER), buckets)
        found = _read(rows, _HASHED)
        _, first, later = _apart(found)
        yield from _removed(found[later], buckets)
        _, which, many = np.unique(found["a"][first], return_inverse=True, return_counts=True)
        many = many[which]
        first, many = first[many > 1], many[many > 1]
        shared = found[first]
        yield from _dealt(shared["id"], buckets, _records(_SHARED, a=shared["a"], id=shared["id"], place=shared["place"], hot=many > hot))

    return work


def _by_text(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by id, version and place; where a text begins; the versions, in order."""
    version = places >> 7 & (VERSIONS - 1)
    order = np.lexsort((places, version, ids))
    ids, version = ids[order], version[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (version[1:] != version[:-1])
    return order, new, version


_LISTS = "i long, v long, head binary"


def _shared_lists(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The phrases of each text that share a trigger."""
    found = _read(rows, _SHARED)
    order, new, version = _by_text(found["id"], found["place"])
    found, first = found[order], np.flatnonzero(new)
    yield pa.RecordBatch.from_arrays([pa.array(found["id"][first]), pa.array(version[first]), _cells(found, first)], names=["i", "v", "head"])


def _span_lists(length: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Maximal runs of the bytes of each text that are removed, as pairs of numbers."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _read(rows, _LATER)
        order, new, version = _by_text(found["id"], found["place"])
        ids, places = found["id"][order], found["place"][order]
        low = places >> 32
        # the end of what is removed so far in a text; texts are in order, so that one maximum runs over all
        text = np.cumsum(new) << 32
        high = np.maximum.accumulate(text + low + (places & 127) + (length - 1))
        begins = new.copy()
        begins[1:] |= text[1:] + low[1:] > high[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(ids))[: len(first)] - 1
        spans = np.ascontiguousarray(np.stack([low[first], high[last] - text[last]], axis=1)).ravel()
        texts = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(ids[texts]), pa.array(version[texts]), _cells(spans, 2 * np.searchsorted(first, texts))], names=["i", "v", "head"])

    return work


def _spelled(length: int, buckets: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Of (text, phrases of it that share a trigger): phrases with their bytes, dealt by trigger; the strings of hot ones, dealt one by one."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin, end in pieces(single(batch.column(0)), TEXT_BYTES):
            data, offsets = text_bytes(single(batch.column(0))[begin:end])
            heads, ends = text_bytes(single(batch.column(1))[begin:end])
            every = heads.view(_SHARED)
            texts = np.repeat(offsets[:-1], np.diff(ends) // _SHARED.itemsize)
            for at in range(0, len(every), BYTES_OF):
                found = every[at : at + BYTES_OF]
                start, many = texts[at : at + len(found)] + (found["place"] >> 32), found["place"] & 127
                cold = ~found["hot"]
                yield from _dealt(found["a"][cold], buckets, found[cold], data, start[cold], many[cold] + length - 1)
                if not cold.all():
                    yield from _hashed(_strings(found[~cold], data[_stretches(start[~cold], many[~cold] + length - 1)], length), "b", buckets)

    return run


def _strings(found: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """All strings of some phrases, whose bytes are ``data``, as ``_HASHED`` rows."""
    many = found["place"] & 127
    sizes = many + length - 1
    at = _stretches(np.cumsum(sizes) - sizes, many)
    block = np.repeat(np.arange(len(found)), many)
    places = place(_stretches(found["place"] >> 32, many), (found["place"] >> 7 & (VERSIONS - 1))[block], np.ones(len(block), np.int64))
    return _records(_HASHED, a=Rolling(data, 0).of(at, at + length), b=Rolling(data, 1).of(at, at + length), id=found["id"][block], place=places)


def _compared(found: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Of phrases in the order of trigger, id and place, whose bytes are ``data``: strings that an earlier phrase of the trigger, or the same one, holds."""
    many = found["place"] & 127
    sizes = many + length - 1
    at = _stretches(np.cumsum(sizes) - sizes, many)
    block = np.repeat(np.arange(len(found)), many)
    string, trigger = Rolling(data, 1).of(at, at + length), found["a"][block]
    _, some = _repeated(string ^ mix(trigger))
    some = np.sort(some)
    some = some[np.lexsort((string[some], trigger[some]))]  # stable: equal strings stay in the order of the parse
    t, s = trigger[some], string[some]
    later = np.sort(some[1:][(t[1:] == t[:-1]) & (s[1:] == s[:-1])])
    new = np.ones(len(later), bool)
    new[1:] = (later[1:] != later[:-1] + 1) | (block[later[1:]] != block[later[:-1]])
    first = later[new]
    runs = np.diff(np.append(np.flatnonzero(new), len(later)))
    of = found[block[first]]
    nth = first - (np.cumsum(many) - many)[block[first]]
    return _records(_LATER, id=of["id"], place=place((of["place"] >> 32) + nth, of["place"] >> 7 & (VERSIONS - 1), runs))


def _strings_told(length: int, buckets: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Of phrases with their bytes, and of hashed strings: the strings that are not the first, dealt by id."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _removed(_read(rows, _LATER), buckets)
        strings = _read(rows, _HASHED)
        yield from _removed(strings[_apart(strings)[2]], buckets)
        found = _read(rows, _SHARED)
        data = text_bytes(single(rows.filter(pc.equal(rows["kind"], _KINDS.index(_SHARED)))["bytes"]))[0]
        sizes = (found["place"] & 127) + length - 1
        start = np.cumsum(sizes) - sizes
        order = np.lexsort((found["place"], found["id"], found["a"]))
        found, start, sizes = found[order], start[order], sizes[order]
        once = np.ones(len(found), bool)
        once[1:] = found[1:] != found[:-1]
        found, start, sizes = found[once], start[once], sizes[once]
        new = np.ones(len(found), bool)
        new[1:] = found["a"][1:] != found["a"][:-1]
        triggers = np.flatnonzero(new)
        many = found["place"] & 127
        nth = (np.cumsum(many) - many)[triggers] // COMPARED  # whole triggers together, until they have that many strings
        cuts = np.append(triggers[np.flatnonzero(np.diff(nth, prepend=-1))], len(found))
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _removed(_compared(found[at:to], data[_stretches(start[at:to], sizes[at:to])], length), buckets)

    return work


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: smaller than a checkpoint, and as safe from lost executors."""
    path = session.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def holders(lists: DataFrame) -> Broadcast:
    return lists.sparkSession.sparkContext.broadcast(Bitmap.of(lists, "i"))


def holding(rows: DataFrame, ids: Broadcast, wanted: bool = True) -> DataFrame:
    """Rows whose id is among ``ids``, and perhaps some others; or the rest of them."""
    at = rows.columns.index("id")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(ids.value.has(single(batch.column(at)).to_numpy(zero_copy_only=False).view(np.uint64)) == wanted))

    return map_batches(rows, run, rows.schema)


def with_lists(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return rows.join(lists, (F.col("id") == F.col("i")) & (F.col("version") == F.col("v")), how)


def repeated_spans(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """(i, v, head): id, version and stretches of bytes to remove, pairs of numbers in order, of (id, version, text) without nulls."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    phrases = 2 * total // (length - trigger + 2)
    buckets = max(16, min(phrases >> 17, 1 << 12), phrases >> 20)
    fewer = max(16, buckets // 2)  # for what is a small part of all phrases

    def located(batches):
        waiting, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for found, ids, places, _ in _phrases(batch, length, trigger):
                waiting.append(_records(_HASHED, a=found.trigger, b=found.second.of(found.low, found.high + length), id=ids, place=places))
                n += len(ids)
                if n >= GATHERED:
                    yield from _hashed(np.concatenate(waiting), "a", buckets)
                    waiting, n = [], 0
        if waiting:
            yield from _hashed(np.concatenate(waiting), "a", buckets)

    found = written(_grouped(rows.mapInArrow(located, _DEALT), _phrases_told(hot, fewer), _DEALT), "phrases")
    session.release(rows.sparkSession)
    lists = written(_grouped(found.where(F.col("kind") == _KINDS.index(_SHARED)), _shared_lists, _LISTS), "shared")
    texts = with_lists(holding(rows, holders(lists)), lists, "inner").select("text", "head")
    strings = _grouped(map_batches(texts, _spelled(length, fewer), _DEALT), _strings_told(length, fewer), _DEALT)
    later = found.where(F.col("kind") == _KINDS.index(_LATER)).unionAll(strings)
    return _grouped(later, _span_lists(length), _LISTS)


def numbered(rows: DataFrame) -> DataFrame:
    """(key, id, version, text) of (key, id, text): a row without an id gets one below all others, the texts of an id are numbered.

    Only ids are looked at, unless some are null or occur more than once.
    """
    known, alone = rows.where("id is not null"), rows.where("id is null")
    several = known.groupBy("id").agg(F.count("*").alias("many")).where("many > 1").select("id")
    if several.isEmpty():
        known = known.withColumn("version", F.lit(0).cast("long"))
    else:
        told = known.withColumn("told", F.xxhash64("text"))
        texts = told.join(several, "id", "left_semi").select("id", "told").distinct()
        version = F.row_number().over(Window.partitionBy("id").orderBy("told")).cast("long") - 1
        texts = session.cut(texts.withColumn("version", version).where("version > 0"))
        known = told.join(F.broadcast(texts) if texts.count() <= SMALL else texts, ["id", "told"], "left")
        known = known.withColumn("version", F.coalesce("version", F.lit(0).cast("long")))
    if not alone.isEmpty():
        low = F.lit(-(1 << 63))
        alone = written(alone.withColumn("id", low + F.monotonically_increasing_id()), "unnamed")
        bounds = alone.agg(F.max("id")).first()[0], known.agg(F.min("id")).first()[0]
        if bounds[1] is not None and bounds[1] <= bounds[0]:  # ids as low as that are numbered anew, in order
            places = session.cut(scan.numbered(known.select("id").distinct(), ["id"], "n"))
            known = known.join(places, "id").withColumn("id", F.col("n").cast("long"))
        known = known.select("key", "id", "version", "text").unionAll(alone.select("key", "id", F.lit(0).cast("long"), "text"))
    return known.select("key", "id", "version", "text")


def without_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, trigger: int = TRIGGER, hot: int = HOT, digest: bool = False) -> DataFrame:
    """Per row: ``key``, kept (the bytes that are left), n_bytes, n_removed, n_spans; with ``digest`` kept_sha256 in place of kept.

    A null text is empty. Rows without an id are documents of their own and come before all others. Rows of one id are versions of one document: a string of one
    repeats a string of another that starts earlier, and at equal starts all but one repeat it; equal rows are one
    version. Each row gives a row. Other columns are not looked at.
    """
    if not 0 < length - trigger < 127:
        raise ValueError("strings are longer than triggers by 1 to 126 bytes")
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(key).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    spans = written(repeated_spans(rows.select("id", "version", "text").where(F.octet_length("text") >= length), length, trigger, hot), "spans")
    session.release(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")

    def told(keys: pa.Array, texts: pa.Array, lists: list[bytes | None]) -> pa.RecordBatch:
        sizes, removed, runs, kept = [], [], [], []
        for text, found in zip(texts, lists, strict=True):
            raw, at, left = text.as_py().encode(), 0, []
            cuts = np.frombuffer(found or b"", np.int64).reshape(-1, 2).tolist()
            for low, high in cuts:
                left.append(raw[at:low])
                at = high
            left = b"".join([*left, raw[at:]])
            sizes.append(len(raw))
            removed.append(len(raw) - len(left))
            runs.append(len(cuts))
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        columns = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
        return pa.RecordBatch.from_arrays([keys, *columns, pa.array(kept, pa.string() if digest else pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high in pieces(single(batch.column(1))):
            yield told(single(batch.column(0))[low:high], batch.column(1)[low:high], [None] * (high - low))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high in pieces(single(batch.column(1))):
            yield told(single(batch.column(0))[low:high], batch.column(1)[low:high], batch.column(2)[low:high].to_pylist())

    touched = holders(spans)
    joined = with_lists(holding(rows, touched), spans, "left")
    return map_batches(holding(rows, touched, wanted=False).select("key", "text"), whole, out).unionAll(map_batches(joined.select("key", "text", "head"), cut, out))
