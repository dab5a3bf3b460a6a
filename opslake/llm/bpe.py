"""Byte-level BPE: overlapping chunks of a text are pre-tokenised in parallel and stitched where they agree.

A long text is cut into chunks that overlap their neighbours. Each chunk is pre-tokenised by itself, though it may
start amid a pre-token. The pattern reads from left to right and does not look back: from a position where the
readings of a chunk and of the next one both begin a pre-token, they agree for good. The first such position in the
overlap is the seam. A text of which an overlap has no seam (a run of letters or blanks longer than it) is read as
one. Pre-tokens near a seam are encoded one by one, the piece between them as it stands, and the ids of all pieces
between seams are concatenated. The pattern does look ahead: the piece between is encoded with what follows it in its
chunk, whose ids are then taken off. Ids decode to raw bytes, which are concatenated as they are.

Texts of up to one chunk are encoded where they are. Of longer texts each chunk is a row of its own, dealt over all
tasks; pieces then meet by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.common import map_batches, single

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 10
_MADE: dict[str, Encoder] = {}


class Encoder:
    """Ranks in the base64 form of tiktoken files, and the pattern that splits text before the merges."""

    def __init__(self, ranks: bytes, pattern: str):
        read = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(a): int(b) for a, b in read}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = [str(i) for i in range(max(table.values()) + 1)]

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Encoder:
        """One for each worker process."""
        key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
        if key not in _MADE:
            _MADE[key] = cls(ranks, pattern)
        return _MADE[key]

    def encode(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.core.decode_bytes(ids)

    def spelled(self, ids: list[int]) -> str:
        return " ".join([self.decimal[i] for i in ids])


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, characters) of each chunk with its overlap; every character is in a chunk."""
    for at in range(0, max(len(text) - overlap, 1), size):
        yield at, text[at : at + size + overlap]


def read_chunk(encoder: Encoder, start: int, part: str, last: bool, size: int = CHUNK, overlap: int = OVERLAP) -> dict:
    """Pre-tokenise and encode a chunk: pre-tokens with their starts in its first and last overlap, and the ids between.

    What follows a chunk could change its last pre-token and where that begins, so unless the chunk ends the text, the
    last pre-token is left to the next chunk.
    """
    begins = [m.start() for m in encoder.pattern.finditer(part)]
    ends = [*begins[1:], len(part)]
    left = begins[-1:] if not last else []
    if not last:
        begins, ends = begins[:-1], ends[:-1]
    head = [(a, b) for a, b in zip(begins, ends, strict=True) if a < overlap] if start else []
    tail = [(a, b) for a, b in zip(begins, ends, strict=True) if a >= size] if not last else []
    low = head[-1][1] if head else 0
    high = tail[0][0] if tail else (ends[-1] if ends else 0)
    coded = lambda found: [(start + a, encoder.encode(part[a:b])) for a, b in found]
    after = coded(tail)
    # the middle is encoded with what follows it, since the pattern looks ahead; the ids of what follows are taken off
    ids = encoder.encode(part[low:]) if low < high else []
    beyond = sum(len(got) for _, got in after) + sum(len(encoder.encode(part[a:])) for a in left)
    return {"start": start, "head": coded(head), "ids": ids[: len(ids) - beyond] if ids else ids, "tail": after}


def stitch(read: list[dict]) -> list[int] | None:
    """The ids of a text from its chunks in order, or none if an overlap has no seam."""
    ids: list[int] = []
    seam = 0
    for here, after in zip(read, [*read[1:], None], strict=True):
        for at, got in here["head"]:
            if at >= seam:
                ids += got
        ids += here["ids"]
        if after is not None:
            theirs = {at for at, _ in after["head"]}
            seam = next((at for at, _ in here["tail"] if at in theirs), None)
            if seam is None:
                return None
            for at, got in here["tail"]:
                if at < seam:
                    ids += got
    return ids


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", size: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """Per document row: ``key``, ids, decoded (the bytes that the ids stand for).

    With ``digest``: ``key``, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256, so that ids
    stay in the task that makes them. A null text is empty and has no ids. Rows may repeat and ids be null; each row
    gives a row. Other columns are not looked at.
    """
    if not 0 < overlap < size:
        raise ValueError("the overlap is shorter than a chunk")
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")
    given = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def batch_of(encoder: Encoder, keys: pa.Array, coded: list[list[int]]) -> pa.RecordBatch:
        raw = [encoder.decode(ids) for ids in coded]
        if digest:
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [pa.array([len(i) for i in coded], pa.int64()), pa.array([sha(encoder.spelled(i).encode()) for i in coded]), pa.array([sha(r) for r in raw])]
            return pa.RecordBatch.from_arrays([keys, *columns], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([keys, pa.array(coded, pa.list_(pa.int32())), pa.array(raw, pa.binary())], names=[key, "ids", "decoded"])

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, keys, texts = Encoder.of(*given.value), single(batch.column(0)), batch.column(1)
        step = 500
        for at in range(0, len(keys), step):
            yield batch_of(encoder, keys[at : at + step], [encoder.encode(t.as_py()) for t in texts[at : at + step]])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, text in zip(batch.column(0), batch.column(1), strict=True):
            found = list(chunks(text.as_py(), size, overlap))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(row, len(found)), pa.array([a for a, _ in found], pa.int64()), pa.array([len(found)] * len(found), pa.int64()), pa.array([p for _, p in found])],
                names=["row", "start", "chunks", "part"],
            )

    pair = pa.list_(pa.struct([("at", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(*given.value)
        for at in range(batch.num_rows):
            row, start, many, part = (batch.column(i)[at].as_py() for i in range(4))
            got = read_chunk(encoder, start, part, start == (many - 1) * size, size, overlap)
            tuples = lambda x: [{"at": a, "ids": i} for a, i in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[at : at + 1], pa.array([start]), pa.array([part]), pa.array([tuples(got["head"])], pair), pa.array([got["ids"]], pa.list_(pa.int32())), pa.array([tuples(got["tail"])], pair)],
                names=["row", "start", "part", "head", "ids", "tail"],
            )

    def join(group: pa.Table) -> pa.Table:
        encoder, found = Encoder.of(*given.value), sorted(group.drop_columns(["row"]).to_pylist(), key=lambda x: x["start"])
        for x in found:
            x["head"], x["tail"] = ([(p["at"], p["ids"]) for p in x[n]] for n in ("head", "tail"))
        ids = stitch(found)
        if ids is None:
            ids = encoder.encode("".join(x["part"][:size] for x in found[:-1]) + found[-1]["part"])
        keys = group.column("row").combine_chunks().field("key")[:1]
        return pa.Table.from_batches([batch_of(encoder, keys, [ids])])

    long = F.length("text") > size + overlap
    short = map_batches(rows.where(~long), whole, out)
    numbered = rows.where(long).select(F.struct("key", F.monotonically_increasing_id().alias("n")).alias("row"), "text")
    row = f"row struct<key:{kind},n:bigint>"
    parts = map_batches(numbered, cut, f"{row}, start long, chunks long, part string").repartition(F.xxhash64("row.n", "start"))
    near = "array<struct<at:bigint,ids:array<int>>>"
    coded = map_batches(parts, read, f"{row}, start long, part string, head {near}, ids array<int>, tail {near}")
    return short.unionAll(coded.groupBy("row").applyInArrow(join, out))


def decode(coded: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row: ``key`` and text, of ids made by ``encode``. Bytes that aren't UTF-8 become replacement characters; null ids give null."""
    given = coded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(*given.value)
        texts = [None if ids is None else encoder.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([single(batch.column(0)), pa.array(texts, pa.string())], names=[key, "text"])

    return map_batches(coded.select(key, "ids"), run, f"{key} {coded.schema[key].dataType.simpleString()}, text string")
