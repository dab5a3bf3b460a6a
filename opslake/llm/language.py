"""Language identification by string kernels.

Two texts are as near as the blended spectrum of n-grams that both show: with G(x) the set of byte n-grams of one to
three bytes of the lower-cased text x, counted by presence, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). Landmark
texts span a Nyström approximation of that kernel; kernel ridge regression learns one output for each language against
the rest. Scoring a batch is a product of its presence matrix with the landmarks' and one with the weights.

The model is fitted on a bounded sample of labelled texts of every language (``PER_LANGUAGE`` of each, fewer if there
are more than ``TEXTS`` of all), and scores whole texts. Of texts above ``SAMPLE_BYTES`` the beginning is learnt from, if
a language has fewer than ``FEW`` others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm.common import map_batches, pieces, single, text_bytes

#: The labelled sample: texts of a language, texts of all languages together, bytes of a text in it, and how many of a
#: language longer texts may fill up to.
PER_LANGUAGE, TEXTS, SAMPLE_BYTES, FEW = 384, 64 * 384, 16 << 10, 32
#: Landmarks, n-grams that tell texts apart, weight of the ridge, and how sharply scores become shares.
LANDMARKS, GRAMS, RIDGE, SHARPNESS = 96, 6000, 1e-3, 6.0
UNKNOWN = "und"
#: Of the way from equal shares to 1, how far a text's score has to be for the pipeline to know its language.
MARGIN = 0.1
_TABLES: dict[int, list[np.ndarray]] = {}


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of bytes as numbers, by their first byte."""
    count = max(0, len(data) - n + 1)
    out = np.zeros(count, np.int32)
    for k in range(n):
        out = (out << 8) | data[k : k + count]
    return out


def presence(texts: pa.Array, tables: list[np.ndarray], grams: int) -> np.ndarray:
    """Which n-grams each of the lower-cased texts shows, as a matrix of booleans."""
    data, offsets = text_bytes(texts)
    shown = np.zeros((len(texts), grams), bool)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    for n, table in enumerate(tables, 1):
        gram = table[codes(data, n)]
        of = row[: len(gram)]
        at = (gram >= 0) & (of == row[n - 1 :])
        shown[of[at], gram[at]] = True
    return shown


def normalised(shown: np.ndarray) -> np.ndarray:
    """Rows of length 1, or of zeros."""
    size = np.sqrt(shown.sum(axis=1, dtype=np.float32))
    return shown.astype(np.float32) / np.maximum(size, 1)[:, None]


@dataclass
class Model:
    """``grams``: code and length of each n-gram; ``landmarks``: n-grams by landmark; ``weights``: landmarks by language."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def tables(self) -> list[np.ndarray]:
        key = hash(self.grams.tobytes())
        if key not in _TABLES:
            tables = [np.full(256**n, -1, np.int16) for n in (1, 2, 3)]
            for n, table in enumerate(tables, 1):
                at = np.flatnonzero(self.grams[:, 1] == n)
                table[self.grams[at, 0]] = at
            _TABLES.clear()
            _TABLES[key] = tables
        return _TABLES[key]

    def kernel(self, texts: pa.Array) -> np.ndarray:
        return normalised(presence(texts, self.tables(), len(self.grams))) @ self.landmarks

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Shares of each language, by text."""
        raw = SHARPNESS * (self.kernel(texts).astype(np.float64) @ self.weights)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """A model of labelled texts, in their order; none if there are no texts. Fragments of the texts are learnt from as well."""
    if not texts:
        return None
    languages = sorted(set(labels))
    pieces_of, of = [], []
    for text, label in zip(texts, labels, strict=True):
        middle = len(text) // 2
        for part in (text, text[:300], text[middle : middle + 80]):
            pieces_of.append(part)
            of.append(languages.index(label))
    rows = lowered(pa.array(pieces_of, pa.string()))
    # the n-grams: those that most of the whole texts' languages differ in how often they show
    base = [0, 256, 256 + 256**2]
    seen: list[list[np.ndarray]] = [[] for _ in languages]
    for text, label in zip(rows[::3], labels, strict=True):
        data = np.frombuffer(text.as_py().encode(), np.uint8)
        seen[languages.index(label)] += [np.unique(codes(data, n)) + base[n - 1] for n in (1, 2, 3)]
    counted = [np.unique(np.concatenate(x), return_counts=True) for x in seen]
    grams = np.unique(np.concatenate([g for g, _ in counted]))
    high, low = np.zeros(len(grams), np.float32), np.full(len(grams), np.inf, np.float32)
    for language, (gram, count) in zip(languages, counted, strict=True):
        share = np.zeros(len(grams), np.float32)
        share[np.searchsorted(grams, gram)] = count / labels.count(language)
        high, low = np.maximum(high, share), np.minimum(low, share)
    spread = high - low if len(languages) > 1 else high
    at = np.sort(np.argsort(-spread, kind="stable")[:GRAMS])
    at = grams[at[spread[at] > 0]] if (spread > 0).any() else grams[:1]
    n = np.searchsorted(base, at, "right")
    model = Model(languages, np.stack([at - np.array(base)[n - 1], n], axis=1), np.zeros((len(at), 0), np.float32), np.zeros((0, 0)))
    shown = np.concatenate([presence(rows[i : i + 512], model.tables(), len(at)) for i in range(0, len(rows), 512)])
    chosen = np.linspace(0, len(rows) // 3 - 1, min(max(LANDMARKS, len(languages)), len(rows) // 3)).astype(int) * 3
    model.landmarks = np.ascontiguousarray(normalised(shown[chosen]).T)
    kernel = np.concatenate([normalised(shown[i : i + 512]) @ model.landmarks for i in range(0, len(shown), 512)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[chosen])
    kept = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, kept] / np.sqrt(value[kept])
    features = kernel @ root
    target = np.where(np.array(of)[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = features.T @ features + RIDGE * len(features) * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(gram, features.T @ target)
    return model


def sample(docs: DataFrame, learn: Column, key: str = "doc_id", label: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and labels of the bounded sample, in a fixed order. ``learn`` says which rows may be learnt from."""
    labelled = docs.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull() & (F.octet_length("text") > 0))
    labelled = labelled.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"), (F.octet_length("text") > SAMPLE_BYTES).alias("long"), "text")
    many = docs.where(learn & F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().count()
    most = max(1, min(PER_LANGUAGE, TEXTS // max(many, 1)))
    place = F.row_number().over(Window.partitionBy("l").orderBy("long", F.xxhash64("k"), "k"))
    ids = labelled.groupBy("k", "l").agg(F.min("long").alias("long")).withColumn("place", place).where(F.col("place") <= most).where(~F.col("long") | (F.col("place") <= FEW))
    part = F.when(F.col("long"), F.substring("text", 1, SAMPLE_BYTES // 4)).otherwise(F.col("text"))  # a character has at most 4 bytes
    found = labelled.withColumn("text", part).join(F.broadcast(ids), ["k", "l", "long"]).toPandas().sort_values(["place", "l", "k", "text"])
    found = found[found.groupby("l").cumcount() < most]
    return found["text"].tolist(), found["l"].tolist()


def decided(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; null texts, and all texts if there is no model, are ``und`` with score 0."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    shares = model.scores(lowered(texts))
    valid = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    names = [model.languages[i] if v else UNKNOWN for i, v in zip(shares.argmax(axis=1), valid, strict=True)]
    return names, np.where(valid, shares.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, lang_pred, score (that language's share). Null texts and texts without letters, and all texts if there is no model, are ``und`` with score 0."""
    kind = docs.schema[key].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.when(lettered, F.col("text")).alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, texts = single(batch.column(0)), single(batch.column(1))
        for low, high in pieces(texts, rows=512):
            names, best = decided(given.value, texts[low:high])
            yield pa.RecordBatch.from_arrays([keys[low:high], pa.array(names), pa.array(best)], names=[key, "lang_pred", "score"])

    return map_batches(rows, run, f"{key} {kind}, lang_pred string, score double")


def least_score(model: Model | None) -> float:
    """The score that a text of one of the model's languages has at least: ``MARGIN`` of the way from equal shares to 1."""
    equal = 1 / len(model.languages) if model else 1.0
    return equal + MARGIN * (1 - equal)


def keep(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text ``predict`` gives a language, by at least ``least`` of the score, as they are."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = single(batch.column("text"))
        for low, high in pieces(texts, rows=512):
            names, best = decided(given.value, texts[low:high])
            yield batch.slice(low, high - low).filter(pa.array((np.array(names) != UNKNOWN) & (best >= least)))

    lettered = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return map_batches(lettered, run, docs.schema)
