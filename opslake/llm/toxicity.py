"""Toxicity: a Levenshtein automaton of a lexicon's trie, read over all words, and scores of the context of hits.

The lexicon is learnt from labelled texts: words, and stems of words, that toxic texts show much more often than
others, after ever other words (else they come of copies of one text). A term is the stronger, the fewer clean texts
show it. The strongest words also match words a few edits away, more for longer ones; a near word that clean labelled
texts show is an ordinary word and never matches. The automaton is one table of states and symbols, so all words of a batch
step through it at once, and most leave it after two or three characters.

A hit counts less if it is misspelled, and nothing where its context window quotes it: between quotation marks,
with a word of reporting near. What the hits of a text sum up to, and how dense they are, go into a logistic score.

Labels are learnt from a bounded sample of ``SAMPLE`` texts of each label; whole texts are scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake import session
from opslake.llm.common import map_batches, pieces, single

#: Texts of each label that are learnt from; terms; share of toxic texts that show a term at least.
SAMPLE, TERMS, SUPPORT = 4096, 128, 0.02
#: How many times more often toxic texts show a term than clean ones: at least, and for full strength.
CONTRAST, STRONG = 8.0, 100.0
#: Other words that a term stands after, for each toxic text that shows it; so many in all are enough.
VARIED, VARIED_ENOUGH = 0.5, 20
#: Terms whose contexts are looked at.
CANDIDATES = 20_000
#: Characters that a stem has at least and at most.
STEM = (4, 8)
#: What a hit counts for: misspelled, quoted and reported, only between quotation marks.
MISSPELLED, QUOTED, MARKED = 0.75, 0.0, 0.7
#: Characters of context on either side of a hit.
CONTEXT = 120
_DEAD, _START = 0, 1
_NONE, _OTHER = 0, 1

# Words that report what somebody else has said.
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quotes word words term slur reported claimed sagte schrieb nannte zitat wort dit disait écrit appelé mot dijo escribió llamó cita palabra".split())
#: Pairs of quotation marks.
MARKS = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"), ("‹", "›"), ("‘", "’"))
#: Signs that stand for letters in words written so as not to be found.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _folded(c: str) -> str:
    """The plain lower-case letter of a character; empty if it ends a word."""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if not c.isalnum():
        return ""
    return (unicodedata.normalize("NFD", c)[0].lower() or c)[0]


#: Code points of the basic plane as folded code points; 0 ends a word, as do all code points beyond.
_FOLD = np.zeros(65536, np.uint16)
for _i in range(65536):
    if not 0xD800 <= _i < 0xE000 and (_f := _folded(chr(_i))):
        _FOLD[_i] = ord(_f) if ord(_f) < 65536 else 1


def fold(text: str) -> str:
    return "".join(_folded(c) or " " for c in text)


def edits_for(term: str) -> int:
    """How many edits away a word may be."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """``step``: next state by state and symbol; ``term`` and ``edits`` by state, -1 where nothing is accepted; ``whole``: states that accept whatever follows."""

    terms: list[str]
    strength: np.ndarray
    symbols: dict[int, int]
    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    whole: np.ndarray

    @classmethod
    def of(cls, terms: list[str], strength: list[float] | None = None) -> Automaton:
        """Of folded terms; those that end in ``*`` are stems, which match exactly, with whatever follows. So do weak terms."""
        strength = np.array(strength if strength is not None else np.ones(len(terms)))
        allowed_of = [0 if t.endswith("*") or w < 1 else edits_for(t) for t, w in zip(terms, strength, strict=True)]
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        budget = [0]
        for i, t in enumerate(terms):
            stem, node, allowed = t.endswith("*"), 0, allowed_of[i]
            budget[0] = max(budget[0], allowed)
            for c in t.rstrip("*") + ("*" if stem else ""):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    budget.append(0)
                node = children[node][c]
                budget[node] = max(budget[node], allowed)
            ends[node] = i

        def closed(found: dict[int, int]) -> frozenset:
            queue = list(found)
            while queue:
                node = queue.pop()
                for c, child in children[node].items():
                    e = found[node] + 1
                    if c != "*" and e <= budget[child] and e < found.get(child, 99):
                        found[child] = e
                        queue.append(child)
            return frozenset(found.items())

        letters = sorted({c for t in terms for c in t if c != "*"})
        index = {_DEAD: frozenset(), _START: closed({0: 0})}
        number = {v: k for k, v in index.items()}
        rows, term, edits, whole = [np.zeros(len(letters) + 2, np.int32)], [-1], [0], [False]
        at = _START
        while at in index:
            state = index[at]
            best = min(((e, ends[n], False) for n, e in state if n in ends and not terms[ends[n]].endswith("*") and e <= allowed_of[ends[n]]), default=None)
            stems = [ends[children[n]["*"]] for n, e in state if e == 0 and "*" in children[n]]
            if stems:
                best = (0, min(stems), True)
            term.append(best[1] if best else -1)
            edits.append(best[0] if best else 0)
            whole.append(bool(best and best[2]))
            row = np.zeros(len(letters) + 2, np.int32)
            if not whole[-1]:
                for s, c in enumerate(["", *letters], _OTHER):
                    after: dict[int, int] = {}
                    for n, e in state:
                        for d, child in children[n].items():
                            if d != "*" and e + (d != c) <= budget[child]:
                                after[child] = min(after.get(child, 99), e + (d != c))
                        if e + 1 <= budget[n]:
                            after[n] = min(after.get(n, 99), e + 1)
                    key = closed(after)
                    if key not in number:
                        number[key] = len(index)
                        index[len(index)] = key
                    row[s] = number[key]
            rows.append(row)
            at += 1
        return cls(terms, strength, {ord(c): s for s, c in enumerate(letters, _OTHER + 1)}, np.stack(rows), np.array(term), np.array(edits), np.array(whole))

    def _symbols(self) -> np.ndarray:
        of = np.full(65536, _OTHER, np.uint8)
        of[0] = _NONE
        for code, s in self.symbols.items():
            of[code] = s
        return of[_FOLD]

    def hits(self, codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and end position, term and edits of each matching word among code points; no word reaches over ``edges``. Last: words before each edge."""
        if not hasattr(self, "_table"):
            self._table = self._symbols()
        symbols = self._table[np.minimum(codes, 65535)]
        inside = symbols != _NONE
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        inner = edges[(edges > 0) & (edges < len(codes))]
        opens[inner] = inside[inner]
        closes[inner - 1] = inside[inner - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        word, state = np.arange(len(start)), np.full(len(start), _START, np.int32)
        found = []
        at = start.copy()
        while len(word):
            state = self.step[state, symbols[at]]
            at = at + 1
            over = (at >= end[word]) | self.whole[state]
            done = over & (self.term[state] >= 0)
            found.append((word[done], self.term[state[done]], self.edits[state[done]]))
            going = ~over & (state != _DEAD)
            word, state, at = word[going], state[going], at[going]
        word, term, edits = (np.concatenate(x) if found else np.zeros(0, int) for x in zip(*found or [((), (), ())], strict=True))
        order = np.argsort(word, kind="stable")
        word = word[order].astype(int)
        return start[word], end[word], term[order].astype(int), edits[order].astype(int), np.searchsorted(start, edges)


def _codes(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), np.cumsum([0] + [len(t) for t in texts])


def context_weight(text: str, first: int, end: int) -> float:
    """What a hit counts for by the window around it."""
    before, after = text[max(0, first - CONTEXT) : first], text[end : end + CONTEXT]
    for opening, closing in MARKS:
        at = before.rfind(opening)
        if at < 0 or closing not in after or (opening == closing and before.count(opening) % 2 == 0):
            continue
        if opening != closing and before.rfind(closing) > at:
            continue
        near = re.findall(r"[^\W\d_]+", before[:at].lower())[-8:] + re.findall(r"[^\W\d_]+", after[after.index(closing) :].lower())[:8]
        return QUOTED if REPORTING.intersection(near) else MARKED
    return 1.0


@dataclass
class Model:
    automaton: Automaton
    ordinary: frozenset
    weights: tuple[float, float, float]

    def features(self, texts: list[str]) -> np.ndarray:
        """What the hits of each text count for in sum, and in a hundred words; both damped."""
        joined, codes, edges = _codes(texts)
        first, end, term, edits, words = self.automaton.hits(codes, edges)
        total = np.zeros(len(texts))
        for a, b, e, strength in zip(first.tolist(), end.tolist(), edits.tolist(), self.automaton.strength[term].tolist(), strict=True):
            if e and fold(joined[a:b]) in self.ordinary:
                continue
            of = int(np.searchsorted(edges, a, "right")) - 1
            low = int(edges[of])
            at, high = max(low, a - CONTEXT), min(int(edges[of + 1]), b + CONTEXT)
            total[of] += strength * context_weight(joined[at:high], a - at, b - at) * (MISSPELLED if e else 1.0)
        return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(np.diff(words), 1))], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        bias, by_sum, by_density = self.weights
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(bias + by_sum * x[:, 0] + by_density * x[:, 1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float, float]:
    """Bias and two weights, which never are negative; both labels weigh the same."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    full = np.column_stack([np.ones(len(x)), x])
    w, kept = np.zeros(3), np.array([True, True, True])
    for _ in range(2):
        w[~kept] = 0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            slope = full.T @ (share * (p - y)) + ridge * w * [0, 1, 1]
            curve = (full * (share * p * (1 - p))[:, None]).T @ full + ridge * np.diag([1e-3, 1, 1])
            step = np.zeros(3)
            step[kept] = np.linalg.solve(curve[np.ix_(kept, kept)], slope[kept])
            w = w - step
            if abs(step).max() < 1e-8:
                break
        kept = np.array([True, w[1] > 0, w[2] > 0])
        if kept.all():
            break
    return tuple(float(v) for v in w)


def contrast(toxic_with: int, clean_with: int, toxic: int, clean: int) -> float:
    """How many times more often toxic texts show a term."""
    return toxic_with / max(1, toxic) * max(1, clean) / (clean_with + 0.5)


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """The lexicon with strengths, from (word or stem with ``*``, toxic texts, clean texts that show it).

    Of a word and the stems of it, the word is a term if it is nearly all that shows the stem; else the longest stem
    that still shows nearly all of it.
    """
    good = {t: (a, contrast(a, b, toxic, clean)) for t, a, b in counts if a >= max(3, SUPPORT * toxic) and contrast(a, b, toxic, clean) >= CONTRAST}
    terms, taken = [], []
    for stem in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        if any(stem.startswith(t) for t in taken):
            continue
        taken.append(stem[:-1])
        within = [t for t in good if t.startswith(stem[:-1]) and good[t][0] >= 0.85 * good[stem][0]]
        words = [t for t in within if not t.endswith("*")]
        terms.append(max(words, key=lambda t: (good[t], t)) if words else max(within, key=lambda t: (len(t), t)))
    for word in sorted(t for t in good if not t.endswith("*")):
        if not any(word.startswith(t) for t in taken):
            terms.append(word)
    terms = sorted(terms, key=lambda t: (-good[t][0] * np.log(good[t][1]), t))[:TERMS]
    return [(t, float(min(1.0, np.log(good[t][1]) / np.log(STRONG)))) for t in sorted(terms)]


def shown_terms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to how many texts of each label show each word and stem."""
    counts: dict[tuple[str, int], int] = {}
    for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for t in {t for w in set(fold(text or "").split()) if len(w) <= 24 for t in terms_of(w)}:
            counts[t, toxic] = counts.get((t, toxic), 0) + 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"])


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(STEM[0], min(STEM[1], len(word)) + 1))]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id") -> Model | None:
    """A model of the labelled documents that ``learn``, an expression of ``key``, allows; none if a label is missing.

    Labels other than 0 and 1, null ids and null texts are not learnt from. An id with both labels is learnt twice.
    """
    spark = docs.sparkSession
    told = labels.where(learn & F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("toxic")).distinct()
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("k"), "k"))
    ids = told.withColumn("place", place).where(F.col("place") <= SAMPLE).select("k", "toxic")
    texts = docs.where("text is not null").select(F.col(key).alias("k"), "text").join(F.broadcast(ids), "k").select("toxic", "text").distinct()
    texts = session.cut(texts)
    many = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(many) < 2:
        return None
    terms = map_batches(texts, shown_terms, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    ratio = F.col("a") / many[1] * many[0] / (F.col("b") + 0.5)
    frequent = terms.where((F.col("a") >= max(3, SUPPORT * many[1])) & (ratio >= CONTRAST)).orderBy(F.desc("a"), "term").limit(CANDIDATES)
    counts = {r.term: (r.a, r.b) for r in frequent.collect()}
    candidates = spark.sparkContext.broadcast(frozenset(counts))

    def preceded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = set()
        for text in batch.column(1).to_pylist():
            words = fold(text).split()
            found.update((t, before) for before, w in zip(["", *words], words, strict=False) if len(w) <= 24 for t in terms_of(w) if t in candidates.value)
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1][:24] for r in rows], pa.string())], names=["term", "before"])

    varied = map_batches(texts.where("toxic = 1"), preceded, "term string, before string").distinct().groupBy("term").count().collect()
    lexicon = choose_terms([(r["term"], *counts[r["term"]]) for r in varied if r["count"] >= min(VARIED_ENOUGH, VARIED * counts[r["term"]][0])], many[1], many[0])
    model = Model(Automaton.of([t for t, _ in lexicon], [w for _, w in lexicon]), frozenset(), (0.0, 0.0, 0.0))
    given = spark.sparkContext.broadcast(model)

    def near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = set()
        for low, high in pieces(single(batch.column(1))):
            joined, codes, edges = _codes(batch.column(1)[low:high].to_pylist())
            first, end, _, edits, _ = given.value.automaton.hits(codes, edges)
            found.update(fold(joined[a:b]) for a, b, e in zip(first.tolist(), end.tolist(), edits.tolist(), strict=True) if e)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    # the near words of a bounded lexicon in clean texts of a bounded sample
    ordinary = map_batches(texts.where("toxic = 0"), near, "word string").distinct().collect()
    model = Model(model.automaton, frozenset(r.word for r in ordinary), model.weights)
    given = spark.sparkContext.broadcast(model)

    def measured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high in pieces(single(batch.column(1))):
            x = given.value.features(batch.column(1)[low:high].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "total", "density"])

    found = map_batches(texts, measured, "toxic int, total double, density double").toPandas()
    found = found.sort_values(list(found.columns))
    model.weights = logistic(found[["total", "density"]].to_numpy(), found["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, score, predicted. Null texts are empty; without a model every score is 0.

    Ids may be null and rows may repeat; each row gives a row. Other columns are not looked at.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, texts = single(batch.column(0)), pc.fill_null(single(batch.column(1)), "")
        for low, high in pieces(texts):
            found = np.zeros(high - low) if given.value is None else given.value.scores(texts[low:high].to_pylist())
            yield pa.RecordBatch.from_arrays([keys[low:high], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return map_batches(docs.select(key, "text"), run, f"{key} {docs.schema[key].dataType.simpleString()}, score double, predicted int")
