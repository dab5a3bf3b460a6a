"""Periodic runs of words, by suffix trees.

A run is a stretch of words with a smallest period q that is at least ``least`` words and two periods long and can't be
extended. Every run holds, from one of its first q words on, a Lyndon word of q words in the order of the words or in
the opposite order, and it is the longest Lyndon word that starts there. So for each position and both orders the
longest Lyndon word gives one candidate period; longest common extensions to the right and to the left say how far it
reaches. Both are answered in constant time: Ukkonen trees of the words and of their reversal, an Euler tour of each,
and the least depth between two leaves on the tour, which is the depth of their lowest common ancestor. The order of
the leaves ranks the suffixes, from which the longest Lyndon words follow.

Trees are grown only over stretches of a text that can hold a run: of a run of L >= 2q words every gram of ``least``/2
words occurs again q words further, within the run. A stretch covered by grams that occur again not further than half
the stretch away holds all its runs entirely, and no run of a stretch goes beyond it. Grams are compared by hashes,
which can only add stretches; the trees compare words.

A text's words are handled in one task, one piece of texts after the other; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm import words
from opslake.llm.common import map_batches, mix, pieces, single

#: Words of the shortest run.
LEAST = 12
#: The end of a sequence, smaller than all its symbols.
_END = -1
#: Bytes as they are compared; those of white space end a word.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[0] = 0x20
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


class Tree:
    """Ukkonen's suffix tree of a list of whole numbers from 0, with an end mark that makes every suffix a leaf."""

    def __init__(self, sequence: list[int]):
        self.text = text = [*sequence, _END]
        n = len(text)
        # Of each node: the edge that leads to it (a slice of the text), its suffix link, its children (None: a leaf).
        self.first, self.stop, self.children = first, stop, children = [0], [0], [{}]
        link = [0]
        node = length = waiting = 0
        edge = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                child = children[node].get(text[edge])
                if child is None:
                    children[node][symbol] = len(first)
                    first.append(i), stop.append(n), link.append(0), children.append(None)
                    link[unlinked] = node if unlinked else 0
                    unlinked = 0
                else:
                    span = stop[child] - first[child]
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    at = first[child] + length
                    if text[at] == symbol:
                        link[unlinked] = node if unlinked else 0
                        length += 1
                        break
                    split, leaf = len(first), len(first) + 1
                    first += [first[child], i]
                    stop += [at, n]
                    link += [0, 0]
                    children += [{text[at]: child, symbol: leaf}, None]
                    children[node][text[edge]] = split
                    first[child] = at
                    link[unlinked] = split if unlinked else 0
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - waiting + 1

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The Euler tour with children in order: depths by step, suffixes by leaf, and each leaf's step."""
        n, children, first, stop = len(self.text), self.children, self.first, self.stop
        steps, suffixes, leaves, todo = [], [], [], [0, 0]
        step, push, pop = steps.append, todo.append, todo.pop
        while todo:
            below, node = pop(), pop()
            step(below)
            if node < 0:  # back from a child
                continue
            kids = children[node]
            if kids is None:
                leaves.append(len(steps) - 1)
                suffixes.append(n - below)
                continue
            for symbol in sorted(kids, reverse=True):
                child = kids[symbol]
                push(-1), push(below)
                push(child), push(below + stop[child] - first[child])
        return np.array(steps, np.int64), np.array(suffixes, np.int64), np.array(leaves, np.int64)

    def opposite(self) -> np.ndarray:
        """Suffixes in the opposite order of symbols; the end stays the smallest."""
        n, children, first, stop = len(self.text), self.children, self.first, self.stop
        suffixes, todo = [], [0, 0]
        push, pop = todo.append, todo.pop
        while todo:
            below, node = pop(), pop()
            kids = children[node]
            if kids is None:
                suffixes.append(n - below)
                continue
            last = kids.get(_END)
            for symbol in sorted(kids):  # the last to go in comes out first
                child = kids[symbol]
                if child != last:
                    push(child), push(below + stop[child] - first[child])
            if last is not None:
                push(last), push(below + stop[last] - first[last])
        return np.array(suffixes, np.int64)


class Extensions:
    """Longest common extensions to the right: the depth of the lowest common ancestor of two leaves."""

    def __init__(self, tree: Tree):
        steps, suffixes, leaves = tree.tour()
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        # Of the tour only the least depth between leaves that follow one another is looked at.
        least = np.minimum.reduceat(steps[: leaves[-1]], leaves[:-1]) if len(leaves) > 1 else np.zeros(0, np.int64)
        self.levels = [least]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different positions, how many symbols agree from there on."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each position ends: at the next smaller suffix. The last suffix is the end mark."""
    rank = rank.tolist()
    ends = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j = i + 1
        while rank[j] > rank[i]:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:-1], np.int64)


def runs(sequence: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    n = len(sequence)
    if n < least:
        return np.zeros((0, 3), np.int64)
    tree = Tree(sequence)
    right, left = Extensions(tree), Extensions(Tree(sequence[::-1]))
    other = np.empty(n + 1, np.int64)
    other[tree.opposite()] = np.arange(n + 1)
    at = np.arange(n)
    i = np.concatenate([at, at])
    j = np.concatenate([lyndon_ends(right.rank), lyndon_ends(other)])
    end = j + right(i, j)
    start = i.copy()
    inner = np.flatnonzero(i > 0)  # in the reversal, the word before position x is at n - x
    start[inner] -= left(n - i[inner], n - j[inner])
    period = j - i
    fine = end - start >= np.maximum(least, 2 * period)
    return np.unique(np.stack([start, end - start, period], 1)[fine], axis=0)[:, [0, 1, 2]]


def stretches(hashes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (word numbers of the piece) of the stretches that may hold runs; none reaches over two texts."""
    none = np.zeros(0, np.int64)
    gram = (least + 1) // 2
    count = len(hashes) - gram + 1
    if count < 2:
        return none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:count] == text[gram - 1 :]
    at = np.flatnonzero(inside)
    key = mix(words.runs(hashes, gram)[at] ^ mix(text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    here, there = at[order[:-1][again]], at[order[1:][again]]  # a gram and where it occurs next
    while len(here):
        cover = np.zeros(len(hashes) + 1, np.int64)
        for p in (here, there):
            np.add.at(cover, p, 1)
            np.add.at(cover, p + gram, -1)
        covered = np.cumsum(cover[:-1]) > 0
        opens = covered.copy()
        opens[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
        number = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)
        size = np.bincount(number[covered], minlength=len(begin))
        fits = size[number[here]]
        keep = (number[here] == number[there]) & (fits >= least) & ((there - here) * 2 <= fits)
        if keep.all():
            return begin, begin + size
        here, there = here[keep], there[keep]
    return none, none


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The key, n_words, runs (array of start, length, period by start, then period) and collapsed, by row of ``docs``.

    Words are what stands between white space (space and U+0009 to U+000D), compared byte by byte and numbered from 0.
    ``collapsed`` has the words joined by one space, without those that a run holds after its first period. Null and
    empty texts have no words. Every row is handled by itself: repeated rows and null keys give a row each; other
    columns are not looked at.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = single(batch.column(1))
        for low, high in pieces(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *_piece(texts.slice(low, high - low), least)], names=["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    found = map_batches(docs.select(key, text), rows, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.select(F.col("key").alias(key), "n_words", "runs", "collapsed")


def _piece(texts: pa.Array, least: int) -> list[pa.Array]:
    got = words.read(texts, SPACED)
    owner = np.zeros(0, np.int64)
    found = np.zeros((0, 3), np.int64)
    kept = np.ones(len(got.hash), bool)
    parts = []
    for begin, end in zip(*stretches(got.hash, got.first, least), strict=True):
        symbols: dict[bytes, int] = {}
        spelled = [got.data[a:b].tobytes() for a, b in zip(got.start[begin:end], got.end[begin:end], strict=True)]
        some = runs([symbols.setdefault(w, len(symbols)) for w in spelled], least)
        if len(some):
            number = int(np.searchsorted(got.first, begin, side="right")) - 1
            for start, length, period in (some + [begin, 0, 0]).tolist():
                kept[start + period : start + length] = False
            parts.append((np.full(len(some), number), some + [begin - got.first[number], 0, 0]))
    if parts:  # stretches come in order, and so do the runs of each
        owner, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in range(3)], names=["start", "length", "period"])
    return [pa.array(np.diff(got.first)), pa.ListArray.from_arrays(offsets, spans), _joined(got, kept, texts)]


def _joined(got: words.Words, kept: np.ndarray, texts: pa.Array) -> pa.Array:
    """The words kept of each text, joined by one space."""
    sizes = np.zeros(len(texts) + 1, np.int64)
    step = np.zeros(len(got.data) + 1, np.int8)
    step[got.start[kept]] = 1
    step[got.end[kept]] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8) > 0
    at = np.flatnonzero(kept)
    if len(at) > 1:  # the white space after a word that has another one after it in its text
        follows = got.text[at[1:]] == got.text[at[:-1]]
        take[got.end[at[:-1][follows]]] = True
    data = got.data[take]
    data[SPACED[data] == 0] = 0x20
    total = np.concatenate([[0], np.cumsum(take)])
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    sizes[1:] = np.cumsum(lengths)
    ends = total[sizes].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
