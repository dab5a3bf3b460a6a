"""Words of many texts at once, as hashes and byte ranges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from opslake.llm.common import PIECE_BYTES, mix, text_bytes

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

#: Bytes of a word, by what they are read as: a-z, A-Z as a-z, digits, and all bytes beyond ASCII; 0 ends a word.
WORD = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        WORD[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        WORD[_b] = _b + 32


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
        if size > 4 * PIECE_BYTES:
            return made
        _POWERS[:] = made
    return _POWERS


@dataclass
class Words:
    """``hash``, ``start`` and ``end`` by word; ``first``: by text, where its words begin (one more than texts)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def spelled(self, i: int) -> bytes:
        return WORD[self.data[self.start[i] : self.end[i]]].tobytes()

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def read(column: pa.Array, classes: np.ndarray = WORD) -> Words:
    """The words of each text. Null and empty texts have none; no word reaches over two texts."""
    data, offsets = text_bytes(column)
    inside = classes[data] != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # so many words at once as lie within a piece; a longer word makes a piece of its own
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, at + PIECE_BYTES, side="right")))
        stop = int(end[j - 1])
        up, down = _powers(stop - at)
        with np.errstate(over="ignore"):
            total = np.zeros(stop - at + 1, np.uint64)
            np.cumsum((classes[data[at:stop]].astype(np.uint64) + np.uint64(1)) * up[: stop - at], out=total[1:])
            a, b = start[i:j] - at, end[i:j] - at
            hashes[i:j] = mix((total[b] - total[a]) * down[a] ^ (b - a).astype(np.uint64))
        i = j
    return Words(hashes, start, end, np.searchsorted(start, offsets), data)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of ``n`` words in a row, by the first of them; shorter by n-1."""
    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = mix(total * np.uint64(_BASE) + hashes[k : k + count])
    return total
