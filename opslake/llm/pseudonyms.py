"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Numbers that pass the checks of their kind (card and account checksums, octets, area codes), dates, mail addresses and
secrets are permuted within their format: a card number becomes another valid card number in the same grouping, a date
another date. The permutation depends on a key and on the kind, and nothing else, so equal values stay equal in every
document, and values stay apart. A pseudonym has as many bytes as what it replaces; all other bytes stay as they are.

A Feistel network over two halves permutes the numbers below a product; numbers beyond the wanted range, or that the
kind's checks refuse, are permuted again until they fit.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from opslake.llm.common import pieces, single, text_bytes

ROUNDS = 10
#: Bytes of a value that are permuted as one number; the halves of such numbers are far smaller than a round's digest.
BLOCK = 64
#: Stretches of text without white space that are looked at on either side of a digit or sign.
CONTEXT = 8
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049

_ALNUM = rb"A-Za-z0-9\x80-\xff"
#: A character beyond ASCII.
_WIDE = rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}"
_OCTET = rb"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERN = re.compile(
    rb"(?P<mail>(?:[A-Za-z0-9._%+\-]|" + _WIDE + rb"){1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![" + _ALNUM + rb"@\-]))"
    rb"|(?P<account>(?<![" + _ALNUM + rb"])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![" + _ALNUM + rb"]))"
    rb"|(?P<key>(?<![" + _ALNUM + rb"])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9\-]{20,}|AIza[A-Za-z0-9_\-]{35})(?![" + _ALNUM + rb"]))"
    rb"|(?P<secret>(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_\-]*\d)[A-Za-z0-9+/_\-]{8,})"
    rb"|(?P<address>(?<![\d.])(?:" + _OCTET + rb"\.){3}" + _OCTET + rb"(?!\d|\.\d))"
    rb"|(?P<card>(?<![\d.\-])(?:\d{13,19}|\d{4}(?P<g>[ \-])\d{4}(?P=g)\d{4}(?P=g)\d{4}|\d{4}(?P<h>[ \-])\d{6}(?P=h)\d{5})(?!\d|[.\-]\d))"
    rb"|(?P<social>(?<![\d\-])\d{3}-\d{2}-\d{4}(?!\d|-\d))"
    rb"|(?P<date>(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}(?P<s>[./\-])\d{1,2}(?P=s)\d{4})(?!\d|[.\-/]\d))"
    rb"|(?P<phone>(?<![\d+\w])(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d|-\d)|(?<![\d\w])\+[1-9]\d{0,2}(?:[ .\-]?\(?\d{2,4}\)?){2,4}(?!\d))"
)
KINDS = ("mail", "account", "key", "secret", "address", "card", "social", "date", "phone")


class Permutation:
    """Keyed permutations of the numbers below a size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mixed(self, kind: str, step: int, half: int) -> int:
        told = f"{kind}|{step}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(told, key=self.key, digest_size=64).digest(), "big")

    def once(self, value: int, size: int, kind: str) -> int:
        """Feistel rounds over two halves whose product is at least ``size``, walked until below it."""
        left_size = isqrt(max(size - 1, 0)) + 1
        right_size = -(-size // left_size)
        kind = f"{kind}|{size}"
        while True:
            left, right = divmod(value, right_size)
            for step in range(ROUNDS):
                if step % 2:
                    right = (right + self._mixed(kind, step, left)) % right_size
                else:
                    left = (left + self._mixed(kind, step, right)) % left_size
            value = left * right_size + right
            if value < size:
                return value

    def of(self, value: int, size: int, kind: str, fits: Callable[[int], bool] = lambda _: True) -> int:
        """Within the numbers that ``fits`` allows, of which ``value`` is one: a permutation of them."""
        value = self.once(value, size, kind)
        while not fits(value):
            value = self.once(value, size, kind)
        return value


def _alphabet(c: int, hexadecimal: bool) -> bytes:
    if hexadecimal:
        return b"0123456789abcdef"
    return b"0123456789" if 48 <= c <= 57 else b"abcdefghijklmnopqrstuvwxyz" if 97 <= c <= 122 else b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" if 65 <= c <= 90 else b""


def _long(p: Permutation, raw: bytes, kind: str, alphabets: list[bytes]) -> bytes:
    """A long value in blocks, forwards and then backwards: each block's permutation follows from all blocks that went before."""
    blocks = [(at, min(at + BLOCK, len(raw))) for at in range(0, len(raw), BLOCK)]
    out = bytearray(raw)
    for way, order in (("forth", blocks), ("back", blocks[::-1])):
        told = hashlib.blake2b(f"{kind}|{way}|{len(raw)}".encode(), key=p.key, digest_size=16).digest()
        for low, high in order:
            out[low:high] = permute_characters(p, bytes(out[low:high]), f"{kind}|{way}|{told.hex()}", alphabets=alphabets[low:high])
            told = hashlib.blake2b(told + out[low:high], key=p.key, digest_size=16).digest()
    return bytes(out)


def permute_characters(p: Permutation, raw: bytes, kind: str, fits: Callable[[bytes], bool] = lambda _: True, hexadecimal: bool = False, alphabets: list[bytes] | None = None) -> bytes:
    """Digits to digits and letters to letters of the same case (or hexadecimal digits to such); the rest stays.

    ``alphabets``: what each byte may become. What ``fits`` asks of a value holds for those up to ``BLOCK`` bytes.
    """
    alphabets = alphabets or [_alphabet(c, hexadecimal) for c in raw]
    if len(raw) > BLOCK:
        return _long(p, raw, kind, alphabets)
    size, value = 1, 0
    for c, letters in zip(raw, alphabets, strict=True):
        if letters:
            size, value = size * len(letters), value * len(letters) + letters.index(c)

    def spelled(value: int) -> bytes:
        out = bytearray(raw)
        for i in range(len(raw) - 1, -1, -1):
            if alphabets[i]:
                value, at = divmod(value, len(alphabets[i]))
                out[i] = alphabets[i][at]
        return bytes(out)

    shape = "".join(str(len(a)) for a in alphabets)
    return spelled(p.of(value, size, f"{kind}|{shape}", lambda v: fits(spelled(v))))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def _filled(raw: bytes, digits: bytes) -> bytes:
    """``raw`` with its digits replaced in order."""
    rest = iter(digits)
    return bytes(next(rest) if 48 <= c <= 57 else c for c in raw)


def _card(p: Permutation, raw: bytes) -> bytes | None:
    """The first digit, which names the network, stays; the check digit is made anew."""
    digits = _digits(raw)
    if digits[:1] not in (b"2", b"3", b"4", b"5", b"6") or not luhn(digits) or len(set(digits)) < 3:
        return None
    body = permute_characters(p, digits[1:-1], "card")
    return _filled(raw, next(made for c in b"0123456789" if luhn(made := digits[:1] + body + bytes([c]))))


def _mod97(raw: bytes) -> int:
    moved = raw[4:] + raw[:4]
    return int("".join(str(c - 48) if c <= 57 else str(c - 55) for c in moved)) % 97


def _account(p: Permutation, raw: bytes) -> bytes | None:
    """The country stays; the check digits are made anew."""
    plain = raw.replace(b" ", b"")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permute_characters(p, plain[4:], "account")
    made = plain[:2] + b"%02d" % (98 - _mod97(plain[:2] + b"00" + body)) + body
    rest = iter(made)
    return bytes(c if c == 32 else next(rest) for c in raw)


def _address(p: Permutation, raw: bytes) -> bytes | None:
    """Within the addresses of as many digits at each place, so that the length stays."""
    octets = raw.split(b".")
    lengths = [len(o) for o in octets]
    low = [0 if n == 1 else 10 ** (n - 1) for n in lengths]
    count = [10 if n == 1 else 90 if n == 2 else 156 for n in lengths]
    at, size = 0, 1
    for o, a, n in zip(octets, low, count, strict=True):
        at, size = at * n + int(o) - a, size * n
    made = p.of(at, size, f"address|{lengths}")
    out = []
    for a, n in zip(reversed(low), reversed(count), strict=True):
        made, x = divmod(made, n)
        out.append(a + x)
    return b".".join(b"%d" % o for o in reversed(out))


def _social_fits(raw: bytes) -> bool:
    return raw[:3] not in (b"000", b"666") and raw[:1] != b"9" and raw[4:6] != b"00" and raw[7:] != b"0000"


def _read_date(raw: bytes) -> tuple[datetime.date, Callable[[datetime.date], bytes]] | None:
    """The date and how it is written; day before month unless only the other way is a date."""
    parts = [int(x) for x in re.split(rb"\D", raw)]
    sign = re.search(rb"\D", raw).group()
    if len(raw.split(sign)[0]) == 4:
        orders = [((0, 1, 2), lambda d: b"%04d%b%02d%b%02d" % (d.year, sign, d.month, sign, d.day))]
    else:
        a, b = (b"%02d" if len(x) == 2 else b"%d" for x in raw.split(sign)[:2])
        orders = [
            ((2, 1, 0), lambda d: a % d.day + sign + b % d.month + sign + b"%04d" % d.year),
            ((2, 0, 1), lambda d: a % d.month + sign + b % d.day + sign + b"%04d" % d.year),
        ]
    for (y, m, d), write in orders:
        try:
            date = datetime.date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        if 0 <= date.toordinal() - _FIRST_DAY < _DAYS and len(write(date)) == len(raw):
            return date, write
    return None


def _date(p: Permutation, raw: bytes) -> bytes | None:
    if (read := _read_date(raw)) is None:
        return None
    date, write = read
    written = lambda v: write(datetime.date.fromordinal(_FIRST_DAY + v))
    short = sum(len(x) == 1 for x in re.split(rb"\D", raw))
    fits = lambda v: len(written(v)) == len(raw) and [len(x) for x in re.split(rb"\D", written(v))] == [len(x) for x in re.split(rb"\D", raw)]
    return written(p.of(date.toordinal() - _FIRST_DAY, _DAYS, f"date|{short}", fits))


def _national(digits: bytes) -> bool:
    return digits[0] >= 50 and digits[3] >= 50


def _phone(p: Permutation, raw: bytes) -> bytes | None:
    """Of numbers of the North American plan the last ten digits; of others all but the first two.

    Codes stay valid if they are. Numbers without valid codes are taken only if written with a country code.
    """
    digits = _digits(raw)
    if raw[:1] != b"+" or digits[:1] == b"1":
        if len(digits) not in (10, 11):
            return None
        valid = _national(digits[-10:])
        if not valid and raw[:1] != b"+":
            return None
        return _filled(raw, digits[:-10] + permute_characters(p, digits[-10:], "phone" if valid else "number", lambda d: _national(d) == valid))
    return _filled(raw, digits[:2] + permute_characters(p, digits[2:], "phone")) if 8 <= len(digits) <= 15 else None


def _secret(p: Permutation, raw: bytes) -> bytes | None:
    at = re.search(rb"[A-Za-z0-9+/_\-]+\Z", raw).start()
    value = raw[at:]
    return raw[:at] + permute_characters(p, value, "secret", hexadecimal=re.fullmatch(rb"[0-9a-f]+", value) is not None)


def _key(p: Permutation, raw: bytes) -> bytes | None:
    keep = re.match(rb"(?:AKIA|ASIA|AIza|gh._|xox.-)", raw).end()
    return raw[:keep] + permute_characters(p, raw[keep:], "key")


@lru_cache(maxsize=10_000)
def _wide_alphabets(letter: str) -> list[bytes]:
    """The alphabets of the bytes of a letter beyond ASCII: its last byte may become that of a letter of the same case."""
    raw, kind = letter.encode(), unicodedata.category(letter)
    if not kind.startswith("L"):
        return [b""] * len(raw)
    others = (chr(ord(letter) & ~63 | i) for i in range(64))
    return [b""] * (len(raw) - 1) + [bytes(c.encode()[-1] for c in others if unicodedata.category(c) == kind)]


def _mail(p: Permutation, raw: bytes) -> bytes | None:
    """The local part from its first letter or digit on; signs before it and the domain, in lower case or not, stay."""
    local, _, domain = raw.rpartition(b"@")
    text = local.decode()
    # a mark beyond ASCII that is neither of a word nor a number, such as a quotation mark, ends what stands before
    start = max((i + 1 for i, c in enumerate(text) if c > "\x7f" and unicodedata.category(c)[0] not in "LMN"), default=0)
    while start < len(text) and not text[start].isalnum():
        start += 1
    if start == len(text):
        return None
    before, text = text[:start].encode(), text[start:]
    alphabets = [a for c in text for a in ([_alphabet(ord(c), False)] if c < "\x80" else _wide_alphabets(c))]
    return before + permute_characters(p, text.encode(), "mail", alphabets=alphabets) + b"@" + domain


def _social(p: Permutation, raw: bytes) -> bytes | None:
    return permute_characters(p, raw, "social", _social_fits) if _social_fits(raw) else None


_MAKE = {"mail": _mail, "account": _account, "key": _key, "secret": _secret, "address": _address, "card": _card, "social": _social, "date": _date, "phone": _phone}


class Pseudonyms:
    """Pseudonyms under one key."""

    def __init__(self, key: bytes):
        self.permutation = Permutation(key)
        self.made = lru_cache(maxsize=100_000)(lambda kind, raw: _MAKE[kind](self.permutation, raw))

    def found(self, raw: bytes) -> Iterator[tuple[int, int, str, bytes]]:
        """(start, end, kind, pseudonym) of what a text holds, from left to right. What fails its checks is read on from its second byte."""
        at = 0
        while m := _PATTERN.search(raw, at):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m.group(k) is not None)
            pseudonym = self.made(kind, m.group())
            if pseudonym is None:
                other = self._other(raw, m.start(), kind)
                if other is None:
                    at = m.start() + 1
                    continue
                kind, end, pseudonym = other
            else:
                end = m.end()
            yield m.start(), end, kind, pseudonym
            at = end

    def _other(self, raw: bytes, at: int, refused: str) -> tuple[str, int, bytes] | None:
        """The first of the later kinds that matches at the same place and passes."""
        for kind in KINDS[KINDS.index(refused) + 1 :]:
            if (m := _SINGLE[kind].match(raw, at)) and (pseudonym := self.made(kind, m.group())) is not None:
                return kind, m.end(), pseudonym
        return None


def _alternatives() -> dict[str, re.Pattern]:
    source, found = _PATTERN.pattern, {}
    starts = [source.index(b"(?P<" + k.encode() + b">") for k in KINDS] + [len(source) + 1]
    for k, a, b in zip(KINDS, starts[:-1], starts[1:], strict=True):
        found[k] = re.compile(source[a : b - 1])
    return found


_SINGLE = _alternatives()
_SIGNAL = np.zeros(256, bool)
_SIGNAL[[*range(48, 58), ord("@")]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the stretches in which something may be found: all that stands near a digit or an at sign.

    A stretch begins and ends at white space, several words away from the first and last sign in it, or with its text.
    Every pattern holds a sign in each of its words, or in the word next to it or the one after.
    """
    signals = np.flatnonzero(_SIGNAL[data])
    if not len(signals):
        return []
    blanks = np.concatenate([[-1] * CONTEXT, np.flatnonzero(_BLANK[data]), [len(data)] * CONTEXT])
    before = np.searchsorted(blanks, signals) - CONTEXT
    row = np.searchsorted(offsets, signals, "right") - 1
    low = np.maximum(blanks[before] + 1, offsets[row])
    high = np.minimum(blanks[before + 2 * CONTEXT - 1], offsets[row + 1])
    first = np.concatenate([[True], (low[1:] > np.maximum.accumulate(high)[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(first)
    return list(zip(row[at].tolist(), low[at].tolist(), np.maximum.reduceat(high, at).tolist(), strict=True))


def replace(texts: pa.Array, pseudonyms: Pseudonyms) -> tuple[pa.Array, list[dict[str, int]]]:
    """The texts with pseudonyms, and how many of each kind are in each. Nulls stay null."""
    data, offsets = text_bytes(texts)
    counts: list[dict[str, int]] = [{} for _ in range(len(texts))]
    out = None
    for row, low, high in windows(data, offsets):
        for start, end, kind, made in pseudonyms.found(data[low:high].tobytes()):
            if out is None:
                out = data.copy()
            out[low + start : low + end] = np.frombuffer(made, np.uint8)
            counts[row][kind] = counts[row].get(kind, 0) + 1
    if out is None:
        return texts, counts
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    made = made.cast(texts.type)
    return (pc.if_else(texts.is_valid(), made, pa.scalar(None, texts.type)) if texts.null_count else made), counts


def pseudonymise(docs: DataFrame, key: bytes, counted: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the column text; all else stays. With ``counted`` there is also n_found, by row.

    Null and empty texts stay. A column named n_found is replaced by the count. The key is sent to tasks, not written.
    """
    given = docs.sparkSession.sparkContext.broadcast(key)
    schema = docs.drop("n_found").schema if counted else docs.schema
    docs = docs.drop("n_found") if counted else docs

    def run(batches):
        pseudonyms = Pseudonyms(given.value)
        for batch in batches:
            for low, high in pieces(single(batch.column("text"))):
                part = batch.slice(low, high - low)
                texts, counts = replace(part.column("text"), pseudonyms)
                columns = [texts if n == "text" else part.column(n) for n in part.schema.names]
                names = list(part.schema.names)
                if counted:
                    columns, names = [*columns, pa.array([sum(c.values()) for c in counts], pa.int64())], [*names, "n_found"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema.add("n_found", "long") if counted else schema)
