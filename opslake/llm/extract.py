"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into blocks: runs of text between the borders of block elements, with the elements they stand in. Each
block has features of its ancestors (tags, words of class, id and role) and of its text (length, share of linked
text, punctuation, a few signs). A chain over the blocks of a page, trained on labelled pages, says which are main
text; Viterbi finds the best labelling of the whole page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opslake.llm.common import map_batches, single
from opslake.llm.labelled_pages import labelled

#: The rest of an opening tag after its name, up to its last sign.
_REST = r"(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: Tags that end a drawing or formula that was left open: opening or closing ones, and closing ones only.
_BREAK = "b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
_BREAK_END = "article|aside|button|figure|footer|form|header|html|label|main|nav|section|td|th|tr"
#: Elements of which everything up to the end tag, or to the end of the page, is no text. (Groups within possessive loops break re.)
_RAW = "|".join(rf"<{t}{_REST}>.*?(?:</{t}\s*>|\Z)" for t in ("script", "style", "template", "title", "noframes"))
#: HTML within a drawing or formula.
_FOREIGN = "|".join(rf"<{t}{_REST}>(?:[^<]++|<(?!/?(?:foreignobject|annotation-xml|svg|math|body)[\s/>]))*+</{t}\s*>" for t in ("foreignobject", "annotation-xml"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|template|textarea|iframe|noembed|title){_REST}>.*?(?:</\1\s*>|\Z)"
    # a head holds white space and these elements; anything else ends it, as its end tag may be left out
    rf"|<(head){_REST}>(?:\s++|<!--.*?(?:-->|\Z)|{_RAW}|<(?:meta|link|base|basefont|bgsound){_REST}>"
    rf"|<noscript{_REST}>(?:[^<]++|<(?!/?(?:noscript|head|body)[\s/>]))*+</noscript\s*>|</(?!(?:head|body|html|br)[\s>])[^>]*+>|<[!?][^>]*+>)*+(?:</head\s*>)?"
    # a drawing or formula that closes itself holds nothing
    rf"|<(svg|math){_REST}(?<!/)>(?:[^<]++|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|{_FOREIGN}"
    rf"|<(?!/\3\s*>|/?(?:{_BREAK})[\s/>]|/(?:{_BREAK_END})[\s/>]))*+(?:</\3\s*>)?"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>|[^<]++|<",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
#: Elements without an end.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a block of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br button".split())
#: What an opening tag of the group ends, if it is open and nothing of the other set stands between.
_ENDS = {t: (frozenset(g.split()), frozenset(u.split())) for names, g, u in (("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td th", "td th", "tr table"), ("option", "option", "select")) for t in names.split()}
_SIGNS = (("copyright", re.compile(r"[©®]|copyright|all rights reserved", re.I)), ("cookies", re.compile(r"\bcookies?\b", re.I)), ("call", re.compile(r"\b(?:subscribe|sign up|log ?in|newsletter|share|advert\w*|sponsored|reply)\b", re.I)))
_LABELS = 2
#: Signs of private use that carry the labels through the reading of labelled pages.
_MARKS = "\ue000\ue001"


@dataclass(slots=True)
class Block:
    """``place``: features of its ancestors; ``tag``: the nearest block element; ``linked``: characters within links."""

    text: str
    place: frozenset
    tag: str
    linked: int


@dataclass(slots=True)
class _Open:
    tag: str
    place: frozenset


def _own(tag: str, attributes: str) -> frozenset:
    found = {f"in:{tag}"}
    if attributes:
        for groups in _NAMES.findall(attributes):
            found.update(f"word:{w}" for w in _WORDS.findall(max(groups, key=len).lower()) if len(w) < 20)
    return frozenset(found)


def read_blocks(page: str, known: dict | None = None) -> list[Block]:
    """Leaf blocks in page order. Markup, comments, scripts, styles, drawings, formulas and the head have no text; white space is one space.

    With ``known``, only features in it are kept, which bounds what deep pages hold.
    """
    stack: list[_Open] = [_Open("", frozenset())]
    blocks: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    open_tags: Counter[str] = Counter()

    @lru_cache(maxsize=256)
    def own_features(tag: str, attributes: str) -> frozenset:
        own = _own(tag, attributes)
        return own if known is None else own.intersection(known)

    def pop(at: int) -> None:
        open_tags.subtract(o.tag for o in stack[at:])
        del stack[at:]

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                tag = next((o.tag for o in reversed(stack) if o.tag not in _INLINE), "")
                blocks.append(Block(text, stack[-1].place, tag, linked))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            token = m.group()
            if token[0] != "<" or len(token) == 1:
                text = html.unescape(token) if "&" in token else token
                parts.append(text)
                if links:
                    linked += len(text)
            elif m.lastindex:
                close()
            continue
        tag, end = tag.lower(), m["end"]
        inline = tag in _INLINE
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            close()
        if end:
            if tag == "a":
                links = max(0, links - 1)
            at = len(stack) - 1 if open_tags[tag] else 0
            while at and stack[at].tag != tag and not (inline and stack[at].tag not in _INLINE):
                at -= 1
            if at and stack[at].tag == tag:
                pop(at)
            continue
        if not inline and stack[-1].tag != "":
            ends, until = _ENDS.get(tag, (frozenset(("p",)), frozenset(("button", "td", "th", "object"))))
            at = len(stack) - 1
            while at and stack[at].tag not in ends and not (stack[at].tag in until or tag not in _ENDS and stack[at].tag not in _INLINE):
                at -= 1
            if at and stack[at].tag in ends:
                pop(at)
        if tag == "a":
            links += 1
        if tag not in _VOID and not m["rest"].endswith("/"):
            own, above = own_features(tag, m["rest"]), stack[-1].place
            stack.append(_Open(tag, above if own <= above else above | own))
            open_tags[tag] += 1
            if not inline:
                links = 0
    close()
    return blocks


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    found = [
        f"tag:{block.tag}", f"long:{min(12, n.bit_length())}", f"linked:{round(4 * min(1.0, block.linked / n))}",
        f"stops:{min(4, text.count('. ') + text.count('? ') + text.count('! '))}", f"ends:{text[-1] in '.!?…:;”\"'}", f"commas:{min(3, text.count(','))}",
    ]
    found += [f"sign:{name}" for name, sign in _SIGNS if n < 2000 and sign.search(text)]
    return found


@dataclass
class Chain:
    """Weights: by feature and label, of a label after a label, and of a first label."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    first: np.ndarray
    _places: dict = field(default_factory=dict)

    def scores(self, block: Block) -> tuple[float, float]:
        if (place := self._places.get(block.place)) is None:
            place = [0.0, 0.0]
            for f in block.place:
                if w := self.weights.get(f):
                    place[0] += w[0]
                    place[1] += w[1]
            if len(self._places) < 50_000:
                self._places[block.place] = place
        a, b = place
        for f in text_features(block):
            if w := self.weights.get(f):
                a += w[0]
                b += w[1]
        return a, b

    def decode(self, blocks: list[Block]) -> list[int]:
        """The labelling with the highest sum of weights; the lower label at ties."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a, b = 0.0, 0.0
        for i, block in enumerate(blocks):
            x, y = self.scores(block)
            if not i:
                a, b = self.first[0] + x, self.first[1] + y
                continue
            from_a, from_b = int(b + ba > a + aa), int(b + bb > a + ab)
            back.append((from_a, from_b))
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def training_pages() -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of the labelled pages: a block has the label of the fragment in which its text begins."""
    out = []
    for page in labelled():
        marked = "".join(re.sub(r"(?<=>)(?=[^<\s])", _MARKS[label], fragment) if fragment else "" for fragment, label in page)
        blocks, labels = [], []
        for block in read_blocks(f"<html><head><title>x</title></head><body>{marked}</body></html>"):
            sign = next((c for c in block.text if c in _MARKS), None)
            if sign is not None:
                block.text = block.text.replace(_MARKS[0], "").replace(_MARKS[1], "").strip() or "x"
                blocks.append(block)
                labels.append(_MARKS.index(sign))
        out.append((blocks, labels))
    return out


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 250, rate: float = 0.15, ridge: float = 0.02) -> Chain:
    """Maximise the likelihood of the labellings, less a ridge, by Adam; forward and backward sums run over all pages in step."""
    pages = [p for p in pages if p[0]]
    rows = [[sorted(b.place) + text_features(b) for b in blocks] for blocks, _ in pages]
    names = sorted({f for page in rows for row in page for f in row})
    index = {f: i for i, f in enumerate(names)}
    long = max(len(r) for r in rows)
    shown = np.zeros((len(rows), long, len(names)))
    label = np.zeros((len(rows), long), int)
    there = np.zeros((len(rows), long), bool)
    for p, (page, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        there[p, : len(page)], label[p, : len(page)] = True, labels
        for t, row in enumerate(page):
            shown[p, t, [index[f] for f in row]] = 1
    truth = np.eye(_LABELS)[label] * there[..., None]
    both = (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum(axis=(0, 1))
    sizes = [len(names) * _LABELS, _LABELS * _LABELS, _LABELS]
    x, m, v = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))
    log_sum = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for step in range(1, rounds + 1):
        w, moves, first = (part.reshape(shape) for part, shape in zip(np.split(x, np.cumsum(sizes)[:-1]), ((-1, _LABELS), (_LABELS, _LABELS), (_LABELS,)), strict=True))
        score = shown @ w
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = first + score[:, 0]
        for t in range(1, long):
            got = log_sum(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], got, forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            got = log_sum(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], got, 0)
        total = log_sum(forward[:, -1], 1)
        share = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        pair = np.exp(forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        slope = np.concatenate([np.einsum("ptf,ptl->fl", shown, truth - share).ravel(), (both - pair.sum(axis=(0, 1))).ravel(), (truth[:, 0] - share[:, 0]).sum(axis=0)])
        slope = slope / len(rows) - ridge * x / math.sqrt(len(rows))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, moves, first = np.split(x, np.cumsum(sizes)[:-1])
    return Chain({f: tuple(r) for f, r in zip(names, w.reshape(-1, _LABELS).tolist(), strict=True)}, moves.reshape(_LABELS, _LABELS), first)


def main_text(chain: Chain, page: str) -> str:
    blocks = read_blocks(page, chain.weights)
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None, key: str = "page_id") -> DataFrame:
    """Per page row: ``key``, url, text. Null or empty html, and pages without main text, give an empty text.

    Ids and urls may be null and rows may repeat; each row gives a row. Other columns are not looked at.
    """
    given = pages.sparkSession.sparkContext.broadcast(chain or train(training_pages()))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = 256
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            texts = [main_text(given.value, page) if page else "" for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([single(part.column(0)), single(part.column(1)), pa.array(texts, pa.string())], names=[key, "url", "text"])

    return map_batches(pages.select(key, "url", "html"), run, f"{key} {pages.schema[key].dataType.simpleString()}, url string, text string")
