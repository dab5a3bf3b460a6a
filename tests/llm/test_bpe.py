"""Chunked encoding against merges done one by one, and round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from opslake.llm import bpe
from opslake.llm.queries import ranks

RANKS = ranks()
TABLE = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RANKS.splitlines())}
MAKER = bpe.Encoder.of(RANKS, P.PATTERN)
pieces = st.sampled_from(["a", "the ", " ", "  ", "\n", "'", "'re", "é", "語語", "12", "!", "\t \n", "x" * 30, "' s", "　", "😀", "'l", "ll"])


def merged(text):
    """Byte-level BPE, merge by merge."""
    ids = []
    for piece in regex.findall(P.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((TABLE.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids += [TABLE[p] for p in parts]
    return ids


@settings(max_examples=80, deadline=None)
@given(st.lists(pieces, max_size=60).map("".join), st.integers(4, 40), st.integers(1, 3))
def test_stitched_equals_merged(text, overlap, factor):
    size = overlap * factor + 1
    found = list(bpe.chunks(text, size, overlap))
    read = [bpe.read_chunk(MAKER, at, part, i == len(found) - 1, size, overlap) for i, (at, part) in enumerate(found)]
    ids = bpe.stitch(read)
    assert ids is None or ids == merged(text)
    assert "".join(part[:size] for _, part in found[:-1]) + found[-1][1] == text


@pytest.mark.parametrize("blank", ["\n\n", "\n\n\n", " \n\n ", "\t\t", "  "])
def test_blank_lines_around_the_end_of_a_chunk(blank):
    for edge in (bpe.CHUNK, bpe.CHUNK + bpe.OVERLAP):
        for at in range(edge - 8, edge + 8):
            text = ("some words of a text. " * 3000)[: at - 1] + "." + blank + "Next" + " words follow" * 400
            found = list(bpe.chunks(text))
            read = [bpe.read_chunk(MAKER, start, part, i == len(found) - 1) for i, (start, part) in enumerate(found)]
            assert len(read) > 1 and bpe.stitch(read) == MAKER.encode(text), (edge, at)


def test_encode_and_decode(docs):
    pick = random.Random(5)
    long = "".join(pick.choice(["the ", "Ünï", "\n\n  ", "'re ", "9", "語", "un "]) for _ in range(900))
    texts = [None, "", " ", "a", "<|endoftext|>", long, "x" * 800, " " * 700 + "y", long, "tail " * 40 + "'"]
    frame = docs([*enumerate(texts), (None, "no id"), (3, long)])
    coded = bpe.encode(frame, RANKS, P.PATTERN, size=100, overlap=20)
    got = coded.collect()
    assert len(got) == len(texts) + 2
    known = {i: merged(t or "") for i, t in enumerate(texts)}
    for r in got:
        if r.doc_id is not None and r.ids != merged(long):
            assert r.ids == known[r.doc_id]
            assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    back = {r.doc_id: r.text for r in bpe.decode(coded.where("doc_id = 5 or doc_id = 7"), RANKS, P.PATTERN).collect()}
    assert back == {5: long, 7: texts[7]}
    digests = bpe.encode(frame, RANKS, P.PATTERN, size=100, overlap=20, digest=True).where("doc_id = 5").first()
    spelled = " ".join(map(str, known[5])).encode()
    assert digests == (5, len(known[5]), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(long.encode()).hexdigest())


def test_limits(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs([(1, "a")]), RANKS, P.PATTERN, size=5, overlap=5)
    assert bpe.encode(docs([]), RANKS, P.PATTERN).count() == 0
