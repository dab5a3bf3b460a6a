"""Removed bytes against a scan of every string in order."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from opslake.llm import repeats as R


def brute(docs, length):
    """(bytes left, bytes removed, runs) by row of (id, text) in order of ids."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                covered[i : i + length] = True
            seen.add(raw[i : i + length])
        covered = covered[:-1]
        left = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out.append((left, int(covered.sum()), int((np.diff(np.concatenate([[0], covered])) == 1).sum())))
    return out


def corpus(pick):
    words = ["the ", "of ", "é", "ab", "\n", "zq ", "語 "]
    text = lambda n: "".join(pick.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    docs = [None, "", "x", text(300), "a" * 400, "ab" * 300, shared[0] + shared[0]]
    for _ in range(60):
        docs.append("".join(pick.choice([text(pick.randrange(40)), pick.choice(shared), pick.choice(shared)[pick.randrange(30) :]]) for _ in range(4)))
    near = list(text(200))
    for _ in range(20):
        near[pick.randrange(len(near))] = pick.choice("uvw")
        docs.append("".join(near))
    docs += docs[7:20] + ["".join(near)] * 15
    return docs


@pytest.mark.parametrize(("length", "trigger", "hot", "piece"), [(20, 6, 20_000, 1 << 20), (20, 6, 3, 1 << 20), (100, 32, 20_000, 150), (33, 8, 5, 97)])
def test_against_scan(docs, monkeypatch, length, trigger, hot, piece):
    monkeypatch.setattr(R, "PIECE_BYTES", piece)
    texts = list(enumerate(corpus(random.Random(length + hot)), -3))
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in R.without_repeats(docs(texts).repartition(5), length=length, trigger=trigger, hot=hot).collect()}
    expected = brute(texts, length)
    assert [got[i] for i, _ in texts] == expected
    assert sum(e[1] for e in expected) > 0


def test_triggers_depend_on_the_string_only():
    pick = np.random.default_rng(3)
    inner = pick.integers(97, 100, 400).astype(np.uint8)
    seen = {}
    for before in (0, 3, 50, 117):
        data = np.concatenate([pick.integers(97, 100, before).astype(np.uint8), inner])
        found = R.parse(data, np.array([0, len(data)]), 100, 32)
        for low, high, trigger in zip(found.low, found.high, found.trigger, strict=True):
            for at in range(low, high + 1):
                assert seen.setdefault(data[at : at + 100].tobytes(), trigger) == trigger
    assert (found.high - found.low < 69).all() and (found.high - found.low + 1).sum() == len(data) - 99


def test_rows_and_ids(docs):
    line = "a line of more than twenty bytes "
    rows = [(2, line + "x"), (2, line + "x"), (None, "y" + line), (3, "z" * 9 + line), (1, None), (4, "")]
    got = sorted(((r.doc_id or 0, bytes(r.kept), r.n_bytes) for r in R.without_repeats(docs(rows), length=20, trigger=6).collect()))
    assert got == [(0, ("y" + line).encode(), 34), (1, b"", 0), (2, b"x", 34), (2, b"x", 34), (3, b"z" * 9, 42), (4, b"", 0)]
    assert R.without_repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        R.without_repeats(docs(rows), length=200, trigger=32)


@pytest.mark.parametrize("lowest", [5, -(1 << 63)])
def test_many_rows_without_an_id(docs, lowest):
    pick = random.Random(lowest)
    text = lambda n: "".join(pick.choice("abcdefghij") for _ in range(n))
    shared, last = text(40), text(50)
    rows = [(None, text(60) + (shared if i % 2 else "") + text(60)) for i in range(1500)] + [(lowest, last), (7, last + "!")]
    got = R.without_repeats(docs(rows).repartition(6), length=30, trigger=8).collect()
    removed = sorted(r.n_removed for r in got if r.doc_id is None)
    assert removed[:751] == [0] * 751 and all(40 <= n <= 56 for n in removed[751:])  # letters next to the passage may agree
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {lowest: 0, 7: 50}


def test_texts_of_one_id_are_told_apart(docs):
    pick = random.Random(6)
    texts = ["".join(pick.choice("abcdefghij") for _ in range(80)) for _ in range(300)]
    got = R.without_repeats(docs([(1, t) for t in texts] + [(2, texts[7])]), length=30, trigger=8).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 300 + [(2, 80)]


def test_a_parse_sums_the_second_lane_only_if_asked(monkeypatch):
    lanes, rolling = [], R.Rolling
    monkeypatch.setattr(R, "Rolling", lambda data, lane: lanes.append(lane) or rolling(data, lane))
    data = np.random.default_rng(5).integers(97, 123, 500).astype(np.uint8)
    found = R.parse(data, np.array([0, 200, 500]))
    assert len(found.low) and lanes == [0]
    phrases = [data[a : b + R.LENGTH] for a, b in zip(found.low, found.high, strict=True)]
    alone = [int(rolling(p, 1).of(np.array([0]), np.array([len(p)]))[0]) for p in phrases]
    assert found.second.of(found.low, found.high + R.LENGTH).tolist() == alone and lanes == [0, 1]


def test_bytes_travel_only_for_phrases_that_share_a_trigger(spark, docs, monkeypatch):
    pick = random.Random(8)
    text = lambda n: "".join(pick.choice("abcdefghij") for _ in range(n))
    near = text(300)
    texts = [text(400) for _ in range(200)] + [near, near[:150] + "xyz" + near[153:]]
    frame, sent = type(spark.range(0)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: sent.append(plain(self, *a, **k)) or sent[-1])
    monkeypatch.setattr(R, "BITS", 6, raising=False)  # filters of fixed size fill up as a corpus grows
    got = {r.doc_id: r.n_removed for r in R.without_repeats(docs(list(enumerate(texts))), length=30, trigger=8).collect()}
    assert [i for i, n in got.items() if n] == [201] and got[201] == 297
    spelled = sum(df.agg({"n": "sum"}).first()[0] or 0 for df in [d.selectExpr("octet_length(bytes) AS n") for d in sent if "bytes" in d.columns])
    assert 0 < spelled < 2000


def test_places_of_a_phrase_are_gathered_before_they_are_dealt():
    at = R._records(R._HASHED, a=np.array([5, 5, 5, 9, 7, 7], np.uint64), b=np.array([1, 1, 2, 1, 1, 1], np.uint64), id=np.array([3, 2, 1, 1, 4, 4]), place=np.array([1, 1, 1, 1, 8, 8]))
    alone, first, later = R._apart(at)
    assert alone.tolist() == [3] and later.tolist() == [0]
    assert first[:2].tolist() == [1, 2] and first[2] in (4, 5)  # the same row twice is one place


@pytest.mark.parametrize(("together", "compared", "hot"), [(1, 1, 4), (3, 50, 20_000), (2, 300, 1)])
def test_small_rows_and_steps(monkeypatch, together, compared, hot):
    """The steps in this process, as a worker has its own constants."""
    for name, value in (("TOGETHER", together), ("SPELLED", together), ("COMPARED", compared), ("PIECE_BYTES", 150), ("GATHERED", 64)):
        monkeypatch.setattr(R, name, value)
    texts = [(i, t or "") for i, t in enumerate(corpus(random.Random(together)))]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in texts], "version": [0] * len(texts), "text": [t for _, t in texts]})

    def grouped(dealt, work):
        rows = pa.Table.from_batches(dealt).sort_by("bucket")
        return list(R._groups(work)(rows.to_batches(max_chunksize=2)))

    def of(kind):
        return [b.filter(pc.equal(b["kind"], R._KINDS.index(kind))) for b in found]

    parts = [R._records(R._HASHED, a=p.trigger, b=p.second.of(p.low, p.high + 20), id=ids, place=places) for p, ids, places, _ in R._phrases(batch, 20, 6)]
    dealt = [b for part in parts for b in R._hashed(part, "a", 5)]
    assert max(len(x) for b in dealt for x in b["head"].to_pylist() if b["kind"][0].as_py() == 0) <= together * R._HASHED.itemsize
    found = grouped(dealt, R._phrases_told(hot, 5))
    heads = {r["i"]: r["head"] for b in grouped(of(R._SHARED), R._shared_lists) for r in b.to_pylist()}
    held = pa.RecordBatch.from_pydict({"text": [t for i, t in texts if i in heads], "head": [heads[i] for i, _ in texts if i in heads]})
    strings = grouped(list(R._spelled(20, 5)(held)), R._strings_told(20, 5))
    spans = {r["i"]: np.frombuffer(r["head"], np.int64).reshape(-1, 2).tolist() for b in grouped(of(R._LATER) + strings, R._span_lists(20)) for r in b.to_pylist()}
    for (i, text), (left, removed, runs) in zip(texts, brute(texts, 20), strict=True):
        raw, cuts = text.encode(), spans.get(i, [])
        assert (sum(b - a for a, b in cuts), len(cuts)) == (removed, runs)
        assert b"".join(raw[a:b] for a, b in zip([0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(raw)], strict=True)) == left
