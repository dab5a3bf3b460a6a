"""Runs against a search by definition."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from opslake.llm import periodic
from opslake.llm.queries import plant_runs, run_digest


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w, least=12):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and smallest_period(w[i : j + q]) == q:
                found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_suffixes_of_a_tree_are_in_order():
    make = random.Random(5)
    for _ in range(60):
        w = [make.randrange(3) for _ in range(make.randrange(1, 60))]
        tree = periodic.Tree(w)
        _, suffixes, _ = tree.tour()
        assert suffixes.tolist() == sorted(range(len(w) + 1), key=lambda i: w[i:])
        assert tree.opposite().tolist() == sorted(range(len(w) + 1), key=lambda i: [-x for x in w[i:]])
        extend = periodic.Extensions(tree)
        pairs = [(a, b) for a in range(len(w)) for b in range(a)]
        common = lambda a, b: next((k for k in range(len(w) - a) if w[a + k] != w[b + k]), len(w) - a)
        if pairs:
            a, b = map(np.array, zip(*pairs, strict=True))
            assert extend(a, b).tolist() == [common(x, y) for x, y in pairs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 12))
def test_runs_as_defined(w, least):
    assert [tuple(r) for r in periodic.runs(w, least).tolist()] == brute(w, least)


def sample(make):
    """Texts that hold planted runs of some period, side by side, nested and cut off."""
    w = [make.choice("abcdefgh") for _ in range(make.randrange(40))]
    for _ in range(make.randrange(4)):
        root = [make.choice("abcd") for _ in range(make.randrange(1, 9))]
        w += (root * make.randrange(1, 9))[: make.randrange(1, 60)] + [make.choice("abcdefgh") for _ in range(make.randrange(10))]
    return w


def test_texts_against_brute_force(docs):
    make = random.Random(11)
    texts = [make.choice([" ", "\n", " \t "]).join(sample(make)) for _ in range(300)]
    texts += [None, "", " \n ", "one", "x " * 12, "x " * 11, "\x00 " * 30, "  " * 13, " ".join(["aé", "b"] * 6), "x" * 100_000, "ab cd " * 3000]
    got = {r.doc_id: r for r in periodic.find(docs(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        w = [x for x in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        runs = brute(w) if len(w) < 2000 else [(0, len(w), 2)]
        assert got[i].n_words == len(w)
        assert [tuple(r) for r in got[i].runs] == runs, text
        assert got[i].collapsed == collapsed(w, runs)


def test_a_long_text_of_one_run_and_of_none(docs):
    make = random.Random(3)
    plain = [str(make.randrange(10**6)) for _ in range(30_000)]
    root = plain[:997]
    got = {r.doc_id: r for r in periodic.find(docs([(1, " ".join(plain)), (2, " ".join(root * 20))])).collect()}
    assert got[1].runs == [] and got[1].collapsed == " ".join(plain)
    assert [tuple(r) for r in got[2].runs] == [(0, 997 * 20, 997)] and got[2].collapsed == " ".join(root)


def test_nulls_repeated_rows_and_empty_tables(docs):
    rows = [(None, "a " * 20), (None, None), (4, "a " * 20), (4, "a " * 20)]
    got = periodic.find(docs(rows)).collect()
    assert sorted(len(r.runs) for r in got) == [0, 1, 1, 1]
    assert periodic.find(docs([])).collect() == []
    assert run_digest(plant_runs(docs([]))).collect() == []


def damaged(i, w):
    import zlib

    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]


@pytest.mark.parametrize("size", [1, 7, 200])
def test_the_digest_and_the_planted_runs(docs, size):
    make = random.Random(size)
    rows = [(i, " ".join(make.choice("abcdefghijkl") for _ in range(make.randrange(size + 1)))) for i in range(200)] + [(200, None), (30, "a  b\n" * size)]
    got = sorted(run_digest(plant_runs(docs(rows))).collect(), key=lambda r: (r.doc_id, r.collapsed_sha256))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        w = damaged(i, (text or "").split())
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        want.append((i, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found))))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0], r[-1]))
