"""Wu-Manber search against a scan of every window."""

import hashlib
import random
import re

import pyarrow as pa
from opslake.llm import decontaminate as D
from opslake.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, window=10):
    """(words, hit words, items) by looking for every window at every position."""
    mine, hit, found = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        size = min(window, len(theirs))
        for i in range(len(theirs) - size + 1 if size else 0):
            for at in range(len(mine) - size + 1):
                if mine[at : at + size] == theirs[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(mine), len(hit), sorted(found)


def cases():
    pick = random.Random(3)
    vocabulary = ["a", "bb", "Ünï", "7", "the", "of", "x9", "語", "É", "end"]
    text = lambda n: "".join(pick.choice(vocabulary) + pick.choice([" ", ", ", "\n", "-", "_", "\x00"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([25, 25, 12, 10, 4, 1, 0, 30])]
    items += [(8, items[0][1].upper()), (2, text(11)), (None, "lost item"), (9, None)]
    docs = [None, "", "...", "the", text(3), text(700)]
    for _ in range(30):
        source = pick.choice(items[:8])[1]
        docs.append(text(pick.randrange(20)) + source + text(pick.randrange(300)) + source[: pick.randrange(len(source) + 1)])
    docs += [docs[-1]] * 3
    return items, docs


def test_words_of_all_bytes():
    texts = ["".join(map(chr, range(256))), None, "", "aB9é" * 5, "x" * 9000 + " y"]
    read = W.read(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        got = [read.spelled(j).decode() for j in range(read.first[i], read.first[i + 1])]
        assert got == words(t)
    again = W.read(pa.array([" ".join(texts[0:1]), "x" * 9000], pa.string()))
    assert again.hash[-1] == read.hash[-2]


def test_search(spark, docs):
    items, texts = cases()
    frame = docs(list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    usable = [x for x in items if x[0] is not None]
    for limit in (1 << 20, 400):  # one pass, then many that are merged
        got = {r[0]: r for r in D.search(frame, bench, block_bytes=limit).collect()}
        for i, t in enumerate(texts):
            assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == brute(t, usable), (limit, i)
    row = next(r for r in D.digest(D.search(frame, bench)).collect() if r.doc_id == 8)
    expected = brute(texts[8], usable)
    assert row.items_sha256 == hashlib.sha256(",".join(expected[2]).encode()).hexdigest()
    assert (row.n_items, row.contaminated) == (len(expected[2]), True)


def test_clean_and_empty(spark, docs):
    items, texts = cases()
    frame = docs(list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    usable = [x for x in items if x[0] is not None]
    left = [i for i, t in enumerate(texts) if not brute(t, usable)[1]]
    for limit in (1 << 20, 400):
        assert sorted(r.doc_id for r in D.clean(frame, bench, limit).collect()) == left
    assert D.clean(frame, bench).columns == frame.columns
    assert D.clean(frame, bench.limit(0)).count() == len(texts)
    assert D.search(frame.limit(0), bench).count() == 0


def test_null_and_repeated_ids(spark, docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = D.search(docs([(None, "one two"), (None, "one two"), (5, "one")]), bench).collect()
    assert sorted((r.doc_id is None, r.n_hit) for r in got) == [(False, 0), (True, 2), (True, 2)]
