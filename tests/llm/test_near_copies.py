"""Signatures against weighted Jaccard similarity, and classes against comparing all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from opslake import session
from opslake.llm import near_copies as N
from opslake.llm import words as W
from opslake.llm.components import components


def bag(text):
    words = [x.decode() for x in spelled(text)]
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] * bool(words))


def spelled(text):
    read = W.read(pa.array([text], pa.string()))
    return [read.spelled(i) for i in range(len(read.hash))]


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def brute(texts):
    """Class by id: the smallest id that links of at least the threshold lead to."""
    bags = {i: bag(t) for i, t in texts if t and bag(t)}
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if root(i) != root(j) and similarity(bags[i], bags[j]) >= N.THRESHOLD:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in texts}


def test_shingles():
    texts = ["a b c d e f", "a b c", None, "", "x " * 12, "A, b; C!", "a b c d e f"]
    of, shingle, count = N.counted_shingles(pa.array(texts))
    by = {}
    for t, s, c in zip(of.tolist(), shingle.tolist(), count.tolist(), strict=True):
        by.setdefault(t, Counter())[s] = c
    assert by[0] == by[6] and by[1] == by[5] and set(by) == {0, 1, 4, 5, 6}
    assert sorted(by[0].values()) == [1, 1] and sorted(by[4].values()) == [8]
    of, unit = N.units(of, shingle, count)
    assert np.bincount(of).tolist() == [2, 1, 0, 0, 8, 1, 2] and len(set(unit[of == 4])) == 8


@pytest.mark.parametrize("counts", [([1] * 40, [1] * 30 + [0] * 10), ([5, 1, 9, 200, 3], [5, 3, 2, 150, 0]), ([7], [1000]), ([1, 2, 3, 4], [4, 3, 2, 1])])
def test_signatures_are_unbiased(counts):
    """Over many families of the same weights, components agree as often as the weighted Jaccard similarity says."""
    families, agreed = 60, []
    for f in range(families):
        names = np.array([(f << 32) + i for i in range(len(counts[0]))], np.uint64)
        rows = [(d, n, c) for d, cs in enumerate(counts) for n, c in zip(names, cs, strict=True) if c]
        of, shingle, count = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.uint64, np.int64)))
        one, two = N.signatures(of, shingle, count, 2)
        agreed.append((one == two).mean())
    low, high = (sum(f(a, b) for a, b in zip(*counts, strict=True)) for f in (min, max))
    assert abs(np.mean(agreed) - low / high) < 4 * (0.25 / (families * N.COMPONENTS)) ** 0.5 + 0.005


def test_components(spark):
    pick = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 150)] + [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    frame = spark.createDataFrame([(b, a) if pick.random() < 0.5 else (a, b) for a, b in links], "a long, b long")
    got = {r["node"]: r["class"] for r in components(frame).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components(frame.limit(0)).count() == 0


def tables_between_releases(monkeypatch, run):
    """The most tables that ``run`` writes between two releases of what is out of use, and how many it writes in all."""
    cut, release = session.cut, session.release
    since, written = [0], [0]
    monkeypatch.setattr(session, "cut", lambda df: (since.__setitem__(-1, since[-1] + 1), written.__setitem__(0, written[0] + 1), cut(df))[-1])
    monkeypatch.setattr(session, "release", lambda spark: (since.append(0), release(spark)))
    run()
    return max(since), written[0]


def test_rounds_leave_nothing_behind(spark, monkeypatch):
    """A chain takes many rounds; each releases what the one before has shuffled and written."""
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    most, written = tables_between_releases(monkeypatch, lambda: components(links))
    assert written > 6 and most <= 2


def texts_of_families(pick):
    words = [a + b + c for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    rows = []
    for size, length, edits in [(1, 80, 0), (6, 120, 1), (25, 200, 6), (40, 60, 4), (12, 300, 20), (3, 4, 0), (5, 9, 1)]:
        base = [pick.choice(words) for _ in range(length)]
        for _ in range(size):
            made = list(base)
            for _ in range(pick.randrange(edits + 1)):
                made[pick.randrange(length)] = pick.choice(words)
            rows.append(" ".join(made))
    loop = " ".join(["again and again we say"] * 40)
    rows += [loop, loop + " x", " ".join(["again and again we say"] * 34), " ".join(["again and again we say"] * 20), rows[10], rows[10].upper() + "!"]
    pick.shuffle(rows)
    return rows


def test_classes_against_all_pairs(docs):
    rows = list(enumerate(texts_of_families(random.Random(9)), 5))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "")]
    frame = docs([*rows, (None, rows[3][1]), (rows[4][0], rows[4][1])])
    got = N.classes_of(frame).collect()
    assert len(got) == len(rows) + 2
    expected = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == expected
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    kept = N.one_of_each(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, c in expected.items() if i == c}
    assert N.classes_of(frame.limit(0)).count() == 0


def test_links_across_classes_of_a_bucket(spark, docs, monkeypatch):
    """Entries that aren't near the smallest of a bucket, but near others in it, are still linked; blocks change nothing."""
    pick = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):  # a chain: neighbours are near, the ends are not
        base[(7 * i) % 300] = f"v{i}"
        base[(7 * i + 150) % 300] = f"u{pick.random()}"
        rows.append((i, " ".join(base)))
    pick.shuffle(rows)
    expected = brute(rows)
    monkeypatch.setattr(N, "BLOCK", 7)
    assert {r.doc_id: r.class_id for r in N.classes_of(docs(rows)).collect()} == expected


def test_steps_leave_nothing_behind(docs, monkeypatch):
    """What one step of the near copies has shuffled and written is released before the next ones."""
    pick = random.Random(6)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(20):
        base[(7 * i) % 300] = f"v{i}"
        base[(7 * i + 150) % 300] = f"u{pick.random()}"
        rows.append((i, " ".join(base)))
    pick.shuffle(rows)
    frame = docs(rows)
    most, written = tables_between_releases(monkeypatch, lambda: N.one_of_each(frame))
    assert written > 12 and most <= 3


def test_links_of_an_id_with_several_texts_hold_in_every_round(docs):
    """Classes that only the texts of one id join are joined from the start, and stay so when later rounds add links."""
    pick = random.Random(8)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(40):  # a chain: neighbours are near, the ends are not
        base[(7 * i) % 300] = f"v{i}"
        base[(7 * i + 150) % 300] = f"u{pick.random()}"
        rows.append((i + 100, " ".join(base)))
    other = [f"x{i}" for i in range(200)]
    rows += [(139, " ".join(other)), (50, " ".join([*other, "end"])), (60, " ".join(f"y{i}" for i in range(100)))]
    pick.shuffle(rows)
    got = {r.doc_id: r.class_id for r in N.classes_of(docs(rows)).collect()}
    assert got == {**{i: 50 for i in range(100, 140)}, 50: 50, 60: 60}


def test_an_id_with_several_texts_links_by_each(docs):
    long = " ".join(f"a{i}" for i in range(200))
    short = " ".join(f"b{i}" for i in range(60))
    middle = " ".join(f"c{i}" for i in range(100))
    rows = [(1, long), (1, short), (1, middle), (2, long + " end"), (3, short + " end"), (4, middle + " end"), (5, "something else that is near to nothing"), (1, short)]
    got = {r.doc_id: r.class_id for r in N.classes_of(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_one_of_each_with_names_that_clash(spark, docs):
    docs([])
    names = ["copy", "id", "a", "b", "class", "class_id", "rep", "band", "bucket", "key", "hub", "node", "n"]
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(i, t, *["v"] * len(names)) for i, t in ((3, text), (1, text + " end"), (2, "other words"), (None, text))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = N.one_of_each(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2}
