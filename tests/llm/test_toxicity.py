"""The automaton against edit distances one by one; contexts; held-out accuracy on the test tables."""

import pathlib
import random

import numpy as np
import pytest
from opslake.llm import toxicity as T
from opslake.llm.common import crc_mod, table

SF = pathlib.Path("/root/testdata/sf0.1")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def accepted(word, terms):
    """(edits, term) of the best term, by trying all."""
    found = [(0, i) for i, t in enumerate(terms) if t.endswith("*") and word.startswith(t[:-1])]
    found += [(d, i) for i, t in enumerate(terms) if not t.endswith("*") and (d := distance(word, t)) <= T.edits_for(t)]
    return min(found)[0] if found else None


def test_automaton():
    terms = ["idiot", "scum", "worthless", "worthy", "lowei*", "aab", "tttttt"]
    automaton = T.Automaton.of(terms)
    pick = random.Random(1)
    words = ["", *terms[:4], "loweixyz", "lowe"]
    for _ in range(3000):
        word = list(pick.choice(terms).rstrip("*"))
        for _ in range(pick.randrange(4)):
            at = pick.randrange(len(word) + 1)
            word[at : at + pick.randrange(2)] = pick.choice(["", "i", "t", "z", "w"])
        words.append("".join(word))
    words = [w for w in words if w]
    _, codes, edges = T._codes([w + " " for w in words])
    first, _, _, edits, _ = automaton.hits(codes, edges)
    got = dict(zip(np.searchsorted(edges, first, "right") - 1, edits.tolist(), strict=True))
    for i, w in enumerate(words):
        assert got.get(i) == accepted(w, terms), w


def test_words_end_with_texts_and_signs():
    automaton = T.Automaton.of(["moron", "ete"])
    _, codes, edges = T._codes(["mor", "on", "", "a MOR0N!", "x-Eté.moron", "moron" * 2])
    first, end, term, _, words = automaton.hits(codes, edges)
    assert [(int(a), int(b)) for a, b in zip(first, end, strict=True)] == [(7, 12), (15, 18), (19, 24)]
    assert np.diff(words).tolist() == [1, 1, 0, 2, 3, 1]
    assert T.fold("Été M0r€") == "ete mor "


def test_context():
    say = lambda t: T.context_weight(t, t.index("idiot"), t.index("idiot") + 5)
    assert say("you idiot go away") == 1.0
    assert say('he said "you idiot" to them') == T.QUOTED
    assert say("« idiot »") == T.MARKED
    assert say('"fine" and you idiot "fine"') == 1.0


def labelled(docs):
    """Short texts; toxic ones hold a term after varied words."""
    pick = random.Random(4)
    words = [a + b for a in "ba ko ri tu me".split() for b in "lan sto wer pik dan".split()]
    rows, labels = [], []
    for i in range(600):
        text = [pick.choice(words) for _ in range(30)]
        if i % 3 == 0:
            text.insert(pick.randrange(30), pick.choice(["grumpface", "nasty" + pick.choice(words)]))
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 3 == 0)))
    rows += [(i, "same copied text with rareword inside") for i in range(600, 660)]
    labels += [(i, 0, 1) for i in range(600, 660)] + [(None, 0, 1), (1, None, None), (3, 0, 7)]
    return docs(rows), labels


def test_fit_and_score(spark, docs):
    frame, told = labelled(docs)
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    model = T.fit(frame, labels, crc_mod("doc_id", 5) != 0)
    assert "grumpface" in model.automaton.terms and not any("rareword".startswith(t.rstrip("*")) for t in model.automaton.terms)
    cases = [(1, "balan grumpface kosto"), (2, "balan grumpfaxe kosto"), (3, 'they said "grumpface" of balan'), (4, "balan kosto"), (5, None), (6, ""), (None, "nastybalan kosto"), (1, "grumpface")]
    got = {(r.doc_id, r.predicted) for r in T.score(docs([*cases, (7, "balan " * 30_000 + "grumpface " * 40)]), model).collect()}
    assert got >= {(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (None, 1)}
    assert T.score(frame, model).where("score < 0 or score > 1 or score is null").count() == 0
    assert T.fit(frame, labels.where("toxic = 0"), crc_mod("doc_id", 5) != 0) is None
    assert T.score(frame.limit(0), model).count() == 0
    assert {r.score for r in T.score(frame.limit(5), None).collect()} == {0.0}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_held_out(spark):
    docs, labels = table(spark, str(SF), "documents"), table(spark, str(SF), "labels")
    model = T.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    held = labels.where(crc_mod("doc_id", 5) == 0).select("doc_id", "toxic")
    found = T.score(docs.join(held, "doc_id"), model).join(held, "doc_id").toPandas()
    toxic = found.toxic == 1
    assert found[toxic].predicted.mean() > 0.85 and found[~toxic].predicted.mean() < 0.02
