"""The pipeline on planted documents, and each stage against what brute force keeps."""

import random
import re

import corpus_pipeline
import public_tokenizers as P
import pytest
from opslake import session
from opslake.llm import bpe, queries
from opslake.llm.common import prepare

from test_decontaminate import brute as leaks
from test_near_copies import brute as classes

EN = "the and of to in that with from this have they were their which would there about".split()
DE = "der und die das ist nicht mit auf eine für den von sich werden haben über".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    prepare(spark)
    pick = random.Random(2)
    text = lambda words, n: " ".join(pick.choice(words) + str(pick.randrange(9)) * (pick.random() < 0.1) + pick.choice(["", "", "ly", "er"]) for _ in range(n))
    items = [(i, text(EN, 25)) for i in range(3)] + [(3, "short item of words")]
    rows = [(i, text(EN if i % 2 else DE, 90), "en" if i % 2 else "de") for i in range(60)]
    base = rows[5][1].split()
    for i in range(60, 70):
        base[i] = f"new{i}"
        rows.append((i, " ".join(base), "en"))
    rows += [(70, rows[7][1], "en"), (71, text(EN, 40) + " " + items[1][1] + " " + text(EN, 40), None), (72, "SHORT item, of\nwords!", "en")]
    rows += [(73, text(EN, 50) + " card 4539578763621486 ", "en"), (74, text(DE, 50) + " mail jo.doe@example.org", "de"), (75, None, "en"), (76, "", "de"), (77, "12 34 !", "en"), (None, text(EN, 60), "en")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = session.cut(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if n == 1:
            of = classes([r[:2] for r in want if r[0] is not None])
            want = [r for r in want if r[0] is None or of[r[0]] == r[0]]
        if n == 2:
            want = [r for r in want if not leaks(r[1], items)[1]]
        got = {r.doc_id: r.text for r in docs.collect()}
        assert set(got) == {r[0] for r in want}, n
        changed = {r[0] for r in want if got[r[0]] != r[1]}
        assert changed == ({73, 74} if n == 3 else set())


def test_languages_are_told_by_the_classifier(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    strange = spark.createDataFrame([(100, "αβγδεζη" * 50, None, "src", 350)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs.unionAll(strange), folder).collect()}
    assert 100 not in kept and kept == {r[0] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}


def test_run(spark, corpus):
    folder, rows, items = corpus
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not {70, 71, 72, 75, 76, 77} & set(found) and {73, 74, None} <= set(found)
    encoder = bpe.Encoder.of(queries.ranks(), P.PATTERN)
    for r in found.values():
        assert list(r.ids) == encoder.encode(r.decoded) and r.n_tokens == len(r.ids)
    assert "4539578763621486" not in found[73].decoded and len(found[73].decoded) == len(next(r[1] for r in rows if r[0] == 73))
