"""Kernel values against plain sets, and held-out accuracy on the test tables."""

import pathlib

import numpy as np
import pyarrow as pa
import pytest
from opslake.llm import language as L
from opslake.llm.common import crc_mod, table

SF = pathlib.Path("/root/testdata/sf0.01")
TEXTS = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "THE END and the rest", "die Übung und der Rest", "le été et la fin"] * 3
LABELS = ["en", "de", "fr", "en", "de", "fr"] * 3


def grams(text):
    raw = text.lower().encode()
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_presence_kernel():
    model = L.fit(TEXTS, LABELS)
    known = [int(c).to_bytes(n, "big") for c, n in model.grams]
    texts = [*TEXTS, "", "zzz", "ab", "t", "the " * 4000]
    shown = L.presence(L.lowered(pa.array(texts)), model.tables(), len(known))
    for row, text in zip(shown, texts, strict=True):
        assert {known[i] for i in np.flatnonzero(row)} == grams(text) & set(known)
    kernel = model.kernel(L.lowered(pa.array(texts)))
    a, b = (grams(t) & set(known) for t in (TEXTS[1], TEXTS[0]))
    assert kernel[1, 0] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, abs=1e-5)


def test_predict(spark, docs):
    model = L.fit(TEXTS, LABELS)
    rows = [(1, "the dog and the rest"), (2, "der Rest und die"), (3, None), (4, ""), (5, "12 345 !"), (6, "le chien et la"), (None, "the end"), (1, "the end")]
    frame = docs([*rows, (7, "der die und " * 50_000)])
    got = {(r.doc_id, r.lang_pred) for r in L.predict(frame, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (None, "en"), (7, "de")}
    assert L.predict(frame, model).where("score < 0 or score > 1 or score is null").count() == 0
    kept = L.keep(frame, model)
    assert kept.columns == frame.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 7]
    assert {r.lang_pred for r in L.predict(frame, None).collect()} == {"und"}
    assert L.keep(frame, None).count() == 0 and L.predict(frame.limit(0), model).count() == 0
    assert L.fit([], []) is None
    assert L.fit(["only"], ["en"]).languages == ["en"]


def test_every_labelled_language_is_learnt(spark):
    rows = [(i, f"word{i} of language l{i % 70}", f"l{i % 70}") for i in range(140)]
    rows += [(1000 + i, "ñandú " * 4000, "long") for i in range(2)] + [(2000 + i, "", "mixed") for i in range(2 * L.PER_LANGUAGE + 300)] + [(5000, "the only text", "mixed")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = L.sample(frame, L.F.lit(True))
    assert set(labels) == {f"l{i}" for i in range(70)} | {"long", "mixed"}
    assert labels.count("long") == 2 and labels.count("mixed") == 1 and max(len(t.encode()) for t in texts) <= L.SAMPLE_BYTES
    assert set(L.fit(texts, labels).languages) == set(labels)
    few = spark.createDataFrame([(i, "ñandú " * 4000 if i else "short", "one") for i in range(90)], "doc_id long, text string, lang string")
    texts, _ = L.sample(few, L.F.lit(True))
    assert len(texts) == L.FEW and "short" in texts


def test_keep_takes_the_decision_of_predict(docs):
    model = L.fit(TEXTS, LABELS)
    least = L.least_score(model)
    rows = [*enumerate(TEXTS[:6]), (10, "我能吞下"), (11, None), (12, "12 !"), (13, "the dog " + "filler " * 30_000)]
    frame = docs(rows)
    want = {r.doc_id for r in L.predict(frame, model).collect() if r.lang_pred != "und" and r.score >= least}
    kept = L.keep(frame, model, least)
    assert {r.doc_id for r in kept.collect()} == want and kept.schema == frame.schema
    assert set(range(6)) | {13} == want
    assert L.least_score(L.fit(["only"], ["en"])) == 1.0 == L.least_score(None)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_clean_documents_score_enough(spark):
    docs = table(spark, str(SF), "documents")
    model = L.fit(*L.sample(docs, crc_mod("doc_id", 3) != 1))
    assert L.keep(docs, model, L.least_score(model)).count() == docs.where(r"text rlike '\\p{L}'").count() > 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = table(spark, str(SF), "documents")
    texts, labels = L.sample(docs, crc_mod("doc_id", 3) != 1)
    held = {r[0] for r in docs.where(crc_mod("doc_id", 3) == 1).select("text").collect()}
    learnt = {r[0] for r in docs.where(crc_mod("doc_id", 3) != 1).select("text").collect()}
    assert set(texts) <= learnt and (texts, labels) == L.sample(docs, crc_mod("doc_id", 3) != 1)
    found = L.predict(docs, L.fit(texts, labels)).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 3) == 1)
    assert held and found.where("lang = lang_pred").count() >= 0.98 * found.count()
