"""Every registered query of this subpackage runs over the smallest tables, with the agreed columns."""

import hashlib
import pathlib

import __spark_entry__ as entry
import pytest
import tiktoken

from test_decontaminate import brute as leaks
from test_near_copies import brute as classes
from test_repeats import brute as repeats

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
COLUMNS = {
    "op1": "page_id url text n_chars", "op2": "doc_id class_id", "op3": "doc_id text n_found", "op4": "doc_id held_out lang_pred score",
    "op5": "doc_id held_out score predicted", "op6": "conv_id turn role text reply_to thread position n_quotes n_linked", "op7": "query_id rank vec_id score",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated", "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11": "vec_id n_links component_id kept", "op12": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", "pipeline": "doc_id n_tokens ids decoded",
}
NAMES = {name.split("_")[0]: name for name in entry.queries() if name.split("_")[0] in COLUMNS and (name[:2] == "op" or name == "pipeline")}


def test_all_are_registered():
    assert set(NAMES) == set(COLUMNS)


@pytest.mark.parametrize("short", sorted(set(COLUMNS) - {"op2", "op8", "op9", "op10"}))
def test_query(spark, short):
    found = entry.queries()[NAMES[short]](spark, str(SF))
    assert found.columns == COLUMNS[short].split()
    rows = found.collect()
    whole = {"op1": "pages", "op6": "conversations", "op7": None, "op11": "embeddings", "op12": None, "pipeline": None}.get(short, "documents")
    if whole:
        assert len(rows) == spark.read.parquet(f"{SF}/{whole}.parquet").count()
    assert rows


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    docs = documents(spark)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    run = lambda short: {r.doc_id: r for r in entry.queries()[NAMES[short]](spark, str(SF)).collect()}
    got = run("op10")
    for (i, _), (left, removed, runs) in zip(docs, repeats(docs, 100), strict=True):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (removed, runs, hashlib.sha256(left).hexdigest())
    assert {i: r.class_id for i, r in run("op2").items()} == classes(docs)
    got = run("op8")
    for i, text in docs[:60]:
        words, hit, found = leaks(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (words, hit, len(found))


def test_tokens_as_the_library_makes_them(spark):
    import base64

    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in entry.queries()[NAMES["op9"]](spark, str(SF)).collect()}
    for i, text in documents(spark):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
