"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.llm import bpe, decontaminate, extract, hnsw, language, near_copies, neighbours, periodic, pseudonyms, quotes, repair, repeats, toxicity
from opslake.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def ranks(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query
def op9_overlapping_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, digest=True)


def language_model(docs: DataFrame) -> language.Model | None:
    """Fitted on rows whose crc32 of the id is not 1 modulo 3; of ids, only which rows those are is looked at."""
    return language.fit(*language.sample(docs, crc_mod("doc_id", 3) != 1))


@query
def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language_model(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op1_crf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_levenshtein_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: The key of the registered queries; a user gives their own.
KEY = b"registered queries"


@query
def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, KEY, counted=True)


@query
def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


@query
def op7_shifted_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes_of(table(spark, sf_dir, "documents"))


@query
def op10_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plant_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one id in ten by crc32, the words from some place on repeat their beginning; see ``op13_suffix_tree_runs``."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    struck = docs.where(crc % 10 == 0)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    struck = struck.select("doc_id", F.call_function("div", crc, F.lit(10)).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    struck = struck.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).cast("int"))
    rest = F.col("n") - F.col("a")
    struck = struck.withColumn("p", (1 + F.call_function("div", rest, 3 + F.col("g") % 8)).cast("int"))
    root = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(root, F.call_function("div", rest, F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again, F.slice("w", F.col("a") + 1, (rest % F.col("p")).cast("int"))), " ")
    whole = docs.where(F.coalesce(crc % 10 != 0, F.lit(True))).select("doc_id", "text")
    return whole.unionAll(struck.select("doc_id", F.when(F.col("n") > 0, planted).otherwise("").alias("text")))


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and the digests of all runs and of the words kept."""
    found = periodic.find(docs)
    ordered = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    best = F.array_min(ordered)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(plant_runs(table(spark, sf_dir, "documents")))


def damage_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1), loses its ends
    of sentences (2), is repeated (3) or becomes a user's (4). Nulls are read as one space, conv_id and turn stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_digest(conversations: DataFrame, chunk_turns: int = repair.CHUNK_TURNS) -> DataFrame:
    """A row for each conversation, damaged and repaired; one that lost all rows has zeros, no audit and the digest of nothing."""
    found = repair.repair(damage_turns(conversations), chunk_turns=chunk_turns)
    sums = repair.digests(found.turns)
    every = conversations.select("conv_id").distinct()
    at = lambda other: every["conv_id"].eqNullSafe(other["conv_id"])
    rows = every.join(found.audits, at(found.audits), "left").join(sums, at(sums), "left")
    counts = [F.coalesce(found.audits[c], F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(every["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


@query
def op12_persistent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


@query
def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.classes(table(spark, sf_dir, "embeddings"))
