"""The corpus pipeline: stages over the documents, each reading what the one before has written.

Documents without a language go, of each class of near copies the document with the smallest id stays, documents that
hold a benchmark passage go, personal data get pseudonyms, and what is left becomes token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake import session
from opslake.llm import bpe, decontaminate, language, near_copies, pseudonyms, queries
from opslake.llm.common import prepare, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the classifier tells from their whole text."""
    prepare(spark)
    model = queries.language_model(docs)
    return language.keep(docs, model, language.least_score(model))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    prepare(spark)
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data."""
    prepare(spark)
    return pseudonyms.pseudonymise(docs, queries.KEY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded, the text that the ids stand for."""
    prepare(spark)
    found = bpe.encode(docs, queries.ranks(), public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [
    ("language identification", identify),
    ("near-copy removal", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("personal data", pseudonymised),
    ("byte-level BPE", encoded),
]
#: Stages need models, signatures and keyed permutations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = session.scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
