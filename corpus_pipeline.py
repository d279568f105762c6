"""Cleaning of a corpus as a chain of stages, each stored before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.llm import bpe, leaks, secret_scan, shingle_join, toxicity
from motorpool.llm.common import prepared, table, written

TOKENIZER = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    prepared(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    prepared(spark)
    return shingle_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; all documents stay."""
    prepared(spark)
    return secret_scan.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with the columns of ``documents`` but the text."""
    prepared(spark)
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    found = bpe.encode_ids(rows, public_tokenizers.path(TOKENIZER), key="row")
    return found.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", replace_secrets),
    ("bpe", encode),
]

# The classifier, the random field and the tokenizer have no counterpart in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
