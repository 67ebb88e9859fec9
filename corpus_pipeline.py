"""The corpus pipeline: five stages over `documents`, each on what its predecessor kept.

1. language: documents whose language is rejected go.
2. near_dedup: one document of each group of near-duplicates stays.
3. substring_dedup: passages that occur more than once go; so do documents that
   this leaves without a word.
4. decontamination: documents that overlap a benchmark item go.
5. tokens: the byte-level BPE ids of each document, and the digest of what they decode to.

Edge cases: a null or empty text, or one without a letter, has no language and goes in
stage 1, so an empty table or one of such texts gives an empty result; texts of any length
are taken whole; of rows that repeat each other, with or without an id, one stays, and of
near-duplicates the one of the smallest id (null is the largest); nulls in other columns
change nothing; columns besides those of `documents` are dropped, whatever their names.
Where no row holds both a text and a language there is nothing to learn from, and all go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import bpe_duckdb, decontaminate, langid, substrings, weighted_minhash
from velum.llm.common import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.predict(docs, langid.fit_folds(docs)).where("not rejected").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weighted_minhash.keep_one(docs, idf=weighted_minhash.inverse).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe_duckdb.encode(docs.select("doc_id", "text"), decoded="decoded")
    return bpe_duckdb.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL has no language classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
