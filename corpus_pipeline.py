"""Documents to training shards: language, near-duplicates, benchmark passages, mix, shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the
last return the columns of ``docs``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import decontamination, language, mixing, sharding, simhash
from hearsay.operators.scratch import store


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those that fit none of the learned languages."""
    return language.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose fingerprints are linked
    (shingles of three words, two differing bits)."""
    return simhash.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontamination.drop_contaminated(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source has its share of words."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles the documents into shards of equal counts."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

# Language models and hashes of 64 bits have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
