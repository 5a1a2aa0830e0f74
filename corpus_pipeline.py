"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Each function takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All
but the last return the columns of their input.  SQL can't express the recurrent network of
the first stage, so ORACLE_SQL is None; the tests run the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spillway.llm import decontaminate, language_id, mixing, ngram_join, sharding
from spillway.llm.store import Store

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text of a known language."""
    return language_id.accepted(spark, docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near copies."""
    return ngram_join.keep_one(spark, docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked weights of source, language and topic."""
    return mixing.sample(spark, docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bytes, first byte and shard."""
    return sharding.shard(spark, docs)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing to target weights", mix_sources),
    ("sharding", cut_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.table(docs, f"stage-{k}")
            if k:
                store.drop(f"stage-{k - 1}")
    return docs
