"""Queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spillway.llm import chat, decontaminate, language_id, mixing, ngram_join, pii, quality, sharding, substring_dedup, suffix_array


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outliers(spark, _read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, _read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.label(spark, _read(spark, sf_dir, "documents"))


def op4_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(spark, _read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_links(spark, _read(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeats(spark, _read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, _read(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(spark, _read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_outliers": op1_quality_outliers,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_pii_redaction": op4_pii_redaction,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_mixing": op7_mixing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL = {
    "op2_sharding": sharding.SQL.format(docs="documents"),
    "op5_ngram_jaccard_join": ngram_join.LINKS_SQL.format(docs="documents"),
    "op6_suffix_array_dedup": suffix_array.SQL.format(docs="documents"),
    "op7_mixing": mixing.SQL.format(docs="documents"),
    "op9_decontamination": decontaminate.SQL.format(docs="documents", benchmark="benchmark"),
    "op10_substring_dedup": substring_dedup.SQL.format(docs="documents"),
}
