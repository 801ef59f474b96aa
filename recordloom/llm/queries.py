"""The operators of this subpackage as queries over the driver's tables: name -> f(spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.session import spread
from . import bpe_codec, exact_dedup, impact_search, language_id, mixing, simhash_dedup, substring_dedup, token_count, token_files, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode_decode(_documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.repeated_spans(_documents(spark, sf_dir)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.table(simhash_dedup.near_groups(_documents(spark, sf_dir)))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir))


def op8_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_token_count": op7_token_count,
    "op8_impact_search": op8_impact_search,
    "op9_token_files": op9_token_files,
    "op10_mix_sources": op10_mix_sources,
}
SQL = {
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_impact_search": impact_search.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
}
