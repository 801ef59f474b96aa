"""From raw documents to token ids of a training mix: language, exact copies, near copies, source weights, BPE.

Counted as part of ``recordloom.llm``. Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe_codec, exact_dedup, language_id, mixing, simhash_dedup
from recordloom.sources.session import scratch_dir, ship, spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or with none that has half of the text. The model learns from ``docs``; where no
    row has a language to learn, none is identified and all go. Null texts and those without a letter go."""
    ship(spark)
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest doc_id. Null counts as empty and a null id loses to any other."""
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by five-word shingles and a similarity of 0.8 or more, keeps the one with the smallest doc_id. Null and
    blank texts, if any came so far, are copies of each other; rows that repeat whole stay or go together."""
    ship(spark)
    return simhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training. A null source is one by itself, documents without
    words have no weight and are taken if their place lies within their source's target."""
    ship(spark)
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts, a row for each row of the mix, whatever its id or text."""
    ship(spark)
    return bpe_codec.digests(bpe_codec.encode_decode(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: SQL has neither the language model nor the fingerprints' hash; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``. Stages are written to the shared folder."""
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
