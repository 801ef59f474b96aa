"""A linkage corpus over the driver's documents: three sources by id, name and address from the first two lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NormConfig
from .session import spread, staged
from ..functions.normalize import address_norm, country_norm, name_norm, strip_separators


@dataclass(frozen=True)
class Corpus:
    """Reference records, target records with their source, true pairs, and reference entities with their pairs' number."""

    s1: DataFrame
    targets: DataFrame
    true_pairs: DataFrame
    truth: DataFrame


def records(spark: SparkSession, sf_dir: str, config: NormConfig = NormConfig()) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda n: F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(n))
    source = (1 + F.col("doc_id") % 3).cast("int")
    raw = docs.select(
        source.alias("source"),
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.col("doc_id").alias("row_pos"),
        line(1).alias("business_name"),
        line(2).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
        F.md5(F.col("text").cast("binary")).alias("text_hash"),
    )
    made = raw.withColumns({"name_norm": name_norm(F.col("business_name"), config), "address_norm": address_norm(F.col("business_address"), config), "country_norm": country_norm(F.col("country"), config)})
    return made.withColumn("name_key", strip_separators(F.col("name_norm")))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus, with records normalized once: every blocker and statistic reads the staged table."""
    all_records = staged(records(spark, sf_dir), "records")
    s1 = all_records.where("source = 1").drop("source")
    targets = all_records.where("source > 1")
    keyed = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("source"), F.md5(F.col("text").cast("binary")).alias("h"))
    name = F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    left = keyed.where("source = 1").select("h", name.alias("s1_id"), F.col("doc_id").alias("row_pos"))
    right = keyed.where("source > 1").select("h", name.alias("target_id"), "source")
    pairs = left.join(right, "h").select("s1_id", "target_id", "source")
    counts = pairs.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    truth = left.select("s1_id", "row_pos").join(counts, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0).cast("long")))
    return Corpus(s1, targets, pairs, truth)
