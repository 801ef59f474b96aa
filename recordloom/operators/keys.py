"""Keys of records, their document frequencies, and the choice of each record's rarest keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KeyConfig
from ..functions import text
from ..sources.session import staged


def token_keys(records: DataFrame) -> DataFrame:
    """(…, key, first): distinct name tokens; ``first`` is the place of the token's first occurrence in the corpus' order."""
    own = [c for c in ("source", "entity_id", "n") if c in records.columns]
    each = records.select(*own, "row_pos", F.posexplode(text.token_set(F.col("name_norm"))).alias("at", "key"))
    return each.select(*own, "key", F.struct("row_pos", "at").alias("place"))


def trigram_keys(records: DataFrame) -> DataFrame:
    own = [c for c in ("source", "entity_id", "n") if c in records.columns]
    return records.select(*own, F.explode(text.trigrams(F.col("name_key"))).alias("key"))


def document_frequency(keys: DataFrame) -> DataFrame:
    """(source, key, df[, first]) over target records, n being how many a row stands for if there is such a column; counts
    are combined before the shuffle."""
    count = F.sum("n") if "n" in keys.columns else F.count("*")
    first = [F.min("place").alias("first")] if "place" in keys.columns else []
    return keys.groupBy("source", "key").agg(count.alias("df"), *first)


def vocabulary(keys: DataFrame) -> DataFrame:
    """Distinct keys of a source by first occurrence."""
    return keys.groupBy("source", "key").agg(F.min("place").alias("first"))


#: Keys over a cap that are broadcast, at most.
MOST_OVER = 1 << 18


def _below_cap(keys: DataFrame, df: DataFrame, on: list[str], cap: int) -> DataFrame:
    """``keys`` without those that are over the cap wherever they occur."""
    over = df.groupBy(*on).agg(F.min("df").alias("least")).where(F.col("least") > cap).select(*on)
    return keys.join(F.broadcast(over), on, "left_anti") if over.limit(MOST_OVER + 1).count() <= MOST_OVER else keys


def rarest(keys: DataFrame, df: DataFrame, config: KeyConfig) -> DataFrame:
    """(source, entity_id, key, df, rank): each record's ``rarest`` keys by (df, order of the vocabulary).

    The cap is applied below the window, as only eligible keys are ranked, and below the join too: keys over the cap, of
    which there are few though they own most rows, are taken out before anything is shuffled by key. Tokens that are equally rare go by their first
    occurrence in the targets, trigrams by their code points. Keys without a source, those of the reference side, meet
    the frequencies of every source.
    """
    eligible = df.where(F.col("df") <= config.df_cap)
    on = [c for c in ("source", "key") if c in keys.columns]
    order = ["df", "first"] if "first" in df.columns else ["df", "key"]
    rank = F.row_number().over(Window.partitionBy("source", "entity_id").orderBy(*order))
    met = _below_cap(keys.drop("place", "n"), df, on, config.df_cap).join(eligible, on).withColumn("rank", rank)
    return met.where(F.col("rank") <= config.rarest).select("source", "entity_id", "key", "df", "rank")


def postings(targets: DataFrame, kind: str, config: KeyConfig) -> DataFrame:
    """The inverted index of a blocker as a table; saved and loaded as such, or bucketed by key."""
    keys = token_keys(targets) if kind == "token" else trigram_keys(targets)
    return rarest(keys, staged(document_frequency(keys), "frequencies"), config)


def describe(index: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys, postings, postings a key, and records without a key, by source."""
    keys = index.groupBy("source", "key").agg(F.count("*").alias("n")).groupBy("source").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_postings"), F.max("n").alias("max_posting"))
    rows = targets.groupBy("source").agg(F.count("*").alias("n_rows"))
    with_key = index.select("source", "entity_id").distinct().groupBy("source").agg(F.count("*").alias("n_indexed"))
    out = rows.join(keys, "source", "left").join(with_key, "source", "left").fillna(0)
    return out.select("source", "n_rows", "n_keys", "n_postings", "max_posting", (F.col("n_rows") - F.col("n_indexed")).alias("rows_without_key"), F.round(text.safe_div(F.col("n_postings"), F.col("n_keys")), 6).alias("postings_per_key"))
