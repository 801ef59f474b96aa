"""Features of candidate pairs. Missing evidence is null, never 0; a failed text join blanks what comes from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text

#: Name -> type, in the order of the feature table.
TYPES = {
    "name_norm_equal": "byte",
    "name_key_equal": "byte",
    "name_token_jaccard": "float",
    "name_token_set_ratio": "float",
    "name_token_sort_ratio": "float",
    "name_partial_ratio": "float",
    "name_char3_jaccard": "float",
    "name_length_ratio": "float",
    "name_token_count_diff": "short",
    "name_first_token_equal": "byte",
    "address_norm_equal": "byte",
    "address_token_jaccard": "float",
    "address_shared_token_count": "short",
    "address_length_ratio": "float",
    "s1_address_missing": "byte",
    "target_address_missing": "byte",
    "both_address_missing": "byte",
    "token_df": "float",
    "char_jaccard": "float",
    "blocker_exact_name": "byte",
    "blocker_token": "byte",
    "blocker_char_ngram": "byte",
    "n_blockers": "byte",
    "s1_candidate_count": "int",
    "source_is_s2": "byte",
    "country_equal": "byte",
    "country_missing": "byte",
}
#: What must lie between 0 and 1.
UNIT = ("name_token_jaccard", "name_token_set_ratio", "name_token_sort_ratio", "name_partial_ratio", "name_char3_jaccard", "name_length_ratio", "address_token_jaccard", "address_length_ratio", "char_jaccard")
FUZZY = ("name_token_set_ratio", "name_token_sort_ratio", "name_partial_ratio")
PROVENANCE = ("token_df", "char_jaccard", "blocker_exact_name", "blocker_token", "blocker_char_ngram", "n_blockers", "s1_candidate_count", "source_is_s2")
IDS = ("s1_id", "target_id", "source")


def joined_text(candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with both sides' normalized text (a_…, b_…) and text_join_ok; no candidate is lost."""
    fields = ("name_norm", "name_key", "address_norm", "country_norm")
    left = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("a_found"))
    right = targets.select(F.col("entity_id").alias("target_id"), "source", *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("b_found"))
    out = candidates.join(left, "s1_id", "left").join(right, ["source", "target_id"], "left")
    return out.withColumn("text_join_ok", F.coalesce(F.col("a_found") & F.col("b_found"), F.lit(False))).drop("a_found", "b_found")


def _values(fuzzy: bool) -> dict[str, Column]:
    a, b = (lambda f: F.coalesce(F.col(f"a_{f}"), F.lit(""))), (lambda f: F.coalesce(F.col(f"b_{f}"), F.lit("")))
    flag = lambda c: F.when(c, 1).otherwise(0)
    equal = lambda f: flag((a(f) != "") & (a(f) == b(f)))
    both = lambda f, g: g(text.token_set(a(f)), text.token_set(b(f)))
    exact, token, char = text.provenance(F.col("blockers"))
    no_a, no_b = a("address_norm") == "", b("address_norm") == ""
    return {
        "name_norm_equal": equal("name_norm"),
        "name_key_equal": equal("name_key"),
        "name_token_jaccard": both("name_norm", text.set_jaccard),
        **({n: similarity.pairwise(f, a("name_norm"), b("name_norm")) for n, f in zip(FUZZY, (similarity.token_set_ratio, similarity.token_sort_ratio, similarity.partial_ratio))} if fuzzy else {}),
        "name_char3_jaccard": text.trigram_jaccard(a("name_key"), b("name_key")),
        "name_length_ratio": text.length_ratio(a("name_norm"), b("name_norm")),
        "name_token_count_diff": both("name_norm", lambda x, y: F.abs(F.size(x) - F.size(y))),
        "name_first_token_equal": flag((text.first_token(a("name_norm")) != "") & (text.first_token(a("name_norm")) == text.first_token(b("name_norm")))),
        "address_norm_equal": equal("address_norm"),
        "address_token_jaccard": both("address_norm", text.set_jaccard),
        "address_shared_token_count": both("address_norm", text.shared),
        "address_length_ratio": text.length_ratio(a("address_norm"), b("address_norm")),
        "s1_address_missing": flag(no_a),
        "target_address_missing": flag(no_b),
        "both_address_missing": flag(no_a & no_b),
        "token_df": F.col("token_df"),
        "char_jaccard": F.col("char_jaccard"),
        "blocker_exact_name": flag(exact),
        "blocker_token": flag(token),
        "blocker_char_ngram": flag(char),
        "n_blockers": flag(exact) + flag(token) + flag(char),
        "s1_candidate_count": F.count("*").over(Window.partitionBy("s1_id")),
        "source_is_s2": flag(F.col("source") == 2),
        "country_equal": equal("country_norm"),
        "country_missing": flag((a("country_norm") == "") | (b("country_norm") == "")),
    }


def pair_features(candidates: DataFrame, s1: DataFrame, targets: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The ids, the features of TYPES (without the fuzzy ratios if asked) and text_join_ok. Rows that repeat stay."""
    rows = joined_text(candidates, s1, targets)
    ok = F.col("text_join_ok")
    made = {}
    for name, value in _values(fuzzy).items():
        kind = TYPES[name]
        if name not in PROVENANCE:
            value = F.when(ok, value) if kind == "float" else F.when(ok, value).otherwise(0)
        made[name] = value.cast(kind)
    return rows.select(*IDS, *[v.alias(n) for n, v in made.items()], ok.cast("byte").alias("text_join_ok"))


def _in_unit(name: str) -> Column:
    inside = (F.col(f"{name}__l") >= 0) & (F.col(f"{name}__g") <= 1)
    return F.coalesce(inside, F.lit(True)) if name in UNIT else F.lit(None).cast("boolean")


def assert_unit(stats: DataFrame) -> None:
    """Raises ValueError with the features that leave the interval, of ``feature_stats``."""
    if out := [r.feature for r in stats.where("not in_unit_interval").select("feature").collect()]:
        raise ValueError(f"not between 0 and 1: {', '.join(sorted(out))}")


def accounting(candidates: DataFrame, made: DataFrame, sampled: bool = False) -> DataFrame:
    """(check, expected, found, holds): what must hold between candidates and their features. ``sampled`` where features
    are of a part of the entities: then each entity that is there must be there with all its candidates."""
    if sampled:
        candidates = candidates.join(made.select("s1_id").distinct(), "s1_id", "left_semi")
    count = lambda df: df.agg(F.count("*").alias("rows"), F.count_distinct("s1_id").alias("entities"), F.count_distinct("s1_id", "target_id").alias("pairs"))
    a, b = (count(df).select(F.struct("*").alias(n)) for df, n in ((candidates, "a"), (made, "b")))
    by_entity = made.groupBy("s1_id").agg(F.count("*").alias("n"), F.max("s1_candidate_count").alias("said"), F.min("s1_candidate_count").alias("least"))
    c = by_entity.agg(F.count("*").alias("entities"), F.count_if((F.col("n") == F.col("said")) & (F.col("n") == F.col("least"))).alias("right")).select(F.struct("*").alias("c"))
    one = a.join(F.broadcast(b)).join(F.broadcast(c))
    checks = {"rows_are_lossless": ("a.rows", "b.rows"), "entities_are_lossless": ("a.entities", "b.entities"), "pairs_are_lossless": ("a.pairs", "b.pairs"), "candidate_counts_are_whole": ("c.entities", "c.right")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(x).alias("expected"), F.col(y).alias("found"), (F.col(x) == F.col(y)).alias("holds")) for k, (x, y) in checks.items()])).alias("x")).select("x.*")


def feature_stats(features: DataFrame) -> DataFrame:
    """(feature, n, n_missing, least, greatest, in_unit_interval) in a row a feature; the last is null for features without
    that bound, and true where there is no value."""
    names = [c for c in features.columns if c in TYPES]
    aggs = [x for n in names for x in (F.count_if(F.col(n).isNull()).alias(f"{n}__m"), F.min(n).cast("double").alias(f"{n}__l"), F.max(n).cast("double").alias(f"{n}__g"))]
    one = features.agg(F.count("*").alias("n"), *aggs)
    parts = [
        F.struct(F.lit(n).alias("feature"), F.col("n"), F.col(f"{n}__m").alias("n_missing"), F.round(F.col(f"{n}__l"), 6).alias("least"), F.round(F.col(f"{n}__g"), 6).alias("greatest"), _in_unit(n).alias("in_unit_interval"))
        for n in names
    ]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def duplicate_pairs(candidates: DataFrame) -> DataFrame:
    """Rows, distinct pairs, and how many rows repeat a pair."""
    return candidates.agg(F.count("*").alias("n_rows"), F.count_distinct("s1_id", "target_id").alias("n_pairs")).withColumn("n_repeated", F.col("n_rows") - F.col("n_pairs"))
