"""Offline statistics: what signals reach the true pairs, how names and addresses overlap, how large postings are, what a
rarest-token probe and the exact-name blocker would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import keys
from ..operators.features import joined_text

CAPS = (100, 500, 1000, 5000, 10000, 50000)
POSTING_CAPS = (100, 500, 1000, 5000, 10000, 50000, 100000)
CHAR_GRID = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ADDRESS_GRID = (0.2, 0.3, 0.5, 0.7, 0.8, 0.9)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
CANDIDATE_BUCKETS = ((1, 1), (2, 5), (6, 20), (21, 100), (101, 1000))
SIGNALS = ("exact", "token", "char", "address")


def distribution(c: Column, prefix: str) -> list[Column]:
    """n, mean, least, greatest and quantiles (linear between ranks) of a column."""
    r = lambda x: F.round(x, 6)
    return [F.count(c).alias(f"{prefix}_n"), r(F.avg(c)).alias(f"{prefix}_mean"), r(F.min(c).cast("double")).alias(f"{prefix}_min"), r(F.max(c).cast("double")).alias(f"{prefix}_max")] + [
        r(F.percentile(c, q)).alias(f"{prefix}_p{round(q * 100)}") for q in QUANTILES
    ]


def capped_histogram(df: DataFrame, value: Column, most: int) -> DataFrame:
    """(bucket, n) with everything from ``most`` on in one bucket."""
    return df.groupBy(F.least(value, F.lit(most)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def candidate_bucket(c: Column) -> Column:
    out = F.lit("0")
    for low, high in CANDIDATE_BUCKETS:
        out = F.when((c >= low) & (c <= high), F.lit(f"{low}" if low == high else f"{low}-{high}")).otherwise(out)
    return F.when(c > CANDIDATE_BUCKETS[-1][1], F.lit(f">{CANDIDATE_BUCKETS[-1][1]}")).otherwise(out)


def jaccard_bucket(c: Column) -> Column:
    """Right-closed bins; 0 is a bin of its own."""
    out, low = F.when(c <= 0, F.lit("0")), 0.0
    for high in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0):
        out = out.when(c <= high, F.lit(f"({low:g},{high:g}]"))
        low = high
    return out


def combined_df(targets: DataFrame) -> DataFrame:
    """(key, df) of tokens over all sources."""
    return keys.document_frequency(keys.token_keys(targets)).groupBy("key").agg(F.sum("df").alias("df"))


def pair_statistics(true_pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a true pair: equality, similarities, token counts, the least frequency of a shared token (0: none)."""
    rows = joined_text(true_pairs, s1, targets)
    ta, tb = text.token_set(F.col("a_name_norm")), text.token_set(F.col("b_name_norm"))
    da, db = text.token_set(F.col("a_address_norm")), text.token_set(F.col("b_address_norm"))
    rows = rows.withColumns({"shared_names": F.array_intersect(ta, tb), "addr_a": F.size(da), "addr_b": F.size(db), "addr_shared": text.shared(da, db)})
    each = rows.select("s1_id", "target_id", F.explode("shared_names").alias("key"))
    least = each.join(combined_df(targets), "key").groupBy("s1_id", "target_id").agg(F.min("df").alias("min_df"))
    rows = rows.join(least, ["s1_id", "target_id"], "left")
    both = (F.col("addr_a") > 0) & (F.col("addr_b") > 0)
    return rows.select(
        "s1_id",
        "target_id",
        "source",
        (F.col("a_name_norm") == F.col("b_name_norm")).alias("name_equal"),
        F.coalesce("min_df", F.lit(0)).alias("min_df"),
        F.size("shared_names").alias("n_shared"),
        text.trigram_jaccard(F.col("a_name_key"), F.col("b_name_key")).alias("char_jaccard"),
        "addr_a",
        "addr_b",
        "addr_shared",
        both.alias("both_addresses"),
        text.safe_div(F.col("addr_shared"), F.col("addr_a") + F.col("addr_b") - F.col("addr_shared")).alias("addr_jaccard"),
        text.overlap_coefficient(F.col("addr_shared"), F.col("addr_a"), F.col("addr_b")).alias("addr_overlap"),
        "a_name_norm",
        "b_name_norm",
    )


def signal_columns(pairs: DataFrame, cap: int = 1000, char: float = 0.5, address: float = 0.5) -> DataFrame:
    """Adds a boolean for each of SIGNALS."""
    return pairs.withColumns(
        {
            "exact": F.col("name_equal"),
            "token": (F.col("min_df") > 0) & (F.col("min_df") <= cap),
            "char": F.col("char_jaccard") >= char,
            "address": F.col("both_addresses") & (F.col("addr_jaccard") >= address),
        }
    )


def signal_coverage(signals: DataFrame) -> DataFrame:
    """(signal, n_pairs, pct, n_entities) for each signal, any and none."""
    any_ = F.col("exact") | F.col("token") | F.col("char") | F.col("address")
    conditions = {s: F.col(s) for s in SIGNALS} | {"any": any_, "none": ~any_}
    hit = [F.when(c, F.lit(n)) for n, c in conditions.items()]
    each = signals.select("s1_id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("signal"))
    counts = each.groupBy("signal").agg(F.count("*").alias("n_pairs"), F.count_distinct("s1_id").alias("n_entities"))
    names = signals.sparkSession.createDataFrame([(n,) for n in conditions], "signal string")
    total = signals.agg(F.count("*").alias("total"))
    out = names.join(F.broadcast(counts), "signal", "left").join(total).fillna(0, ["n_pairs", "n_entities"])
    return out.select("signal", "n_pairs", "n_entities", text.percent(F.col("n_pairs"), F.col("total")).alias("pct_of_pairs"))


def signal_combinations(signals: DataFrame) -> DataFrame:
    """(signals, n_pairs, n_entities) for all sixteen combinations."""
    mask = sum((F.col(s).cast("int") * (1 << i) for i, s in enumerate(SIGNALS)), F.lit(0))
    counts = signals.groupBy(mask.alias("mask")).agg(F.count("*").alias("n_pairs"), F.count_distinct("s1_id").alias("n_entities"))
    label = lambda m: "+".join(s for i, s in enumerate(SIGNALS) if m >> i & 1) or "none"
    names = signals.sparkSession.createDataFrame([(m, label(m)) for m in range(16)], "mask int, signals string")
    return names.join(F.broadcast(counts), "mask", "left").fillna(0).drop("mask")


def signal_outcomes(signals: DataFrame) -> DataFrame:
    """Entities of which all, some or none of the true pairs are reached."""
    any_ = F.col("exact") | F.col("token") | F.col("char") | F.col("address")
    by_entity = signals.groupBy("s1_id").agg(F.count("*").alias("n"), F.count_if(any_).alias("k"))
    return by_entity.agg(F.count_if(F.col("k") == F.col("n")).alias("n_all"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("n_some"), F.count_if(F.col("k") == 0).alias("n_none"))


def signal_grid(pairs: DataFrame) -> DataFrame:
    """(signal, threshold, n_pairs) over the grids of caps and similarities, in one pass."""
    tests = [("token", float(c), (F.col("min_df") > 0) & (F.col("min_df") <= c)) for c in CAPS]
    tests += [("char", j, F.col("char_jaccard") >= j) for j in CHAR_GRID]
    tests += [("address", j, F.col("both_addresses") & (F.col("addr_jaccard") >= j)) for j in ADDRESS_GRID]
    one = pairs.agg(*[F.count_if(t).alias(f"n{i}") for i, (_, _, t) in enumerate(tests)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(x).alias("threshold"), F.col(f"n{i}").alias("n_pairs")) for i, (s, x, _) in enumerate(tests)])).alias("x")).select("x.*")


def address_overlap(pairs: DataFrame) -> DataFrame:
    """Counts of address overlap by scope (all, a source) and group (all, both addresses, names alike, names differ)."""
    scope = F.explode(F.array(F.lit("all"), F.concat(F.lit("source"), F.col("source").cast("string"))))
    groups = F.filter(
        F.array(F.lit("all"), F.when(F.col("both_addresses"), F.lit("both_addresses_present")), F.when(F.col("name_equal"), F.lit("name_norm_identical")).otherwise(F.lit("name_norm_differs"))), lambda x: x.isNotNull()
    )
    rows = pairs.withColumn("scope", scope).withColumn("pair_group", F.explode(groups))
    both, n = F.col("both_addresses"), F.col("addr_shared")
    return rows.groupBy("scope", "pair_group").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(both).alias("n_both"),
        F.count_if(n == 0).alias("n_zero_shared"),
        F.count_if(n >= 1).alias("n_1_shared"),
        F.count_if(n >= 2).alias("n_2_shared"),
        F.count_if(n >= 3).alias("n_3_shared"),
        F.count_if(both & (F.col("addr_jaccard") >= 0.5)).alias("n_jaccard_50"),
        F.count_if(both & (F.col("addr_jaccard") >= 0.8)).alias("n_jaccard_80"),
        F.count_if(both & (F.col("addr_overlap") >= 0.8)).alias("n_overlap_80"),
        F.count_if(both & (F.col("addr_overlap") >= 1)).alias("n_overlap_100"),
        F.round(F.avg("addr_shared"), 6).alias("mean_shared"),
        F.round(F.avg(F.when(both, F.col("addr_jaccard"))), 6).alias("mean_jaccard"),
    )


def scoped_df(targets: DataFrame) -> DataFrame:
    """(scope, key, df): tokens of each source, and of all."""
    by_source = keys.document_frequency(keys.token_keys(targets)).select(F.concat(F.lit("source"), F.col("source").cast("string")).alias("scope"), "key", "df")
    return by_source.unionByName(by_source.groupBy("key").agg(F.sum("df").alias("df")).select(F.lit("all").alias("scope"), "key", "df"))


def posting_summary(targets: DataFrame) -> DataFrame:
    return scoped_df(targets).groupBy("scope").agg(F.count("*").alias("n_tokens"), F.sum("df").alias("n_occurrences"), *distribution(F.col("df"), "df"), F.round(F.percentile("df", 0.999), 6).alias("df_p99_9"))


def posting_caps(targets: DataFrame) -> DataFrame:
    """(scope, cap, n_tokens_over, n_postings_over, …), all caps in one pass."""
    d = F.col("df")
    sums = scoped_df(targets).groupBy("scope").agg(F.count("*").alias("n"), F.sum("df").alias("t"), *[x for c in POSTING_CAPS for x in (F.count_if(d > c).alias(f"a{c}"), F.coalesce(F.sum(F.when(d > c, d)), F.lit(0)).alias(f"b{c}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"a{c}").alias("n_tokens_over"), F.col(f"b{c}").alias("n_postings_over")) for c in POSTING_CAPS])
    rows = sums.select("scope", "n", "t", F.explode(parts).alias("x")).select("scope", "n", "t", "x.*")
    return rows.select("scope", "cap", "n_tokens_over", "n_postings_over", text.percent(F.col("n_tokens_over"), F.col("n")).alias("pct_tokens_over"), text.percent(F.col("n_postings_over"), F.col("t")).alias("pct_postings_over"))


def top_tokens(targets: DataFrame, n: int = 25) -> DataFrame:
    """The most frequent tokens over all targets with ln(records / frequency); ties by token."""
    total = targets.agg(F.count("*").alias("total"))
    top = combined_df(targets).orderBy(F.desc("df"), "key").limit(n)
    return top.join(total).select("key", "df", text.percent(F.col("df"), F.col("total")).alias("pct_of_entities"), F.round(F.ln(F.col("total") / F.col("df")), 6).alias("idf"))


def pair_rarity(pairs: DataFrame) -> DataFrame:
    """(subset, cap, n_usable, n_missed, volume): true pairs with a shared token up to each cap, and what probing costs."""
    differ = ~F.col("name_equal")
    subsets = F.filter(
        F.array(F.lit("all_true_pairs"), F.when(differ, F.lit("name_norm_differs")).otherwise(F.lit("name_norm_identical")), F.when(differ, F.concat(F.lit("name_norm_differs_source"), F.col("source").cast("string")))),
        lambda x: x.isNotNull(),
    )
    d = F.col("min_df")
    rows = pairs.select("min_df", F.explode(subsets).alias("subset"))
    sums = rows.groupBy("subset").agg(F.count("*").alias("n"), *[x for c in CAPS for x in (F.count_if((d > 0) & (d <= c)).alias(f"a{c}"), F.coalesce(F.sum(F.when(d <= c, d)), F.lit(0)).alias(f"b{c}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"a{c}").alias("n_usable"), F.col(f"b{c}").alias("volume")) for c in CAPS])
    out = sums.select("subset", "n", F.explode(parts).alias("x")).select("subset", "n", "x.*")
    return out.select("subset", "cap", "n_usable", (F.col("n") - F.col("n_usable")).alias("n_missed"), text.percent(F.col("n_usable"), F.col("n")).alias("pct_usable"), "volume")


def census(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, n_tokens, n_present, rarest, n_true): for each reference entity the least frequency of its name tokens."""
    tokens = keys.token_keys(s1).join(combined_df(targets), "key", "left")
    by_entity = tokens.groupBy("entity_id").agg(F.count("*").alias("n_tokens"), F.count("df").alias("n_present"), F.coalesce(F.min("df"), F.lit(0)).alias("rarest"))
    out = s1.select("entity_id").join(by_entity, "entity_id", "left").fillna(0)
    return out.withColumnRenamed("entity_id", "s1_id").join(truth.select("s1_id", "n_true"), "s1_id")


def census_summary(rows: DataFrame, cap: int = 1000) -> DataFrame:
    """Volume of a probe of the rarest token, the structural zeros by reason, and the ratio to true pairs."""
    usable = (F.col("rarest") > 0) & (F.col("rarest") <= cap)
    est = F.when(usable, F.col("rarest")).otherwise(0)
    rows = rows.withColumns({"usable": usable, "est": est})
    has = F.col("n_true") > 0
    return rows.agg(
        F.count("*").alias("n_entities"),
        F.count_if(~F.col("usable")).alias("n_structural_zero"),
        F.count_if(F.col("n_tokens") == 0).alias("n_empty_name"),
        F.count_if((F.col("n_tokens") > 0) & (F.col("n_present") == 0)).alias("n_no_token_in_targets"),
        F.count_if((F.col("n_present") > 0) & ~F.col("usable")).alias("n_every_token_above_cap"),
        F.sum("est").alias("total_estimate"),
        *distribution(F.col("est"), "est"),
        F.round(text.safe_div(F.sum(F.when(has, F.col("est"))), F.sum("n_true")), 6).alias("candidates_per_true_pair"),
        F.count_if(has & (F.col("est") < F.col("n_true"))).alias("n_below_one"),
        F.count_if(has & (F.col("est") == 0)).alias("n_matched_without_candidates"),
    )


def census_by_cap(rows: DataFrame) -> DataFrame:
    d = F.col("rarest")
    one = rows.agg(F.count("*").alias("n"), *[x for c in CAPS for x in (F.count_if((d > 0) & (d <= c)).alias(f"a{c}"), F.coalesce(F.sum(F.when(d <= c, d)), F.lit(0)).alias(f"b{c}"), F.coalesce(F.max(F.when(d <= c, d)), F.lit(0)).alias(f"m{c}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"a{c}").alias("n_reached"), (F.col("n") - F.col(f"a{c}")).alias("n_structural_zero"), F.col(f"b{c}").alias("total_estimate"), F.col(f"m{c}").alias("max_estimate")) for c in CAPS])
    return one.select(F.explode(parts).alias("x")).select("x.*")


def census_top(rows: DataFrame, cap: int = 1000, n: int = 25) -> DataFrame:
    est = F.when((F.col("rarest") > 0) & (F.col("rarest") <= cap), F.col("rarest")).otherwise(0)
    return rows.select("s1_id", est.alias("estimate"), "n_true").where("estimate > 0").orderBy(F.desc("estimate"), "s1_id").limit(n)


def exact_by_entity(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1_id, n_exact): exact-name candidates of each entity, without making the pairs: postings are counted first."""
    sizes = targets.where(F.length("name_norm") > 0).groupBy("name_norm").agg(F.count("*").alias("n"))
    return s1.select(F.col("entity_id").alias("s1_id"), "name_norm").join(sizes, "name_norm", "left").select("s1_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_exact"))


def exact_postings(targets: DataFrame) -> DataFrame:
    """By source: distinct names, names that repeat, rows in those, the distribution of postings."""
    by_name = targets.where(F.length("name_norm") > 0).groupBy("source", "name_norm").agg(F.count("*").alias("n"))
    return by_name.groupBy("source").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows_in_repeated"), *distribution(F.col("n"), "posting"))


def exact_summary(by_entity: DataFrame) -> DataFrame:
    n = F.col("n_exact")
    return by_entity.agg(F.count("*").alias("n_entities"), F.count_if(n > 0).alias("n_with_candidate"), F.sum(n).alias("n_candidate_rows"), *distribution(n, "candidates"))


def reachability(census_rows: DataFrame, exact_rows: DataFrame, cap: int = 1000) -> DataFrame:
    """Entities by whether the token probe and the exact name reach them."""
    token = (F.col("rarest") > 0) & (F.col("rarest") <= cap)
    both = census_rows.join(exact_rows, "s1_id").select(token.alias("by_token"), (F.col("n_exact") > 0).alias("by_exact"), "n_true")
    return both.groupBy("by_token", "by_exact").agg(F.count("*").alias("n_entities"), F.count_if(F.col("n_true") > 0).alias("n_matched"))


def zero_match_pairs(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact-name candidates of entities without a true match, with their address similarity."""
    zero = s1.join(truth.where("n_true = 0").select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    left = zero.where(F.length("name_norm") > 0).select("name_norm", F.col("entity_id").alias("s1_id"), text.token_set(F.col("address_norm")).alias("a"))
    right = targets.where(F.length("name_norm") > 0).select("name_norm", "source", F.col("entity_id").alias("target_id"), text.token_set(F.col("address_norm")).alias("b"))
    pairs = left.join(right, "name_norm")
    return pairs.select("s1_id", "target_id", "source", ((F.size("a") > 0) & (F.size("b") > 0)).alias("both"), text.set_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def zero_match_risk(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """How exposed entities without a match are to equal names and to equal names without separators."""
    zero = s1.join(truth.where("n_true = 0").select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    count = lambda f: targets.where(F.length(f) > 0).groupBy(f).agg(F.count("*").alias(f"n_{f}"))
    by_entity = zero.join(count("name_norm"), "name_norm", "left").join(count("name_key"), "name_key", "left").fillna(0, ["n_name_norm", "n_name_key"])
    one = by_entity.agg(
        F.count("*").alias("n_zero_match_entities"),
        F.count_if(F.col("n_name_norm") > 0).alias("n_exact_name_norm"),
        F.count_if(F.col("n_name_key") > F.col("n_name_norm")).alias("n_name_key_only"),
        F.count_if(F.col("n_name_key") == 0).alias("n_no_candidate"),
        F.coalesce(F.sum("n_name_norm"), F.lit(0)).alias("n_candidate_pairs"),
        F.coalesce(F.max("n_name_norm"), F.lit(0)).alias("max_candidates"),
    )
    pairs = zero_match_pairs(s1, targets, truth)
    best = pairs.where("both").groupBy("s1_id").agg(F.max("jaccard").alias("best")).agg(F.count_if(F.col("best") >= 0.5).alias("n_with_address_support"))
    two = pairs.agg(F.count_if("both").alias("n_both_addresses"), F.count_if(F.col("both") & (F.col("jaccard") == 0)).alias("n_zero_overlap"), F.count_if(~F.col("both")).alias("n_address_missing"))
    return one.join(two).join(best)


def zero_match_histogram(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    return zero_match_pairs(s1, targets, truth).where("both").groupBy(jaccard_bucket(F.col("jaccard")).alias("bucket")).agg(F.count("*").alias("n_pairs"))


def zero_match_top(s1: DataFrame, targets: DataFrame, truth: DataFrame, n: int = 25) -> DataFrame:
    return zero_match_pairs(s1, targets, truth).groupBy("s1_id").agg(F.count("*").alias("n_candidates")).orderBy(F.desc("n_candidates"), "s1_id").limit(n)


def profile(records: DataFrame) -> DataFrame:
    """By source: rows, distinct ids and names, blank fields."""
    return records.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_ids"), F.count_distinct("name_norm").alias("n_names"), F.count_if(F.col("name_norm") == "").alias("n_blank_names"), F.count_if(F.col("address_norm") == "").alias("n_blank_addresses"))


def match_distribution(truth: DataFrame) -> DataFrame:
    return truth.agg(F.count("*").alias("n_entities"), F.sum("n_true").alias("n_pairs"), F.count_if(F.col("n_true") == 0).alias("n_zero_match"), *distribution(F.col("n_true"), "matches"))
