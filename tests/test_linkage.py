"""The linkage operators against plain Python on corpora made up at random."""

import random
from collections import Counter, defaultdict
from itertools import combinations, product

import pytest
from helpers import records, rows_of, truth_of
from pyspark.sql import functions as F

from recordloom.config import KeyConfig, LinkConfig
from recordloom.functions import similarity
from recordloom.functions.ids import stable_hash
from recordloom.functions.normalize import normalize_text
from recordloom.functions.text import BLOCKERS, LEGAL_TOKENS
from recordloom.operators import blocking, evaluate, features, keys, matcher, ordered
from recordloom.plans import calibrate, errors, names, statistics

PARTS = ["ka", "lo", "mir", "ten", "su", "va", "dor", "pel", "ni", "go"]


def made_up(seed, n=45):
    """Records of three sources with shared, joined, shortened, misspelt, legal and blank names, and true pairs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(PARTS, k=rng.randint(1, 3)))
    words = [word() for _ in range(40)]
    street = lambda: " ".join(rng.choices(words, k=rng.randint(0, 4)))
    s1, targets, true = [], [], []
    for i in range(n):
        name, address = " ".join(rng.choices(words, k=rng.randint(0 if i % 9 == 0 else 1, 4))), street()
        s1.append((f"S1-{i}", name, address, rng.choice(["aa", "bb", ""])))
        for s in (2, 3):
            kind = rng.randint(0, 9)
            tokens = name.split()
            other = {0: name, 1: name.replace(" ", ""), 2: " ".join(tokens[:-1]), 3: f"{name} {rng.choice(LEGAL_TOKENS[:6])}", 4: " ".join(reversed(tokens)), 5: name[:-1] + "x", 6: street(), 7: name.upper() + "!"}.get(kind)
            if other is None:
                continue
            targets.append((f"S{s}-{i}", other, address if rng.random() < 0.6 else street(), rng.choice(["aa", "bb", ""])))
            if rng.random() < 0.8:
                true.append((f"S1-{i}", f"S{s}-{i}"))
    targets += [(f"S2-{n + j}", rng.choice(targets)[1], street(), "") for j in range(8)]
    return s1, targets, true


def clean(rows):
    return {r[0]: normalize_text(r[1]) for r in rows}


def trigrams(text, n=3):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def gram_jaccard(a, b):
    n = 1 if min(len(a), len(b)) < 3 else 3
    return jaccard(trigrams(a, n), trigrams(b, n))


def plain_keys(kind, name):
    return list(dict.fromkeys(name.split())) if kind == "token" else sorted(trigrams(name.replace(" ", "")))


def plain_shared(kind, s1, targets, cap, k):
    """{(s1, target): least frequency of a shared key among both sides' rarest}."""
    out = {}
    for source in "23":
        own = {i: plain_keys(kind, n) for i, n in targets.items() if i[1] == source}
        df = Counter(x for ks in own.values() for x in ks)
        # ties: tokens by first occurrence among the source's records in order, trigrams by code points
        first = {}
        for ks in own.values():
            for x in ks:
                first.setdefault(x, len(first))
        order = (lambda x: (df[x], first[x])) if kind == "token" else (lambda x: (df[x], x))
        rarest = lambda ks: sorted((x for x in ks if 0 < df[x] <= cap), key=order)[:k]
        index = defaultdict(list)
        for i, ks in own.items():
            for x in rarest(ks):
                index[x].append(i)
        for a, name in s1.items():
            for x in rarest(plain_keys(kind, name)):
                for b in index[x]:
                    out[a, b] = min(out.get((a, b), df[x]), df[x])
    return out


def plain_suffix(name):
    kept = [t for t in name.split() if t not in LEGAL_TOKENS] or name.split()
    return " ".join(sorted(set(kept)))


def plain_candidates(s1, targets, token=(1000, 1), char=(1000, 5, 0.3)):
    """{(s1, target): (blockers, token_df, char_jaccard)}."""
    found = defaultdict(lambda: [set(), None, None])
    for (a, x), (b, y) in product(s1.items(), targets.items()):
        if x and x == y:
            found[a, b][0].add("exact_name")
        if plain_suffix(x) and plain_suffix(x) == plain_suffix(y):
            found[a, b][0].add("suffix_stripped")
    for pair, df in plain_shared("token", s1, targets, *token).items():
        found[pair][0].add("token")
        found[pair][1] = float(df)
    for a, b in plain_shared("char", s1, targets, *char[:2]):
        j = jaccard(trigrams(s1[a].replace(" ", "")), trigrams(targets[b].replace(" ", "")))
        if j >= char[2]:
            found[a, b][0].add("char_ngram")
            found[a, b][2] = round(j, 9)
    return {p: ([f"source{p[1][1]}:{k}" for k in BLOCKERS if k in v[0]], v[1], v[2]) for p, v in found.items()}


def collected(df):
    return {(r.s1_id, r.target_id): (list(r.blockers), r.token_df, None if r.char_jaccard is None else round(r.char_jaccard, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def world(spark):
    s1, targets, true = made_up(1)
    pairs, truth = truth_of(spark, [r[0] for r in s1], true)
    a, b = records(spark, s1).cache(), records(spark, targets).cache()
    return {"raw": (s1, targets, true), "s1": a, "targets": b, "pairs": pairs, "truth": truth, "stats": statistics.pair_statistics(pairs, a, b).cache()}


@pytest.mark.parametrize("seed, token, char", [(1, (1000, 1), (1000, 5, 0.3)), (2, (3, 2), (6, 3, 0.5)), (3, (1, 1), (2, 1, 0.3))])
def test_candidates_equal_plain(spark, seed, token, char):
    s1, targets, _ = made_up(seed)
    config = LinkConfig(blockers=BLOCKERS, token=KeyConfig(*token), char=KeyConfig(*char))
    got = collected(blocking.candidates(records(spark, s1), records(spark, targets), config))
    expected = plain_candidates(clean(s1), clean(targets), token, char)
    assert got == expected
    if seed == 1:
        sets = {k: {p for p, v in expected.items() if any(x.endswith(k) for x in v[0])} for k in BLOCKERS}
        assert all(sets[a] != sets[b] for a, b in combinations(BLOCKERS, 2)), "the corpus tells the blockers apart"


def test_exact_key_and_suffix_differ(spark, world):
    found = [frozenset((r.s1_id, r.target_id) for r in df.collect()) for df in (blocking.block_exact(world["s1"], world["targets"]), blocking.block_exact(world["s1"], world["targets"], "name_key"), blocking.block_suffix(world["s1"], world["targets"]))]
    assert len(set(found)) == 3 and found[0] < found[1] and found[0] < found[2]


def test_result_does_not_depend_on_partitions(spark, world):
    once = collected(blocking.candidates(world["s1"], world["targets"]))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = collected(blocking.candidates(world["s1"].repartition(3), world["targets"].repartition(7)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == once


def test_keys_over_the_cap_go_before_the_join(spark):
    rows = records(spark, [(f"S2-{i}", f"every rare{i}") for i in range(6)])
    made = keys.postings(rows, "token", KeyConfig(3, 2))
    assert {r.key for r in made.collect()} == {f"rare{i}" for i in range(6)}
    wide = keys.MOST_OVER
    try:
        keys.MOST_OVER = 0  # too many to broadcast: the cap is applied by the join alone
        assert rows_of(keys.postings(rows, "token", KeyConfig(3, 2))) == rows_of(made)
    finally:
        keys.MOST_OVER = wide


def test_no_products_in_plans(spark, world):
    blocking.assert_no_product(blocking.candidates(world["s1"], world["targets"]))
    a = spark.range(5)
    with pytest.raises(ValueError):
        blocking.assert_no_product(a.crossJoin(a.toDF("b")))


def test_unknown_blocker(world):
    with pytest.raises(ValueError, match="vector"):
        blocking.candidates(world["s1"], world["targets"], LinkConfig(blockers=("vector",)))


def test_cap_takes_source_then_number(spark):
    rows = spark.createDataFrame([("S1-8", f"S{s}-{n}", s) for s, n in ((3, 4), (2, 200), (2, 31), (3, 5))], "s1_id string, target_id string, source int")
    assert {r.target_id for r in blocking.cap_per_entity(rows, 3).collect()} == {"S2-31", "S2-200", "S3-4"}


def test_equally_rare_tokens_go_by_first_occurrence(spark):
    rows = records(spark, [("S2-5", "zinc apple"), ("S2-6", "mango")])
    assert [r.key for r in keys.postings(rows, "token", KeyConfig(9, 1)).orderBy("entity_id").collect()] == ["zinc", "mango"]


def test_blank_names_have_no_keys(spark):
    s1, t = records(spark, [("S1-1", " ")]), records(spark, [("S2-1", "..."), ("S2-2", "x")])
    assert blocking.candidates(s1, t, LinkConfig(blockers=BLOCKERS)).count() == 0


def plain_statistics(world):
    """For each true pair: exact, least frequency of a shared token over both sources, trigram and address overlaps."""
    s1, targets, true = world["raw"]
    n1, n2 = clean(s1), clean(targets)
    address = {r[0]: set(normalize_text(r[2]).split()) for r in s1 + targets}
    df = Counter(x for n in n2.values() for x in set(n.split()))
    out = {}
    for a, b in true:
        shared = set(n1[a].split()) & set(n2[b].split())
        x, y = address[a], address[b]
        out[a, b] = (n1[a] == n2[b], min((df[t] for t in shared), default=0), gram_jaccard(n1[a].replace(" ", ""), n2[b].replace(" ", "")), len(x & y), jaccard(x, y) if x and y else None)
    return out


def test_signals_equal_plain(world):
    plain = plain_statistics(world)
    flags = {p: (e, 0 < df <= 1000, c >= 0.5, j is not None and j >= 0.5) for p, (e, df, c, _, j) in plain.items()}
    signals = statistics.signal_columns(world["stats"])
    got = {r.signal: (r.n_pairs, r.n_entities) for r in statistics.signal_coverage(signals).collect()}
    want = {n: [p for p, f in flags.items() if f[i]] for i, n in enumerate(("exact", "token", "char", "address"))}
    want |= {"any": [p for p, f in flags.items() if any(f)], "none": [p for p, f in flags.items() if not any(f)]}
    assert got == {n: (len(ps), len({a for a, _ in ps})) for n, ps in want.items()}
    label = lambda f: "+".join(n for n, x in zip(("exact", "token", "char", "address"), f) if x) or "none"
    assert {r.signals: r.n_pairs for r in statistics.signal_combinations(signals).collect() if r.n_pairs} == Counter(map(label, flags.values()))
    outcome = defaultdict(list)
    for (a, _), f in flags.items():
        outcome[a].append(any(f))
    assert tuple(statistics.signal_outcomes(signals).first()) == (sum(all(x) for x in outcome.values()), sum(any(x) and not all(x) for x in outcome.values()), sum(not any(x) for x in outcome.values()))
    for r in statistics.signal_grid(world["stats"]).collect():
        value = {"token": lambda s: 0 < s[1] <= r.threshold, "char": lambda s: s[2] >= r.threshold, "address": lambda s: s[4] is not None and s[4] >= r.threshold}[r.signal]
        assert r.n_pairs == sum(map(value, plain.values()))
    assert {r.bucket: r.n for r in statistics.capped_histogram(world["stats"], F.col("addr_shared"), 2).collect()} == Counter(min(s[3], 2) for s in plain.values())


def test_frequencies_and_census_equal_plain(world):
    s1, targets, true = world["raw"]
    by_source = {s: Counter(x for i, n in clean(targets).items() if s in ("all", f"source{i[1]}") for x in set(n.split())) for s in ("source2", "source3", "all")}
    assert {r.scope: (r.n_tokens, r.n_occurrences) for r in statistics.posting_summary(world["targets"]).collect()} == {s: (len(c), c.total()) for s, c in by_source.items()}
    census = statistics.census(world["s1"], world["targets"], world["truth"])
    least = {i: min((by_source["all"][t] for t in set(n.split()) if t in by_source["all"]), default=0) for i, n in clean(s1).items()}
    assert {r.s1_id: r.rarest for r in census.collect()} == least
    assert statistics.census_summary(census).first().n_structural_zero == sum(not x for x in least.values())


def test_zero_match_risk_equals_plain(world):
    s1, targets, true = world["raw"]
    alone = {i: n for i, n in clean(s1).items() if i not in {a for a, _ in true}}
    full, joined = Counter(n for n in clean(targets).values() if n), Counter(n.replace(" ", "") for n in clean(targets).values() if n)
    exact = {i: full[n] if n else 0 for i, n in alone.items()}
    key = {i: joined[n.replace(" ", "")] if n else 0 for i, n in alone.items()}
    got = statistics.zero_match_risk(world["s1"], world["targets"], world["truth"]).first()
    assert (got.n_zero_match_entities, got.n_exact_name_norm, got.n_name_key_only, got.n_no_candidate, got.n_candidate_pairs, got.max_candidates) == (len(alone), sum(x > 0 for x in exact.values()), sum(key[i] > exact[i] for i in alone), sum(not x for x in key.values()), sum(exact.values()), max(exact.values()))


def compared(spark, pairs):
    rows = [(f"S1-{i}", f"S2-{i}", *map(normalize_text, pair)) for i, pair in enumerate(pairs)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, a_name_norm string, b_name_norm string")
    blank = {c: F.lit("") for c in ("a_address_norm", "b_address_norm", "a_country_norm", "b_country_norm")}
    key = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return df.withColumns(blank | {"source": F.lit(2), "a_name_key": key(F.col("a_name_norm")), "b_name_key": key(F.col("b_name_norm"))})


CATEGORIES = [
    ("harbour tea", "Harbour TEA", "exact_normalized_match"),
    ("harbourtea", "harbour tea", "separator_only"),
    ("tea harbour", "harbour tea", "token_word_order"),
    ("harbour", "harbour tea house", "token_subset_superset"),
    ("гавань", "harbour", "transliteration_script"),
    ("harbour teahouse", "harbuor teahouse", "typo_small_edit"),
    ("harbour tea", "harbour coffee", "unknown_other"),
    ("qqqq", "harbour", "substantially_different"),
    ("", "harbour", "unknown_other"),
]
CAUSES = [
    ("", "x", "empty_normalized_name"),
    ("harbour tea", "harbour tea", "DEFECT_identical_name_not_retrieved"),
    ("гавань", "harbour", "cross_script_no_transliteration"),
    ("tea harbour", "harbour tea", "token_reorder_only"),
    ("harbour", "harbour tea", "token_insertion_or_deletion"),
    ("pier ltd", "pier limited", "legal_suffix_variation"),
    ("old tea house", "oth", "abbreviation_initials"),
    ("harbour", "harbourside", "prefix_truncation"),
    ("blue tea", "tea red", "shares_token_but_not_retrieved"),
    ("harbours", "harbourx", "char_overlap_above_threshold_but_not_retrieved"),
    ("lanternfish", "lantxyzwvuq", "char_overlap_below_threshold"),
    ("qqq", "zzz", "no_lexical_overlap"),
]


def test_name_categories(spark):
    got = names.classify(compared(spark, [c[:2] for c in CATEGORIES])).collect()
    assert {r.s1_id: r.category for r in got} == {f"S1-{i}": c[2] for i, c in enumerate(CATEGORIES)}


def test_causes(spark):
    got = errors.diagnose(compared(spark, [c[:2] for c in CAUSES]))
    assert {r.s1_id: r.primary_cause for r in got.collect()} == {f"S1-{i}": c[2] for i, c in enumerate(CAUSES)}
    assert set(errors.MEASURES) | set(errors.FLAGS) | {"name_a_empty", "non_latin_a", "country_both_blank", "address_a_blank"} <= set(got.columns)


def test_error_analysis_equals_plain(spark, world):
    s1, targets, true = world["raw"]
    config = LinkConfig(blockers=BLOCKERS)
    found = blocking.candidates(world["s1"], world["targets"], config).cache()
    plain = plain_candidates(clean(s1), clean(targets))
    missed = set(true) - set(plain)
    assert missed and {(r.s1_id, r.target_id) for r in errors.missed_pairs(world["pairs"], found).collect()} == missed
    masked = errors.masked(found, world["pairs"], world["truth"], BLOCKERS)
    combos = {r.combination: (r.candidate_rows, r.true_pairs) for r in errors.combination_table(masked, BLOCKERS).collect()}
    want = defaultdict(lambda: [0, 0])
    for p, v in plain.items():
        own = want["+".join(x.split(":")[1] for x in v[0])]
        own[0] += 1
        own[1] += p in set(true)
    assert len(combos) == 15 and {c: list(v) for c, v in combos.items() if v[0]} == dict(want)
    table = {r.blocker: r for r in errors.blocker_table(masked, world["pairs"], BLOCKERS).collect()}
    assert table["suffix_stripped"].candidate_rows == sum(any("suffix" in x for x in v[0]) for v in plain.values())
    groups = Counter(r.group for r in errors.contrast(world["pairs"], found).collect())
    assert groups == {"missed": len(missed), "recovered": len(set(true) & set(plain))}
    assert Counter(r.group for r in errors.contrast(world["pairs"], found, 3, 4).collect()) == {"missed": len(missed), "recovered": 4}
    recall, growth = errors.proposal_recall(world["s1"], world["targets"], world["pairs"], world["truth"], found), errors.proposal_growth(world["s1"], world["targets"])
    for r in errors.proposal_value(recall, growth, len(plain)).collect():
        if r.proposal == "token_any":
            a, b = clean(s1), clean(targets)
            share = lambda x, y: set(a[x].split()) & set(b[y].split())
            assert r.true_pairs_recovered == sum(bool(share(x, y)) for x, y in true)
            assert r.candidate_rows == sum(len(share(x, y)) for x in a for y in b)
            assert r.candidate_precision == pytest.approx(r.true_pairs_recovered / r.candidate_rows, abs=1e-6)


def test_worst_tenth_of_entities(spark):
    miss = [9, 5, 5, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 4]
    rows = [(f"S1-{i}", m, 0, 0) for i, m in enumerate(miss)] + [("S1-99", 2, 2, 2)]
    got = errors.entity_accounting(spark.createDataFrame(rows, "s1_id string, n_true long, n_candidates long, n_hits long")).first()
    assert got.missed_pairs_worst_decile_share == pytest.approx(sum(sorted(miss)[-2:]) / sum(miss), abs=1e-6)


def test_recall_at_k(spark):
    listed = {"S1-1": ["S3-8", "S2-7", "S2-12", "S2-101"], "S1-2": ["S2-40", "S3-6"]}
    true = [("S1-1", "S2-12"), ("S1-1", "S3-8"), ("S1-2", "S2-40"), ("S1-3", "S2-9")]
    pairs, truth = truth_of(spark, ["S1-1", "S1-2", "S1-3"], true)
    rows = spark.createDataFrame([(s, t, int(t[1])) for s, ts in listed.items() for t in ts], "s1_id string, target_id string, source int")
    by_entity = evaluate.counters(truth, evaluate.mark_true(rows, pairs), (1, 2, 3, 4))
    # by source and number: S1-1 has 7, 12, 101 of source 2, then 8 of source 3
    assert {r.k: r.hits for r in evaluate.recall_at(by_entity, (1, 2, 3, 4)).collect()} == {1: 1, 2: 2, 3: 2, 4: 3}
    got = {r.s1_id: r for r in evaluate.counters_by_source(truth, evaluate.mark_true(rows, pairs)).collect()}
    assert (got["S1-1"].n_candidates_source2, got["S1-1"].n_hits_source3, got["S1-3"].n_candidates) == (3, 1, 0)
    strange = rows.union(spark.createDataFrame([("S1-77", "S2-1", 2), ("S1-77", "S2-2", 2)], rows.schema))
    assert tuple(evaluate.unknown_rows(truth, strange).first()) == (2, 1)


def test_features(spark):
    s1 = records(spark, [("S1-1", "old quay hotel", "7 mill row leeds", "uk"), ("S1-2", "sole trader")])
    t = records(spark, [("S2-1", "old quay hotel", "7 mill row leeds", "uk"), ("S2-2", "old quay hostel bar", "7 mill row york", "")])
    rows = [("S1-1", "S2-1", 2, ["source2:exact_name", "source2:token"], 5.0, None), ("S1-1", "S2-2", 2, ["source2:char_ngram"], None, 0.4), ("S1-2", "S2-77", 2, ["source2:token"], 8.0, None)]
    candidates = spark.createDataFrame(rows, "s1_id string, target_id string, source int, blockers array<string>, token_df double, char_jaccard double")
    made = features.pair_features(candidates, s1, t)
    got = {r.target_id: r for r in made.collect()}
    a, b, c = got["S2-1"], got["S2-2"], got["S2-77"]
    assert (a.name_norm_equal, a.address_norm_equal, a.country_equal, a.name_token_jaccard, a.address_shared_token_count, a.char_jaccard, a.n_blockers) == (1, 1, 1, 1.0, 4, None, 2)
    assert b.name_token_jaccard == pytest.approx(2 / 5) and b.name_length_ratio == pytest.approx(14 / 19) and b.token_df is None and b.country_missing == 1
    x, y = "old quay hotel", "old quay hostel bar"
    plain = [similarity.token_set_ratio(x, y), similarity.token_sort_ratio(x, y), similarity.partial_ratio(x, y)]
    assert [b.name_token_set_ratio, b.name_token_sort_ratio, b.name_partial_ratio] == pytest.approx(plain)
    assert (c.text_join_ok, c.name_token_jaccard, c.name_norm_equal, c.token_df, c.s1_candidate_count) == (0, None, 0, 8.0, 1)
    assert all(r.holds for r in features.accounting(candidates, made).collect())
    broken = {r.check for r in features.accounting(candidates, made.where("target_id != 'S2-1'")).collect() if not r.holds}
    assert broken == {"rows_are_lossless", "pairs_are_lossless", "candidate_counts_are_whole"}
    assert all(r.holds for r in features.accounting(candidates, made.where("s1_id = 'S1-1'"), sampled=True).collect())
    stats = features.feature_stats(made)
    assert all(r.in_unit_interval == (True if r.feature in features.UNIT else None) for r in stats.collect())
    features.assert_unit(stats)
    with pytest.raises(ValueError, match="name_length_ratio"):
        features.assert_unit(features.feature_stats(made.withColumn("name_length_ratio", F.lit(1.5))))


def scored_world(spark, seed, n=30):
    rng = random.Random(seed)
    ids = [f"S1-{i}" for i in range(n)]
    rows = [(s, f"S2-{j}", rng.choice([0.1, 0.2, 0.35, 0.5, 0.8, 0.95]), int(rng.random() < 0.4)) for s in ids for j in range(rng.randint(0, 5))]
    true = [(s, t) for s, t, _, y in rows if y] + [(s, "S3-99") for s in ids if rng.random() < 0.3]
    _, truth = truth_of(spark, ids, true)
    return ids, truth, spark.createDataFrame(rows, "s1_id string, target_id string, score double, label int")


def test_sweep_equals_direct_evaluation(spark):
    ids, truth, scored = scored_world(spark, 3)
    odd = scored.union(spark.createDataFrame([("S1-3", "S2-70", float("nan"), 0)], scored.schema))
    sweep = matcher.threshold_sweep(odd, truth).collect()
    assert {r.threshold for r in sweep} == {None, 0.1, 0.2, 0.35, 0.5, 0.8, 0.95}, "a missing score is never predicted"
    for r in sweep:
        kept = scored.where(F.col("score").cast("float") >= F.lit(9.0 if r.threshold is None else r.threshold).cast("float")).withColumn("is_true", F.col("label"))
        direct = evaluate.macro_f05(evaluate.counters(truth, kept)).first()
        assert (r.macro_f05_score_zero, r.macro_f05_exclude, r.predicted_rows) == (direct.macro_f05_score_zero, direct.macro_f05_exclude, kept.count())


def plain_point(points, tolerance):
    top = max(p[1] for p in points)
    best = next(i for i, p in enumerate(points) if p[1] == top)
    low = high = best
    while low and points[low - 1][1] >= top - tolerance - 1e-9:
        low -= 1
    while high + 1 < len(points) and points[high + 1][1] >= top - tolerance - 1e-9:
        high += 1
    return points[(low + high) // 2][0], high - low + 1


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_operating_point_equals_plain(spark, seed):
    _, truth, scored = scored_world(spark, seed)
    sweep = matcher.threshold_sweep(scored, truth).cache()
    points = [(r.predicted_rows, r.macro_f05_score_zero) for r in sweep.orderBy("predicted_rows").collect()]
    for tolerance in (0.0, 0.01, 0.2):
        got = matcher.operating_point(sweep, tolerance).first()
        assert (got.chosen_predicted_rows, got.plateau_points) == plain_point(points, tolerance)
    at = [0, 1, 20, 10_000]
    snapped = {r.predicted_rows for r in matcher.snap_to_grid(sweep, at).collect()}
    assert snapped == {min(p for p, _ in points if p >= x) for x in at if any(p >= x for p, _ in points)}
    grid = matcher.snap_to_grid(sweep, [0, points[-1][0]])
    finer = matcher.refined(sweep, grid)
    assert snapped and grid.count() <= finer.count() <= sweep.count()
    assert finer.agg(F.max("macro_f05_score_zero")).first()[0] >= grid.agg(F.max("macro_f05_score_zero")).first()[0]
    chosen = matcher.operating_point(sweep)
    threshold = chosen.first().chosen_threshold
    kept = matcher.decide(scored, threshold).withColumn("is_true", F.col("label"))
    assert matcher.consistent(chosen, evaluate.macro_f05(evaluate.counters(truth, kept))).first().holds


def test_runs_are_compared_at_one_threshold(spark):
    _, truth, scored = scored_world(spark, 6)
    other = scored.withColumn("score", F.col("score") / 2)
    got = {r.run: r for r in matcher.ab_compare({"a": scored, "b": other, "again": scored}, truth, 0.4).collect()}
    assert all(r.holds for r in got.values())
    assert got["again"].delta_score_zero == got["a"].delta_score_zero == 0 and got["again"].n_same_pairs == got["a"].n_rows
    direct = evaluate.macro_f05(evaluate.counters(truth, matcher.decide(other, 0.4).withColumn("is_true", F.col("label")))).first()
    assert got["b"].macro_f05_score_zero == direct.macro_f05_score_zero and got["b"].n_rows < got["a"].n_rows


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(8)
    values = [(i, rng.randint(0, 50)) for i in range(500)]
    rows = spark.createDataFrame(values, "i long, v long").repartition(5)
    got = ordered.numbered(rows, [F.desc("v"), F.col("i")], "n", {"total": F.col("v")}).collect()
    order = sorted(values, key=lambda x: (-x[1], x[0]))
    sums = 0
    by_number = {r.n: r for r in got}
    for n, (i, v) in enumerate(order):
        sums += v
        assert (by_number[n].i, by_number[n].total) == (i, sums)
    assert ordered.numbered(rows.limit(0), [F.col("i")], "n").count() == 0


def test_folds(spark):
    ids, truth, _ = scored_world(spark, 7)
    got = {r.s1_id: r.fold for r in matcher.assign_folds(truth, 3).collect()}
    assert got == {s: stable_hash(s) % 3 for s in ids}
    dealt = [r.fold for r in matcher.assign_folds(truth, 3, "balanced").where("n_true > 0").orderBy(F.desc("n_true"), "s1_id").collect()]
    assert dealt == [[0, 1, 2, 2, 1, 0][i % 6] for i in range(len(dealt))]
    with pytest.raises(ValueError):
        matcher.assign_folds(truth, 1)
    with pytest.raises(ValueError, match="folds"):
        matcher.assign_folds(truth.limit(2), 5)


def test_submission(spark):
    s1 = records(spark, [(f"S1-{i}", "x") for i in (7, 8, 9)])
    rows = [("S1-8", "S3-2", 0.6), ("S1-8", "S2-30", 0.7), ("S1-8", "S2-4", 0.9), ("S1-8", "S2-4", 0.5), ("S1-9", "S2-1", 0.49)]
    scored = spark.createDataFrame(rows, "s1_id string, target_id string, score double")
    selected = matcher.decide(scored, 0.5)
    made = matcher.submission(s1, selected)
    assert [r.matched_entity_ids for r in made.orderBy("row_pos").collect()] == ["", "S2-4,S2-30,S3-2", ""]
    checks = matcher.submission_checks(s1, scored, selected, made).collect()
    assert len(checks) == 9 and all(r.holds for r in checks)
    strange = spark.createDataFrame([("S1-70", "S2-1", 0.9)], scored.schema)
    assert {r.name for r in matcher.submission_checks(s1, scored.union(strange), selected, made).collect() if not r.holds} == {"no_s1_entity_dropped"}
    assert {r.name for r in matcher.submission_checks(s1, scored, selected, made, made.limit(2)).collect() if not r.holds} == {"row_count_matches_the_s1_file"}


def test_grid_cells_equal_direct_runs(world):
    s1, targets, pairs = world["s1"], world["targets"], world["pairs"]
    caps, ks = (1, 3, 50), (1, 2)
    grid = {(r.df_cap, r.rarest_k): r.n_candidates for r in calibrate.token_grid(s1, targets, pairs, caps, ks).collect()}
    bound = calibrate.volume_bound(s1, targets, "token", caps, ks)
    bounds = {(r.df_cap, r.rarest_k): r.bound for r in bound.collect()}
    for cap, k in product(caps, ks):
        direct = blocking.block_token(s1, targets, KeyConfig(cap, k)).count()
        assert grid.get((cap, k), 0) == direct <= bounds[cap, k]
    most = sorted(bounds.values())[2]
    assert calibrate.within_budget(bound, most) == sorted(c for c, b in bounds.items() if b <= most)


@pytest.mark.parametrize("kind", ["token", "char"])
def test_calibration_retrieves_only_what_the_budget_allows(spark, world, kind):
    s1, targets, pairs, truth = (world[x] for x in ("s1", "targets", "pairs", "truth"))
    caps, ks = (2, 40), (1, 3)
    bounds = sorted(r.bound for r in calibrate.volume_bound(s1, targets, kind, caps, ks).collect())
    half = F.when(F.pmod(F.xxhash64("s1_id"), F.lit(2)) == 0, "val").otherwise("train")
    rows = calibrate.calibrated(s1, targets, pairs, truth, kind, half, bounds[1], caps, ks, (0.3, 0.6)).collect()
    assert all(r.evaluated == (r.bound <= bounds[1]) for r in rows)
    assert all(r.candidate_set is None and r.n_candidates is None for r in rows if not r.evaluated)
    every = defaultdict(dict)
    for r in rows:
        if r.evaluated:
            every[r.df_cap, r.rarest_k, r.candidate_set, r.min_jaccard][r.split] = r
    assert every
    for (cap, k, name, j), by in every.items():
        assert by["all"].n_candidates == by["val"].n_candidates + by["train"].n_candidates and by["all"].true_pairs == by["val"].true_pairs + by["train"].true_pairs
        if name == "token":
            assert by["all"].n_candidates == blocking.block_token(s1, targets, KeyConfig(cap, k)).count()
        if name == "char":
            expected = blocking.block_char(s1, targets, KeyConfig(cap, k, j) if kind == "char" else KeyConfig(1000, 5, 0.3)).count()
            assert by["all"].n_candidates == expected
    assert {r.candidate_set for r in rows if r.evaluated} <= {"exact", "token", "char", "token_plus_exact", "exact_plus_char", "exact_char_token", "char_plus_exact"}
    none = calibrate.calibrated(s1, targets, pairs, truth, kind, half, -1, caps, ks).collect()
    assert len(none) == 4 and not any(r.evaluated for r in none)


def test_drop_reasons(spark, world):
    s1, targets, _ = world["raw"]
    n1, n2 = clean(s1), clean(targets)
    for r in calibrate.drop_reasons(world["s1"], world["targets"], "token", KeyConfig(2, 1)).collect():
        df = Counter(x for i, n in n2.items() if i[1] == str(r.source) for x in set(n.split()))
        least = {i: min((df[t] for t in n.split() if t in df), default=None) for i, n in n1.items()}
        want = (len(n1), sum(v is not None and v <= 2 for v in least.values()), sum(not n for n in n1.values()), sum(v is None and bool(n1[i]) for i, v in least.items()), sum(v is not None and v > 2 for v in least.values()))
        assert (r.n_entities, r.n_selected, r.n_no_key, r.n_not_in_targets, r.n_over_cap) == want


def test_unions_never_shrink(world):
    s1, targets = world["s1"], world["targets"]
    one = blocking.candidates(s1, targets, LinkConfig(blockers=("exact_name",)))
    two = blocking.candidates(s1, targets, LinkConfig(blockers=("exact_name", "char_ngram")))
    assert one.join(two, ["s1_id", "target_id"], "left_anti").count() == 0


def test_empty_tables(world):
    s1, targets, pairs, truth = (world[x] for x in ("s1", "targets", "pairs", "truth"))
    none = blocking.candidates(s1.limit(0), targets)
    assert none.count() == 0 and blocking.candidates(s1, targets.limit(0)).count() == 0
    got = evaluate.metrics(evaluate.counters(truth, evaluate.mark_true(none, pairs))).first()
    assert (got.n_s1_with_zero_candidates, got.blocking_recall_pair) == (truth.count(), 0.0)
    assert rows_of(errors.missed_pairs(pairs, none)) == rows_of(pairs)
