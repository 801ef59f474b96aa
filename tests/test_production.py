"""Registered queries run on the job's settings."""

from recordloom.config import LinkConfig
from recordloom.operators import features, matcher
from recordloom.plans import errors, queries
from recordloom.sources.tables import corpus

SMALL = "/root/testdata/sf0.001"


def test_diagnosis_covers_all_candidates(spark):
    rows = queries.QUERIES["pair_diagnosis"](spark, SMALL).collect()
    candidates = queries.QUERIES["union_provenance"](spark, SMALL).collect()
    assert {(r.s1_id, r.target_id) for r in rows} == {(r.s1_id, r.target_id) for r in candidates}


def test_reachability_goes_by_the_cap_of_the_job(spark):
    reached = sum(r.n_entities for r in queries.QUERIES["reachability"](spark, SMALL).collect() if r.by_token)
    [at] = [r.n_reached for r in queries.QUERIES["census_by_cap"](spark, SMALL).collect() if r.cap == queries.TOKEN.df_cap]
    assert reached == at


def test_settings_are_those_of_the_job():
    config = LinkConfig()
    assert (queries.TOKEN, queries.CHAR, queries.AT) == (config.token, config.char, config.recall_at)


def test_missed_pairs_are_those_of_the_union(spark, monkeypatch):
    seen = []
    made = errors.missed_pairs
    monkeypatch.setattr(errors, "missed_pairs", lambda pairs, candidates: seen.append(candidates) or made(pairs, candidates))
    queries.QUERIES["cause_table"](spark, SMALL)
    whole = queries._candidates(corpus(spark, SMALL))
    assert seen[0].columns == whole.columns and seen[0].count() == whole.count()


def test_matcher_has_the_features_and_folds_of_the_job(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(matcher, "out_of_fold", lambda rows, names, k, settings: seen.append((rows, names, k, settings)) or (rows.withColumn("score", rows.label), []))
    queries.QUERIES["gbt_oof"](spark, SMALL)
    [(rows, names, k, settings)] = seen
    assert names == list(features.TYPES) and set(names) <= set(rows.columns) and k == LinkConfig().folds
    assert (settings.depth, settings.rate) == (matcher.TreeSettings().depth, matcher.TreeSettings().rate)
