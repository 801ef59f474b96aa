import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import impact_search, language_id, mixing, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(make):
    rng = random.Random(1)
    en, de = (lambda: " ".join(rng.choice(["the", "and", "this", "with", "thing"]) for _ in range(30))), (lambda: " ".join(rng.choice(["der", "und", "nicht", "schön", "größe"]) for _ in range(30)))
    texts = [en() for _ in range(40)] + [de() for _ in range(40)] + [None, "", "123 !?", "x" * 5, en() + " " + en() + " " + de(), "的 中文"]
    langs = ["en"] * 40 + ["de"] * 40 + [None, "en", "de", None, None, None]
    docs = make(texts, langs=langs)
    got = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(80))
    assert [got[i].lang_pred for i in (80, 81, 82)] == ["und"] * 3 and got[80].score == 0
    assert got[84].lang_pred == "en" and 0.55 < got[84].score < 0.8
    assert got[85].lang_pred in ("en", "de")
    assert {r.doc_id for r in language_id.keep_identified(docs).collect()} >= set(range(80)) and language_id.keep_identified(docs).where("doc_id BETWEEN 80 AND 82").count() == 0
    nothing = make(["the and", None], langs=[None, None])
    assert {r.lang_pred for r in language_id.identify_documents(nothing).collect()} == {"und"}
    assert language_id.identify_documents(docs.limit(0)).count() == 0
    assert [r.held_out for r in language_id.identify_documents(make(["a"], ids=[None])).collect()] == [False]


def test_mixture_finds_proportions():
    rng = np.random.default_rng(2)
    logs = np.log(np.array([[0.9, 0.05], [0.05, 0.9]]))
    like = logs[np.repeat([0, 1], [70, 30])] * 5
    best, score = language_id.mixture(like + rng.normal(0, 0.01, like.shape), np.array([0]))
    assert best[0] == 0 and score[0] == pytest.approx(0.7, abs=0.02)
    best, score = language_id.mixture(logs[np.zeros(50, int)], np.array([0]))
    assert (best[0], score[0]) == (0, 1.0), "one language is enough where a second gains too little"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert got.where("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0
    rows = got.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8 and hit / max(1, sum(r.predicted for r in rows)) > 0.85


def test_toxicity_edges(spark, make):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" nasty vile" if i % 6 == 0 else "") for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 600, 2)] + [(None, 1), (3, None), (6, 1), (6, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(make(texts), labels).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert got[600].predicted == got[601].predicted == 0
    again = {r.doc_id: r.score for r in toxicity.score_documents(make(texts).repartition(7), labels.repartition(3)).collect()}
    assert again == {i: r.score for i, r in got.items()}, "reruns agree whatever the partitions"
    nothing = toxicity.score_documents(make(["a", None], ids=[None, 1]), labels.limit(0)).collect()
    assert [r.predicted for r in nothing] == [0, 0] and not nothing[0].held_out
    assert toxicity.score_documents(make(["a"]).limit(0), labels).count() == 0


def test_nnpu_threshold_is_the_best_of_the_corrected_risk():
    f = np.array([5.0, 4.0, 3.0, 5.0, 4.0, 0.2, 0.1, 0.0, 0.0, 0.0])
    positive = np.array([True] * 3 + [False] * 7)
    assert toxicity.threshold(f, positive, 2 / 7) == pytest.approx(1.6)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] >= 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(make, spark):
    rng = random.Random(6)
    sources = [rng.choice(["a", "b", "B", "é", "", None, "hot", "hot", "hot"]) for _ in range(900)]
    texts = [rng.choice([None, "", " \n"]) if rng.random() < 0.05 else " ".join("x" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))) for _ in sources]
    docs = make(texts, sources=sources)
    got = mixing.mix_table(docs).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix_table(docs.repartition(9)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    positions = [r.first_position for r in got if r.first_position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in got if r.copies}


def test_buckets_do_not_change_the_mix(make, monkeypatch):
    docs = make([" ".join(["w"] * (i % 17)) for i in range(300)])
    one = sorted(map(repr, mixing.mix_table(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted(map(repr, mixing.mix_table(docs).collect())) == one


def test_positions_invert_the_demand(spark):
    schedule = F.array(*[F.lit(x) for x in (1.5, 1.0, 0.5)])
    at = lambda x: spark.range(1).select(mixing.position(F.lit(x), F.lit(90.0), schedule, 3).alias("t")).first().t
    assert [at(x) for x in (0, 45, 75, 90, 120)] == pytest.approx([0, 1 / 3, 2 / 3, 1, 1])
    none = F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0)])
    assert spark.range(1).select(mixing.position(F.lit(45), F.lit(90.0), none, 3).alias("t")).first().t == pytest.approx(0.5)


def test_mix_edges(make):
    assert mixing.mix_table(make(["x"]).limit(0)).count() == 0 and mixing.mix_documents(make(["x"]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_table(make([None, ""])).collect()] == [0, 0]
    assert len(mixing.mix_table(make(["a b"] * 3, ids=[1, 1, None])).collect()) == 3


def plain_search(vectors, k, every):
    fine = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i in sorted(fine):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(fine[i], v)), j) for j, v in fine.items() if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return out


def search(spark, vectors, k=5, every=50, kind="float"):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], f"vec_id long, embedding array<{kind}>, label int, block string")
    return [tuple(r) for r in impact_search.top_k(df, k, every).orderBy("query_id", "rank").collect()]


def test_search(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(0, 0.3, (700, 16)), 2).astype(np.float32))]
    rows[20] = (20, rows[3][1])
    rows += [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (950, [float("inf")] * 16), (None, [0.0] * 16), (1000, []), (1050, [0.5])]
    assert search(spark, rows) == plain_search(rows, 5, 50)
    assert search(spark, [(0, [1.0]), (1, [1.0]), (2, [1.0])]) == [(0, 1, 1, 65536), (0, 2, 2, 65536)], "ties to the smaller id; all, if fewer"
    assert search(spark, [(0, [1.0])]) == [] and search(spark, [(1, [1.0])]) == []
    assert search(spark, [(0, [1.0]), (0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 131072)], "rows that repeat count once"


def test_search_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 8)))]
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", 90)
    monkeypatch.setattr(impact_search, "BATCH_ROWS", 10)
    assert search(spark, rows, 3, 5, "double") == plain_search(rows, 3, 5)


def test_search_is_exact_beyond_doubles(spark):
    rows = [(0, [1e6 + 0.25, 1e6]), (1, [1e6, 1e6 + 0.125]), (2, [1e6 + 0.004, 1e6 + 0.125]), (3, [-1e6, 3.0])]
    assert search(spark, rows, 5, 50, "double") == plain_search(rows, 5, 50)
    with pytest.raises(Exception, match="OverflowError|overflow|too large|int"):
        search(spark, [(0, [1e12]), (1, [1e12])], 5, 50, "double")


def test_mix_is_the_same_for_many_sources(make, monkeypatch):
    """Sources that don't fit a broadcast meet their documents in a join that splits hot ones."""
    texts = [f"w{i} " * (i % 7) for i in range(300)]
    docs = make(texts, sources=["hot" if i % 3 else (None if i % 5 == 0 else f"s{i}") for i in range(300)])
    once = sorted(map(str, mixing.mix_table(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 1)
    assert sorted(map(str, mixing.mix_table(docs).collect())) == once
