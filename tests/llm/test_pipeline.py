"""The pipeline against plain Python, and the queries of the subpackage against their SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers import rows_of, sql_rows
from test_near import plain_kept
from tokenizers import Tokenizer

import corpus_pipeline
from recordloom.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    columns, expected = sql_rows(SMALL, SQL[name])
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts, stages = docs.columns, {}, {}
    for r in docs.collect():
        texts[r.doc_id] = r.text or ""
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages[name] = docs
        assert name == "tokens" or docs.columns == columns
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in stages.items()}

    assert len(ids["language"]) >= 0.99 * len(texts), "clean documents stay"
    groups = defaultdict(list)
    for i in ids["language"]:
        groups[texts[i].lower() if texts[i].isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])].append(i)
    assert sorted(ids["exact"]) == sorted(map(max, groups.values()))

    exact = sorted(ids["exact"])
    kept = plain_kept([re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]) for i in exact])
    assert sorted(ids["near"]) == [exact[i] for i in sorted(kept)]

    assert set(ids["mix"]) <= set(ids["near"]) and max(Counter(ids["mix"]).values()) <= 2
    words = {i: len(texts[i].encode().split()) for i in ids["near"]}
    assert sum(words[i] for i in ids["mix"]) == pytest.approx(1.5 * sum(words.values()), rel=0.1)

    assert Counter(ids["tokens"]) == Counter(ids["mix"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["tokens"].collect():
        coded = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, coded)).encode()).hexdigest()
    assert rows_of(corpus_pipeline.run(spark, SMALL)) == rows_of(stages["tokens"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows(spark, make, texts, name, stage):
    docs = make([*texts, None, "", texts[20]], ids=[*range(len(texts)), None, None, 20])
    got = stage(spark, docs, SMALL)
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    if name != "tokens":
        assert got.columns == docs.columns
        known = {str(r) for r in docs.collect()}
        assert all(str(r) in known for r in got.collect())
    else:
        assert got.count() == docs.count()
