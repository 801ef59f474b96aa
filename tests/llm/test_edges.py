"""Odd rows: very long texts, ids that repeat with other values, wide vectors, clashing columns, empty tables."""

import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordloom.llm import bpe_codec, impact_search, language_id, substring_dedup, token_count, token_files, toxicity


def test_a_piece_of_a_megabyte_is_no_trap():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        merger = token_count.Merger(f.read())
    began = time.perf_counter()
    n = merger.count("ab" * 500_000)
    assert time.perf_counter() - began < 60
    small = len(Tokenizer.from_file(path).encode("ab" * 20_000, add_special_tokens=False).ids)
    assert n == pytest.approx(small * 25, rel=0.01)


def test_very_long_texts_everywhere(make):
    long_ = " ".join(f"word{i % 977} thé" for i in range(150_000))
    texts = [long_, "short", None, long_ + " end"]
    docs = make(texts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = len(library.encode(long_, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs).collect()}[0] == ids
    assert {r.doc_id: r.n_tokens for r in token_files.round_trip(docs).collect()}[0] == ids + 1
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in bpe_codec.digests(bpe_codec.encode_decode(docs)).collect()}[0] == len(words.encode(long_, add_special_tokens=False).ids)
    spans = {r.doc_id: r for r in substring_dedup.repeated_spans(docs).collect()}
    assert (spans[0].n_words, spans[0].n_removed, spans[3].n_removed, spans[1].n_removed) == (300_000, 300_000, 300_000, 0)
    assert {r.doc_id: r.lang_pred for r in language_id.identify_documents(docs).collect()}[3] == "en"


def test_blank_documents_are_bounded_by_number(make, monkeypatch):
    from recordloom.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_DOCS", 7)
    packed = blocks.pack(make([None, "", " "] * 20).coalesce(1), "blank")
    assert packed.count() == 9 and max(len(r.doc_ids) for r in packed.collect()) == 7


def test_rows_that_share_an_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (3, [0.0, 0.0])]
    got = impact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 50).collect()
    ranked = sorted((r["rank"], r.vec_id, r.score) for r in got)
    assert ranked == [(1, 1, 2 * 65536), (1, 2, 3 * 65536), (2, 1, 65536), (2, 2, 65536)]


@pytest.mark.parametrize("dense", [1, 32, 1 << 30])
def test_sparse_and_dense_segments_agree(spark, monkeypatch, dense):
    monkeypatch.setattr(impact_search, "DENSE", dense)
    monkeypatch.setattr(impact_search, "CELLS", 4096)
    rng = np.random.default_rng(2)
    vectors = np.where(rng.random((150, 300)) < 0.1, rng.normal(size=(150, 300)), 0.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * vectors).astype(np.int64)
    scores = whole @ whole.T
    for r in impact_search.top_k(df, 3, 10).collect():
        order = sorted((i for i in range(150) if i != r.query_id), key=lambda i: (-scores[r.query_id, i], i))
        assert (r.vec_id, r.score) == (order[r["rank"] - 1], scores[r.query_id, order[r["rank"] - 1]])


def test_labels_with_other_columns(spark, make):
    docs = make([f"bad{i % 3} word text" if i % 4 == 0 else f"fine calm text {i}" for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x", 5, None) for i in range(0, 200, 2)] + [(None, 1, "y", 1, None), (3, None, "z", 1, None)], "doc_id long, toxic int, text string, positive int, words string")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.score for r in got if r.doc_id % 4 == 0]) > np.mean([r.score for r in got if r.doc_id % 4])


def test_too_many_languages_are_refused(make):
    docs = make([f"text {i}" for i in range(500)], langs=[f"l{i}" for i in range(500)])
    with pytest.raises(ValueError, match="languages"):
        language_id.identify_documents(docs).collect()
