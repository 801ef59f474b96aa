import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import bpe_codec, jvm_functions, token_count, token_files


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_counts_equal_the_library(make, texts, library):
    got = {r.doc_id: r for r in token_count.count_tokens(make(texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), t


def test_merging_equals_the_library_on_random_pieces(library):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        merger = token_count.Merger(f.read())
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aeinorst thé\n\t 12'.,") for _ in range(rng.randint(0, 60)))
        assert merger.count(text) == len(library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids), repr(text)


def test_memory_of_counts_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_count, "REMEMBERED", 10)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        merger = token_count.Merger(f.read())
    for i in range(50):
        merger.count(f"word{i} other{i} {i}")
    assert len(merger.chunks) <= 12 and len(merger.pieces) <= 11


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_count.Merger(f.read())


def test_codec_equals_the_library(make, texts, library):
    tokenizer = library["word_bpe_49k.json"]
    coded = bpe_codec.encode_decode(make(texts)).cache()
    got, digests = {r.doc_id: r for r in coded.collect()}, {r.doc_id: r for r in bpe_codec.digests(coded).collect()}
    decoded = {r.doc_id: r.decoded for r in bpe_codec.decode(coded).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, t
        assert got[i].decoded == decoded[i] == tokenizer.decode(ids, skip_special_tokens=False)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digests[i].n_tokens == len(ids)


def test_codec_rows(make):
    got = bpe_codec.encode_decode(make(["b a", None, "b a"], ids=[1, None, 1])).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 0), (1, 2), (1, 2)]
    assert bpe_codec.encode_decode(make(["x"]).limit(0)).count() == 0


def coded(spark, parts, width=4):
    """Each of ``parts``, arrays of ids, as the coder's bytes."""
    rows = spark.createDataFrame([(i, np.asarray(p).astype(f"<u{width}").tobytes()) for i, p in enumerate(parts)], "i int, raw binary").coalesce(1)
    found = rows.select("i", jvm_functions.encode_blocks(spark, F.col("raw"), width).alias("data")).collect()
    return [bytes(r.data) for r in sorted(found)]


def decoded(spark, codes, width=4):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, data binary").coalesce(1)
    found = rows.select("i", jvm_functions.decode_blocks(spark, F.col("data"), F.lit(width)).alias("raw")).collect()
    return [np.frombuffer(bytes(r.raw), f"<u{width}") for r in sorted(found)]


def test_coder_round_trip(spark):
    parts = []
    for n, top in [(0, 0), (1, 0), (5, 3), (4096, 50256), (9000, 1), (3000, (1 << 28) - 1), (3000, 1 << 16), (200_000, 300_000), ((1 << 20) + 5, 9)]:
        rng = np.random.default_rng(n + top)
        ids = rng.integers(0, top + 1, n)
        ids[::7] = ids[0] if n else 0
        parts.append(ids)
    parts.append(np.full(100_000, 7))  # a code of few bits
    parts.append(np.concatenate([np.zeros(70_000, int), np.arange(70_000), np.zeros(70_000, int)]))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(parts, decoded(spark, coded(spark, parts))))
    small = [p for p in parts if p.max(initial=0) < 1 << 16]
    assert all((a == b).all() for a, b in zip(small, decoded(spark, coded(spark, small, 2), 2)))


def test_orders_predict_ids(spark):
    rng = np.random.default_rng(5)
    common = rng.zipf(1.3, 60_000) % 5000  # only order 0 helps
    again = np.tile(rng.integers(0, 50_000, 500), 100)  # the last id tells the next
    turn = np.array([0, 1])[rng.integers(0, 2, 40_000)]
    pairs = np.array([0, 1])
    steps = [0, 0]
    for t in turn[:20_000]:
        steps.append(int(pairs[t]) if rng.random() < 0.02 else (steps[-1] ^ steps[-2]))  # only the last two tell the next
    fresh = rng.integers(0, 50_000, 60_000)
    sizes = [len(c) * 8 / len(p) for c, p in zip(coded(spark, [common, again, steps, fresh]), [common, again, steps, fresh])]
    p = np.bincount(common) / len(common)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert sizes[0] < entropy * 1.1 + 0.3 and sizes[1] < 1 and sizes[2] < 0.4 and sizes[3] < 20


def test_code_is_smaller_than_zstd_on_text(spark, library):
    ids = []
    rng = random.Random(11)
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    for _ in range(400):
        text = " ".join(words[min(int(rng.paretovariate(0.7)), 3000) - 1] for _ in range(200))
        ids += library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids
    raw = np.array(ids, "<u2")
    assert len(coded(spark, [raw], 2)[0]) < 0.95 * len(zstandard.compress(raw.tobytes(), 3))


def test_damage_is_found_and_stays_in_its_block(spark):
    rng = np.random.default_rng(1)
    data = bytearray(coded(spark, [rng.integers(0, 50000, (2 << 20) + 9)])[0])
    data[-5] ^= 1
    with pytest.raises(Exception, match="block 2 is damaged"):
        decoded(spark, [bytes(data)])
    index = bytearray(token_files.pack_index([3, None, 9], np.array([5, 0, 1 << 33])))
    doc_ids, lengths = token_files.read_index(bytes(index))
    assert doc_ids == [3, None, 9] and lengths.tolist() == [5, 0, 1 << 33]
    index[-1] ^= 1
    with pytest.raises(ValueError, match="index is damaged"):
        token_files.read_index(bytes(index))


def test_pairs_equal_the_library_on_random_texts(spark, library):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    rng = random.Random(9)
    letters = "aeinorst thé\n\t 12'.,ßжλ日本か한é…“”²½'st'llre<|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + ["ab" * 5000, " " * 3000 + "x", "a'" * 900, "\x0b\u00a0", "é" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", jvm_functions.byte_pairs(spark, F.col("t"), spec).alias("c")).collect()
    left = 0
    for i, c in found:
        if c[0]:
            left += 1
            assert bytes(c[1:]).decode() == texts[i]
        else:
            assert np.frombuffer(bytes(c[1:]), "<u2").tolist() == library["byte_bpe_50k.json"].encode(texts[i], add_special_tokens=False).ids, texts[i]
    assert 0 < left < 300


def test_other_tokenizers_go_through_the_library(spark, make, texts, library, tmp_path):
    token_files.write(make(texts), str(tmp_path / "w"), public_tokenizers.path("word_bpe_49k.json"))
    for r in token_files.read(spark, str(tmp_path / "w")).collect():
        assert list(r.ids) == [*library["word_bpe_49k.json"].encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]


def test_one_id_for_all_rows_is_shared_out():
    ids, rng = np.full(8000, 5), np.random.default_rng(2)
    ids[:100], ids[-100:] = 1, 9
    ties = rng.integers(-(2**63), 2**63 - 1, 8000)
    place = token_files.place_of(ids, ties, np.array([5] * 7))
    assert np.bincount(place, minlength=8).max() < 2000
    order = np.lexsort((ties, ids))
    assert (np.diff(place[order]) >= 0).all()


def test_files(spark, make, texts, library, tmp_path):
    docs = make(texts, ids=[(i * 37) % 1000 - 200 for i in range(len(texts))]).repartition(6)
    token_files.write(docs, str(tmp_path / "t"))
    got = {r.doc_id: r for r in token_files.summary(spark, str(tmp_path / "t")).collect()}
    ids_of = {r.doc_id: list(r.ids) for r in token_files.read(spark, str(tmp_path / "t")).collect()}
    at = 0
    for doc_id, t in sorted(((i * 37) % 1000 - 200, t) for i, t in enumerate(t or "" for t in texts)):
        ids = [*library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, 2]
        assert ids_of[doc_id] == ids
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_rows(make):
    got = sorted(token_files.round_trip(make(["b", None, "a b"], ids=[1, None, 1])).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1] and [r.start for r in got] == [0, 1, 1 + got[1].n_tokens]
    assert token_files.round_trip(make(["x"]).limit(0)).count() == 0


def test_segments_are_bounded(spark, make, texts, tmp_path, monkeypatch):
    token_files.write(make(texts), str(tmp_path / "one"))
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 100)
    token_files.write(make(texts).repartition(3), str(tmp_path / "many"))
    parts = spark.read.parquet(str(tmp_path / "many"))
    assert parts.where("n_ids > 100 and n_docs > 1").count() == 0 and parts.count() > 20
    assert sorted(token_files.summary(spark, str(tmp_path / "one")).collect()) == sorted(token_files.summary(spark, str(tmp_path / "many")).collect())


def test_files_of_equal_and_odd_ids(spark, make, tmp_path):
    many = make([f"w{i} x" for i in range(300)], ids=[None if i % 3 == 0 else 4 for i in range(300)]).repartition(5)
    token_files.write(many, str(tmp_path / "t"))
    rows = sorted(token_files.summary(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 100 + [4] * 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    text_ids = spark.createDataFrame([("7", "a"), ("x", "b"), (None, "c"), ("-3", None)], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in token_files.round_trip(text_ids).collect()) == ["-3", "7", "None", "None"]
