"""The near stage against plain Jaccard similarities of five-word shingle sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import shingle_sets, simhash_dedup


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"edit{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_all_pairs_from_similarity_on(make):
    """Copies on both sides of 0.8, most of them near it."""
    rng = random.Random(3)
    texts = [None, "", " ", "one two", "one  two", "a b c d e f"]
    for _ in range(80):
        words = [f"w{rng.randint(0, 50000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        texts += [edited(rng, words, max(1, round(len(words) * part))) for part in (0.015, 0.021, 0.024, 0.03)]
    expected = plain_kept(texts)
    assert 100 < len(expected) < 300
    assert {r.doc_id for r in simhash_dedup.drop_near_duplicates(make(texts)).collect()} == expected


def test_repeated_lines_dont_link_clean_texts(make):
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(10))
    texts = [" ".join([*(f"w{rng.randint(0, 50000)}" for _ in range(200)), *[line] * 25]) for _ in range(30)]
    assert plain_kept(texts) == set(range(30))
    assert {r.doc_id for r in simhash_dedup.drop_near_duplicates(make(texts)).collect()} == set(range(30))


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(3000):
        both, a, b = np.split(rng.integers(0, 2**64, 300, dtype=np.uint64), [240, 270])  # 240 of 300 are common
        x, y = (shingle_sets.band_keys(np.concatenate([both, own])) for own in (a, b))
        missed += not (x == y).any()
    assert missed == 0


@pytest.mark.parametrize("limit", [3, 512])
def test_long_lists_are_dealt_out(spark, limit):
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        words = [f"w{rng.randint(0, 50000)}" for _ in range(150)]
        texts += [edited(rng, words, rng.randint(0, 3)) for _ in range(20)]
    texts = sorted(set(texts))
    sets = [np.unique(shingle_sets.shingle_hashes(t, 5)) for t in texts]
    rows = [(i, i, shingle_sets.band_keys(x).tolist(), len(x), shingle_sets.parity(x), t) for i, (x, t) in enumerate(zip(sets, texts))]
    df = spark.createDataFrame(rows, "cls long, row long, keys array<long>, size int, parity binary, text string")
    edges = shingle_sets.links(df.drop("text"), df.select("row", "text"), 5, 0.8, limit)
    roots = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    assert {i for i in range(len(texts)) if roots.get(i, i) == i} == plain_kept(texts)


def test_nothing_alike_is_ruled_out():
    """Sizes and parities rule out most pairs below the similarity and none from it on."""
    rng = np.random.default_rng(4)
    out = kept = 0
    for _ in range(400):
        n, common = int(rng.integers(5, 900)), rng.random()
        both, a, b = (rng.integers(0, 2**64, int(k), dtype=np.uint64) for k in (n * common, n * (1 - common) * rng.random(), n * (1 - common) * rng.random()))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        if not len(x) or not len(y):
            continue
        alike = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        p = [np.frombuffer(shingle_sets.parity(s), np.uint64) for s in (x, y)]
        may = bool(shingle_sets.may_be_alike(np.int64(len(x)), np.int64(len(y)), *p, 0.8))
        assert may or alike < 0.8
        assert shingle_sets.with_partner(np.array([len(x), len(y)]), np.stack(p), 0.8).tolist() == [may, may]
        out, kept = out + (not may), kept + (may and alike < 0.6)
    assert out > 150 and kept < 20


def test_fingerprints_are_an_index_of_the_near_stage(spark, make):
    """pairs come from lists by positional bytes of SimHash, with counts of matching bytes, and are verified by similarity."""
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 50000)}" for _ in range(300)]
        texts += [" ".join(words), edited(rng, words, 1), edited(rng, words, 4), edited(rng, words, 150)]
    sets = [np.unique(shingle_sets.shingle_hashes(t, 5)) for t in texts]
    sketch = make(texts).select("doc_id", shingle_sets.sketches(F.col("text"), 5, simhash_dedup.indexed).alias("s")).collect()
    rows = []
    for r, x in zip(sorted(sketch), sets):
        fingerprint, keys = simhash_dedup.indexed(x)
        bits = [2 * sum(int(h) >> i & 1 for h in x) > len(x) for i in range(64)]
        assert fingerprint % 2**64 == sum(b << i for i, b in enumerate(bits)) and r.s.print == fingerprint
        assert set(r.s["keys"]) == {*keys.tolist(), *shingle_sets.band_keys(x).tolist()} and min(keys) >= 0
        rows.append((r.doc_id, r.doc_id, keys.tolist(), len(x), shingle_sets.parity(x), fingerprint, texts[r.doc_id]))
    df = spark.createDataFrame(rows, "cls long, row long, keys array<long>, size int, parity binary, print long, text string")
    found = {(min(e), max(e)) for e in shingle_sets.links(df.drop("text"), df.select("row", "text"), 5, 0.8).collect()}
    same = lambda a, b: sum(x == y for x, y in zip(*((rows[i][5] % 2**64).to_bytes(8, "little") for i in (a, b))))
    alike = {(a, b) for a, b in combinations(range(len(texts)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert found <= alike
    sure = {p for p in alike if same(*p) >= shingle_sets.MATCHES}
    roots = {r.node: r.root for r in simhash_dedup.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    assert len(sure) >= 12 and all(roots[a] == roots[b] for a, b in sure)


def test_pairs_of_a_list_with_few_matching_bytes_are_dropped():
    size, parities = np.array([100, 100]), np.zeros((2, 16), np.uint64)
    for bytes_, kept in ((3, False), (4, True)):
        prints = np.array([0, int.from_bytes(bytes([0] * bytes_ + [1] * (8 - bytes_)), "little")], np.int64)
        assert shingle_sets.with_partner(size, parities, 0.8, prints).tolist() == [kept, kept]


def test_long_lists_of_the_index_are_left_to_the_other_keys(spark):
    """Of one near group, the index has twenty lists with other members each."""
    own = [(i, [7, 8 + i // 3, -5, -6 - i]) for i in range(9)]
    lists = shingle_sets.candidate_lists(spark.createDataFrame(own, "cls long, keys array<long>"), 4).collect()
    assert {(r.key, r.n) for r in lists} == {(-5, 9), (8, 3), (9, 3), (10, 3)}


@pytest.mark.parametrize("own_words", [True, False])
def test_long_lists_grow_with_their_members(spark, own_words):
    """Rows to be compared in one large group were n * n / limit by list; they are at most two an entry now, and no link is lost.
    Texts that aren't like the hub have edits of their own, or edits that many others have too."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = {" ".join(base)}
    while len(texts) < 200:
        words = list(base)
        for i in rng.sample(range(150), rng.choice([0, 1, 2, 3, 3, 5, 9])):
            words[i] = f"edit{rng.randint(0, 10**9) if own_words else rng.randint(0, 3)}"
        texts |= {" ".join(words), edited(rng, words, 1)}
    texts = sorted(texts)
    sets = [np.unique(shingle_sets.shingle_hashes(t, 5)) for t in texts]
    rows = [(i, i, shingle_sets.band_keys(x).tolist(), len(x), shingle_sets.parity(x), t) for i, (x, t) in enumerate(zip(sets, texts))]
    df = spark.createDataFrame(rows, "cls long, row long, keys array<long>, size int, parity binary, text string")
    lists = shingle_sets.candidate_lists(df.drop("text"), 10)
    sizes = [r["count"] for r in lists.groupBy("key").count().collect()]
    assert sum(n * -(-n // 10) for n in sizes) > 4 * sum(sizes)
    known, compared = shingle_sets.tiles(lists, df.drop("text"), df.select("row", "text"), 5, 0.8, 10)
    assert known.count() and compared.count() < 2 * sum(sizes)
    edges = shingle_sets.links(df.drop("text"), df.select("row", "text"), 5, 0.8, 10)
    roots = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    kept = plain_kept(texts)
    assert 1 < len(kept) < len(texts)
    assert {i for i in range(len(texts)) if roots.get(i, i) == i} == kept
