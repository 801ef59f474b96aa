import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from recordloom.llm import components, exact_dedup, simhash_dedup, substring_dedup
from recordloom.llm.common import join_groups


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_groups(make, texts):
    got = exact_dedup.exact_groups(make(texts)).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    assert len(got) == len(texts)
    for r in got:
        own = groups[lower(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(lower(texts[r.doc_id]).encode()).hexdigest()


def test_exact_ties_and_nulls(make):
    got = exact_dedup.exact_groups(make(["a", "A", "a", None, "", "b"], ids=[5, 5, None, None, None, 1])).collect()
    kept = Counter((r.text_sha256, r.kept) for r in got)
    assert all(n == 1 for (_, k), n in kept.items() if k) and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.group_size == 3} == {5} and {r.keep_id for r in got if r.group_size == 2} == {None}


def test_exact_drop_keeps_all_columns(make, texts):
    docs = make(texts)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    keep = {max(i for i, t in enumerate(texts) if lower(t) == key) for key in map(lower, texts)}
    assert {r.doc_id for r in got.collect()} == keep
    twice = exact_dedup.drop_exact_duplicates(make(["x", "x", "y"], ids=[1, 1, 2])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 2]


def test_filter_has_no_false_negatives(spark):
    digests = [hashlib.sha256(str(i % 700).encode()).hexdigest() for i in range(1000)]
    df = spark.createDataFrame([(d,) for d in digests], "h string")
    bitmaps, buckets = exact_dedup.repeat_filter(df, "h", 1000)
    marked = exact_dedup.mark_possible(df, "h", bitmaps, buckets)
    many = Counter(digests)
    rows = marked.collect()
    assert all(r.possible for r in rows if many[r.h] > 1)
    assert sum(r.possible for r in rows if many[r.h] == 1) < 40


def test_exact_is_the_same_whatever_fits_a_broadcast(make, texts, monkeypatch):
    docs = make(texts + texts[:9], ids=[*range(len(texts)), *range(9)])
    results = []
    for most in (64 << 20, 1):  # then nothing is broadcast by pass two, and the second filter is a single bucket
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", most)
        results.append((sorted(map(str, exact_dedup.exact_groups(docs).collect())), sorted(map(str, exact_dedup.drop_exact_duplicates(docs).collect()))))
    assert results[0] == results[1]


def test_exact_drop_keeps_everything_with_a_full_filter(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_BITS", 8)  # nearly every row seems to repeat
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 1)
    texts = [f"t{i % 60}" for i in range(100)]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(make(texts)).collect()) == list(range(40, 100))


def test_equal_ids_and_texts_with_other_columns_rerun_alike(spark):
    rows = [(1, "a b", f"s{i}", {"k": i}) for i in range(20)] + [(None, "A b", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `so.urce` string, m map<string,int>")
    kept = [exact_dedup.drop_exact_duplicates(docs.repartition(n)).collect() for n in (1, 7)]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_dropping_bears_any_names(spark):
    names = "doc_id long, text string, gone_id long, gone_hash long, row_values string, text_sha256 string, possible string, bucket string, keep_id long, cls long, best string"
    docs = spark.createDataFrame([(i, f"w{i // 2} x y z a b c", 1, 2, "v", "h", "p", "b", 3, 4, "n") for i in range(10)], names)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [1, 3, 5, 7, 9]
    got = simhash_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 4, 6, 8]


def test_empty_tables(make):
    none = make(["x"]).limit(0)
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_duplicates(none).count() == 0
    assert simhash_dedup.near_groups(none).count() == simhash_dedup.drop_near_duplicates(none).count() == 0
    assert substring_dedup.repeated_spans(none).count() == 0


def test_hot_keys_split_like_any_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(2000)] + [(f"k{i}", i) for i in range(50)], "k string, v long")
    groups = rows.groupBy("k").agg({"v": "count"}).toDF("k", "n")
    assert join_groups(rows, groups, "k", "n", 1).count() == join_groups(rows, groups, "k", "n", 10**9).count() == 2050


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randint(0, 100), rng.randint(0, 100)) for _ in range(60)] + [(3, 3)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def plain_fingerprint(text, k):
    words = words_of(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            count[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * count[i] > len(shingles))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(make, texts):
    got = {r.doc_id: r for r in simhash_dedup.table(simhash_dedup.near_groups(make(texts))).collect()}
    prints = {i: plain_fingerprint(t, 4) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def test_four_matching_bytes_share_a_list():
    sets = simhash_dedup.byte_sets(4)
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4)) and len(sets) == 20


@pytest.mark.parametrize("limit", [3, 2048])
def test_links_connect_all_near_fingerprints(spark, limit):
    """Clusters whose lists are over the limit are dealt out to tiles, with the same result."""
    rng = random.Random(4)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(25)}
    prints = dict(enumerate(sorted(values)))
    signed = [(i, [int(np.uint64(v).view(np.int64))]) for i, v in prints.items()]
    edges = simhash_dedup.links(spark.createDataFrame(signed, "cls long, prints array<long>"), 1, 4, 4, limit)
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert {i: got.get(i, i) for i in prints} == plain_components(prints)


def test_near_duplicates_go_and_others_stay(make):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(40)]
    near = [t.replace(t.split()[150], "changed", 1) for t in texts[:20]]
    docs = make(texts + near)
    got = simhash_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    assert kept == set(range(40)), "of a near copy the smaller id stays"


def plain_removal(texts, k):
    docs = [words_of(t) for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in docs for i in range(len(w) - k + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("k, sub", [(35, 8), (5, 2), (3, 3)])
def test_repeated_spans(make, texts, k, sub):
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(make(texts), k, sub).collect()}
    for i, (n, removed, kept) in enumerate(plain_removal(texts, k)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, kept)
        assert sum(s.words for s in r.removed) == removed


def test_repeats_over_blocks_and_within(make, monkeypatch):
    rng = random.Random(2)
    unit = " ".join(f"u{rng.randint(0, 99)}" for _ in range(50))
    texts = [f"{unit} x{i} {unit}" for i in range(8)] + ["la " * 100, " ".join(f"z{i}" for i in range(99))]
    expected = plain_removal(texts, 35)
    for most in (1 << 20, 120):  # one block, or many of one document or two
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_spans(make(texts).repartition(2), block_words=most).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_repeated_rows_are_copies(make):
    text = " ".join(f"q{i}" for i in range(40))
    got = substring_dedup.repeated_spans(make([text, text], ids=[1, 1])).collect()
    assert [r.n_removed for r in got] == [40, 40] and {r.doc_id for r in got} == {1}


def test_nodes_that_fork(spark):
    """Chains 1-2-3-4 and 8-9, a fork at 4, a junction at 9, a cycle 20-21-20 and an item by itself."""
    items = [("a", 1, 2), ("b", 2, 3), ("c", 3, 4), ("d", 4, 5), ("e", 4, 6), ("f", 8, 9), ("i", 7, 9), ("g", 20, 21), ("h", 21, 20), ("j", 30, 31)]
    rows = spark.createDataFrame([(d.encode(), s, t) for d, s, t in items], "digest binary, src long, dst long")
    assert sorted(r.node for r in substring_dedup.branching_nodes(rows).collect()) == [4, 9]


def test_paths_end_where_the_graph_forks(make):
    """Two passages with a common middle: its words are one path of their own in both."""
    rng = random.Random(13)
    words = lambda n: [f"f{rng.randint(0, 10**6)}" for _ in range(n)]
    middle, a, b, c, d = words(100), words(60), words(60), words(60), words(60)
    one, two = " ".join(a + middle + b), " ".join(c + middle + d)
    rows = {r.doc_id: r for r in substring_dedup.repeated_spans(make([one, one, two, two])).collect()}
    assert [r.n_removed for r in rows.values()] == [220] * 4
    assert len(rows[0].paths) == len(rows[2].paths) == 3 and len(set(rows[0].paths) & set(rows[2].paths)) == 1


def test_spans_name_the_paths_they_share(make):
    rng = random.Random(12)
    words = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    one, two = words(120), words(90)
    texts = [f"{words(10)} {one} {words(9)}", f"{one} {words(30)}", f"{two} {words(5)} {one}", two, words(200)]
    rows = {r.doc_id: r for r in substring_dedup.repeated_spans(make(texts)).collect()}
    assert [len(rows[i].paths) for i in range(5)] == [1, 1, 2, 1, 0], "a passage is one path"
    assert rows[0].paths == rows[1].paths and set(rows[2].paths) == {*rows[0].paths, *rows[3].paths}
    assert [(s.first, s.words) for s in rows[2].removed] == [(0, 90), (95, 120)]


def test_leftmost_least_over_ranges(monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 9, 500).astype(np.uint64)
    plain = [i + int(np.argmin(seeds[i : i + 7])) for i in range(494)]
    for places in (1 << 20, 50):
        monkeypatch.setattr(substring_dedup, "_PLACES", places)
        assert substring_dedup.leftmost_least(seeds, 7).tolist() == plain
    assert len(substring_dedup.leftmost_least(seeds[:3], 7)) == 0


def test_digests_are_of_the_words_at_their_places(monkeypatch):
    """Whatever the rolling hashes, which have three bits here."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    texts += texts[:3]
    full = substring_dedup.rolling
    monkeypatch.setattr(substring_dedup, "rolling", lambda h, k, base: full(h, k, base) & np.uint64(7))
    words = sorted({w.encode() for t in texts for w in t.split()})
    code = {w: i for i, w in enumerate(words)}
    part = np.array([code[w.encode()] for w in texts[0].split()])
    h = np.arange(len(words), dtype=np.uint64)
    p = substring_dedup._pieces(words, part, (h[part], h[part]), np.array([0, len(part)]), 5, 2)
    digests = p.digests(np.arange(10), 5)
    assert digests == [xxhash.xxh3_128_digest(" ".join(texts[0].split()[i : i + 5]).encode()) for i in range(10)]


@pytest.mark.parametrize("k, sub", [(35, 8), (2, 2), (1, 1), (7, 6)])
def test_hashes_share_their_doubling_and_go_by_ranges(monkeypatch, k, sub):
    from recordloom.llm.hashing import U64, mix, rollings

    rng = np.random.default_rng(2)
    h = tuple(rng.integers(0, 2**64, 200, dtype=np.uint64) for _ in range(2))
    base = substring_dedup._BASES[0]
    plain = lambda size: [sum(int(x) * pow(base, size - 1 - j, 2**64) for j, x in enumerate(h[0][i : i + size])) % 2**64 for i in range(200 - size + 1)]
    sizes = (k, max(1, k - 1), sub, 201)
    assert [x.tolist() for x in rollings(h[0], sizes, base)] == [*map(plain, sizes[:3]), []]
    whole = substring_dedup._hashes(h, k, sub, True)
    assert whole[0].tolist() == plain(k) and whole[2].tolist() == mix(np.array(plain(sub), U64)).tolist()
    for places in (1, 3, 64):
        monkeypatch.setattr(substring_dedup, "_PLACES", places)
        assert [x.tolist() for x in substring_dedup._hashes(h, k, sub, True)] == [x.tolist() for x in whole]
        assert not any(map(len, substring_dedup._hashes(h, k, sub, False)[:2]))
