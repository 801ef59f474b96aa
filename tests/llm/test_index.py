"""The byte index finds what links() promises."""

import random
from itertools import combinations

import numpy as np
import pytest

from recordloom.llm import components, simhash_dedup


@pytest.mark.parametrize("matches", [3, 4, 5])
def test_matching_bytes_share_a_list(matches):
    sets = simhash_dedup.byte_sets(matches)
    assert all(any(set(s) <= set(some) for s in sets) for some in combinations(range(8), matches))


def test_three_matching_bytes_link(spark):
    """Pairs with exactly three bytes alike, in every position."""
    rng = random.Random(6)
    rows, pairs = [], []
    for n, same in enumerate(combinations(range(8), 3)):
        print_ = rng.getrandbits(64)
        other = print_ ^ sum(1 << 8 * i for i in range(8) if i not in same)
        rows += [(2 * n, [int(np.uint64(print_).view(np.int64))]), (2 * n + 1, [int(np.uint64(other).view(np.int64))])]
        pairs.append((2 * n, 2 * n + 1))
    edges = simhash_dedup.links(spark.createDataFrame(rows, "cls long, prints array<long>"), 1, 5, 3)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert all(roots.get(a) == roots.get(b) == a for a, b in pairs)


def test_count_filter_comes_before_the_bits():
    """Of two pairs in a list with as many differing bits, only the one with enough matching bytes is retained."""
    spread, dense = sum(1 << 8 * i for i in range(5)), 0b11111
    prints = np.array([[0], [spread], [1 << 40], [(1 << 40) ^ dense]], np.uint64)
    root = simhash_dedup._forest(np.array([0, 0, 1, 1]), prints, 4, 5)
    assert root.tolist() == [0, 1, 2, 2]
