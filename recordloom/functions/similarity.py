"""Fuzzy ratios from 0 to 1 on the longest common subsequence, and Unicode scripts, as Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Compares what both share with what each has besides; 0 if either has no token, 1 if one has nothing besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, da, db = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not da or not db):
        return 1.0
    gap = len(both) + bool(both)
    best = 1 - (len(da) + len(db) - 2 * lcs(da, db)) / (2 * gap + len(da) + len(db))
    if both:
        best = max(best, *(1 - (1 + len(d)) / (2 * len(both) + 1 + len(d)) for d in (da, db)))
    return best


def _windows(short: str, long_: str) -> list[tuple[float, int, int]]:
    """(bound, start, end) of windows of ``long_`` as long as ``short``, cut off at the ends; the bound on the ratio is
    that of the characters in common, whatever their order."""
    m, left = len(short), Counter(short)
    common, out = 0, []
    for end in range(1, len(long_) + m):
        if end <= len(long_):
            left[long_[end - 1]] -= 1
            common += left[long_[end - 1]] >= 0
        start = end - m
        if start > 0:
            common -= left[long_[start - 1]] >= 0
            left[long_[start - 1]] += 1
        a, b = max(start, 0), min(end, len(long_))
        out.append((2 * common / (m + b - a), a, b))
    return out


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, windows cut off at the ends included."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    sides = [sorted((a, b), key=len)]
    if len(a) == len(b):
        sides.append(sides[0][::-1])
    best = 0.0
    for short, long_ in sides:
        windows = _windows(short, long_)
        _, start, end = max(windows)
        best = max(best, ratio(short, long_[start:end]))
        # a step of the window adds one character, so a subsequence grows by one a step at most
        known, at = len(short), 0
        for i, (bound, start, end) in enumerate(windows):
            if bound > best and known + i - at > best * (len(short) + end - start) / 2:
                known, at = lcs(short, long_[start:end]), i
                best = max(best, 2 * known / (len(short) + end - start))
    return best


def pairwise(function: Callable[[str, str], float], a: Column, b: Column) -> Column:
    """One of the ratios above over two columns; null where either text is."""

    @F.arrow_udf(T.DoubleType())
    def scored(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return scored(a, b)


# Script names as they occur in character names; the first that does decides.
SCRIPTS = (
    "LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL",
    "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "THAI", "LAO", "TIBETAN", "MYANMAR", "GEORGIAN", "ARMENIAN", "HANGUL",
    "HIRAGANA", "KATAKANA", "CJK", "THAANA", "ETHIOPIC", "CHEROKEE", "MONGOLIAN", "KHMER", "BOPOMOFO", "YI ",
)


@lru_cache(65536)
def _script(char: str) -> str:
    name = unicodedata.name(char, "") if char.isalpha() else ""
    return next((s.strip() for s in SCRIPTS if s in name), "")


def scripts_of(text: str) -> list[str]:
    return sorted({s for s in map(_script, set(text)) if s})


def dominant_script(text: str) -> str:
    """First word of the character names of most letters and marks; the first met on a tie, "" without any."""
    counts: Counter[str] = Counter()
    for char in text:
        if unicodedata.category(char)[0] in "LM" and (name := unicodedata.name(char, "")):
            counts[name.split(" ")[0]] += 1
    return counts.most_common(1)[0][0] if counts else ""


@F.arrow_udf(T.ArrayType(T.StringType()))
def scripts_udf(text: pa.Array) -> pa.Array:
    return pa.array([scripts_of(t or "") for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def dominant_script_udf(text: pa.Array) -> pa.Array:
    return pa.array([dominant_script(t or "") for t in text.to_pylist()], pa.string())
