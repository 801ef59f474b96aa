"""Column functions on normalized text: tokens, n-grams, overlaps, derived keys. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of legal forms and generic business words, which results depend on.
LEGAL_TOKENS = (
    "ltd", "limited", "pvt", "private", "inc", "incorporated", "llp", "llc", "plc", "co", "company", "corp", "corporation",
    "enterprises", "enterprise", "industries", "industry", "services", "service", "solutions", "solution", "technologies",
    "technology", "tech", "systems", "system", "group", "holdings", "international", "intl", "and", "the", "of", "india",
    "traders", "trading", "agency", "agencies", "stores", "store", "shop", "shoppe", "centre", "center", "works", "products",
    "exports", "imports", "associates", "consultants", "consultancy", "ventures", "labs", "laboratories", "pharma",
    "pharmaceuticals", "motors", "auto", "automobiles",
)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def ngrams(c: Column, n: int) -> Column:
    """Distinct code-point n-grams, none for shorter text. The guard matters: sequence(1, 0) would count down."""
    every = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def trigrams(c: Column) -> Column:
    return ngrams(c, 3)


def characters(c: Column) -> Column:
    return ngrams(c, 1)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return F.round(100 * safe_div(a, b), 4)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    n = shared(a, b)
    return safe_div(n, F.size(a) + F.size(b) - n)


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(token_set(a), token_set(b))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """By trigrams, or by characters on both sides if either text has under three."""
    short = (F.length(a) < 3) | (F.length(b) < 3)
    return F.when(short, set_jaccard(characters(a), characters(b))).otherwise(set_jaccard(trigrams(a), trigrams(b)))


def overlap_coefficient(n_shared: Column, n_a: Column, n_b: Column) -> Column:
    return safe_div(n_shared, F.least(n_a, n_b))


def length_ratio(a: Column, b: Column) -> Column:
    return safe_div(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def first_token(c: Column) -> Column:
    return F.split_part(c, F.lit(" "), F.lit(1))


def strip_legal(words: Column) -> Column:
    """Tokens without legal ones, in order and with repeats; all of them where none would be left."""
    legal = F.array(*[F.lit(t) for t in LEGAL_TOKENS])
    kept = F.filter(words, lambda t: ~F.array_contains(legal, t))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def suffix_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(strip_legal(tokens(c)))), " ")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}", "")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(tokens(c), lambda t: F.substring(t, 1, 1)), "")


def bounded_levenshtein(a: Column, b: Column, cap: Column, most: int) -> Column:
    """Edit distance, or cap + 1 where it is over ``cap``; ``most`` is a constant that no cap exceeds."""
    d = F.levenshtein(a, b, most)
    return F.when((d < 0) | (d > cap), cap + 1).otherwise(d)


def utf8_bytes(c: Column) -> Column:
    """One character for each byte of the text's UTF-8."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


# The blockers' names in provenance labels, in the order of their bits and of a pair's labels.
BLOCKERS = ("exact_name", "token", "char_ngram", "suffix_stripped")


def provenance(blockers: Column, kinds: tuple[str, ...] = BLOCKERS[:3]) -> tuple[Column, ...]:
    """Whether each kind is among labels such as ``source2:token``."""
    found = F.transform(blockers, lambda x: F.split_part(x, F.lit(":"), F.lit(2)))
    return tuple(F.array_contains(found, kind) for kind in kinds)


def evidence(c: Column, digits: int) -> Column:
    """A number as text, "" for null. The last digit is rounded on the exact value of the double, halves to even."""
    shown = F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0"))
    return F.coalesce(shown, F.lit(""))


def _one(c: Column) -> Column:
    return F.filter(F.array(c), lambda x: x != "")


def _grams(n: int) -> Callable[[Column], Column]:
    return lambda: F.when(F.length("name_key") < n, _one(F.col("name_key"))).otherwise(ngrams(F.col("name_key"), n))


# The names of proposals are values of a result column.
#: Keys that a new blocker might use, as distinct keys of a record's normalized columns.
PROPOSALS: dict[str, Callable[[], Column]] = {
    "token_any": lambda: token_set(F.col("name_norm")),
    "token_sorted": lambda: _one(F.array_join(F.array_sort(token_set(F.col("name_norm"))), " ")),
    "initials": lambda: _one(initials(F.col("name_norm"))),
    "prefix4": lambda: _one(F.substring("name_key", 1, 4)),
    "prefix6": lambda: _one(F.substring("name_key", 1, 6)),
    "prefix8": lambda: _one(F.substring("name_key", 1, 8)),
    "suffix_stripped": lambda: _one(suffix_key(F.col("name_norm"))),
    "suffix_stripped_prefix6": lambda: _one(F.substring(F.replace(suffix_key(F.col("name_norm")), F.lit(" "), F.lit("")), 1, 6)),
    "digits_stripped": lambda: _one(strip_digits(F.col("name_key"))),
    "address_tokens": lambda: token_set(F.col("address_norm")),
    "country_prefix6": lambda: F.when((F.col("country_norm") != "") & (F.col("name_key") != ""), F.array(F.concat("country_norm", F.lit("#"), F.substring("name_key", 1, 6)))).otherwise(F.array().cast("array<string>")),
    "char_2gram_any": _grams(2),
    "char_trigram_any": _grams(3),
    "char_4gram_any": _grams(4),
}
