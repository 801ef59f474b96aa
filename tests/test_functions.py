import itertools
import random

import pytest
from pyspark.sql import functions as F

from recordloom.config import KeyConfig, LinkConfig, NormConfig, load_config
from recordloom.functions import ids, text
from recordloom.functions.normalize import name_norm, country_norm, normalize_country, normalize_text
from recordloom.functions.similarity import dominant_script, lcs, partial_ratio, ratio, scripts_of, token_set_ratio, token_sort_ratio


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Widow's Peak!", "widow s peak"),
        ("Ångström Über", "angstrom uber"),
        ("tea+cake @7", "tea cake 7"),
        ("pier-nine.example", "pier nine example"),
        ("दूध की दुकान", "दूध की दुकान"),
        ("ശരി", "ശരി"),
        ("Мёд", "мёд"),
        ("", ""),
        (None, ""),
        ("A\tB", "ab"),
        ("A\nB", "ab"),
        ("ＡＢＣ　１", "abc 1"),
        ("a‍b", "ab"),
        (float("nan"), ""),
        (12, "12"),
    ],
)
def test_normal_forms(raw, expected):
    assert normalize_text(raw) == expected


def test_cut_is_stripped_again():
    assert normalize_text("x" * 511 + " yz") == "x" * 511


def test_country_keeps_inner_spaces_and_length():
    assert normalize_country(" United  Kingdom ") == "united  kingdom"
    assert len(normalize_country("x" * 600)) == 600


def test_norm_options():
    assert normalize_text("Straße", NormConfig(case="casefold")) == "strasse"
    assert normalize_text("a.b", NormConfig(punctuation_to_space=False)) == "ab"
    assert normalize_text("é", NormConfig(fold_latin=False)) == "é"
    with pytest.raises(ValueError):
        NormConfig(form="XYZ")


def test_udfs(spark):
    df = spark.createDataFrame([("Café", "US "), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(name_norm(F.col("a")), country_norm(F.col("b"))).collect()] == [("cafe", "us"), ("", "")]


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return row.select(column.alias("x")).first().x


def test_tokens_and_grams(spark):
    a = F.col("a")
    assert value(spark, text.tokens(a), a="") == []
    assert value(spark, text.tokens(a), a="x y x") == ["x", "y", "x"]
    assert value(spark, text.trigrams(a), a="ab") == []
    assert sorted(value(spark, text.trigrams(a), a="abcabc")) == ["abc", "bca", "cab"]
    assert value(spark, text.ngrams(a, 1), a="") == []
    assert value(spark, text.initials(a), a="acme beta") == "ab"


def test_overlaps(spark):
    a, b = F.col("a"), F.col("b")
    assert value(spark, text.token_jaccard(a, b), a="", b="") == 0.0
    assert value(spark, text.token_jaccard(a, b), a="acme alpha limited", b="acme beta limited") == 0.5
    assert value(spark, text.trigram_jaccard(a, b), a="ab", b="abc") == pytest.approx(2 / 3)
    assert value(spark, text.length_ratio(a, b), a="", b="x") == 0.0


def test_legal_tokens_are_never_all_stripped(spark):
    assert value(spark, text.suffix_key(F.col("a")), a="acme ltd industries acme") == "acme"
    assert value(spark, text.suffix_key(F.col("a")), a="pvt ltd") == "ltd pvt"
    assert value(spark, text.suffix_key(F.col("a")), a="") == ""


def test_bounded_levenshtein(spark):
    column = text.bounded_levenshtein(F.col("a"), F.col("b"), F.lit(2), 10)
    assert value(spark, column, a="kitten", b="sitting") == 3
    assert value(spark, column, a="kitten", b="mitten") == 1


def test_evidence(spark):
    assert value(spark, text.evidence(F.col("a"), 4), a=0.31875) == "0.3187"
    assert value(spark, text.evidence(F.lit(None).cast("double"), 4), a=0) == ""
    assert value(spark, text.evidence(F.col("a"), 0), a=1234.0) == "1234"


def test_fuzzy_ratios():
    a, b = "acme alpha limited", "acme beta limited"
    assert token_set_ratio(a, b) == pytest.approx(0.82758623, abs=1e-7)
    assert token_sort_ratio(a, b) == pytest.approx(0.8)
    assert partial_ratio(a, b) == pytest.approx(0.7647059, abs=1e-7)
    assert token_set_ratio("acme", "acme limited") == 1.0 and token_set_ratio("", "x") == 0.0
    assert partial_ratio("alpha", a) == 1.0


def test_ratios_against_plain_versions():
    rng = random.Random(5)

    def slow_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert lcs(a, b) == slow_lcs(a, b)
        if a and b:
            best = 0.0
            for short, long_ in [sorted((a, b), key=len)] + ([sorted((a, b), key=len)[::-1]] if len(a) == len(b) else []):
                best = max([best, *(ratio(short, long_[max(s, 0) : s + len(short)]) for s in range(1 - len(short), len(long_)))])
            assert partial_ratio(a, b) == best


def test_scripts():
    assert dominant_script("12 Main राम") == "LATIN" and dominant_script("12") == ""
    assert scripts_of("acme राम") == ["DEVANAGARI", "LATIN"] and scripts_of("12") == []


def test_ids(spark):
    df = spark.createDataFrame([("S2-166376419",)], "e string")
    code = df.select(ids.entity_code(F.col("e")).alias("c"))
    assert code.first().c == 20166376419 and code.select(ids.decode_entity(F.col("c")).alias("e")).first().e == "S2-166376419"
    with pytest.raises(Exception, match="not an entity id"):
        spark.createDataFrame([("X-1",)], "e string").select(ids.entity_code(F.col("e"))).collect()


def test_hash_buckets_are_known(spark):
    df = spark.createDataFrame([("S1-5",), ("S1-10",), ("S1-16",), ("S1-3",)], "e string")
    assert all(r.v for r in df.select(ids.is_validation(F.col("e"), 0.2).alias("v")).collect())
    folds = [r.f for r in df.select(ids.hash_bucket(F.col("e"), 2).alias("f")).collect()]
    assert sorted(folds) == [0, 0, 1, 1]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"folds": 3, "token": {"df_cap": 50}}')
    got = load_config(str(path), {"folds": 7}, {"RECORDLOOM_FOLDS": "4", "RECORDLOOM_VAL_FRACTION": "0.3"})
    assert (got.folds, got.val_fraction, got.token.df_cap, got.token.rarest) == (7, 0.3, 50, 1)
    with pytest.raises(ValueError):
        load_config(None, {"nonsense": 1}, {})
    for bad in ({"df_cap": 0}, {"rarest": True}, {"jaccard": 0.0}):
        with pytest.raises(ValueError):
            KeyConfig(**bad)
    assert LinkConfig().char.jaccard == 0.3


def test_proposals_give_distinct_keys(spark):
    df = spark.createDataFrame([("acme ltd acme", "acmeltdacme", "1 main st", "in"), ("", "", "", "")], "name_norm string, name_key string, address_norm string, country_norm string")
    for name, make in text.PROPOSALS.items():
        for row in df.select(make().alias("k")).collect():
            assert len(row.k) == len(set(row.k)) and "" not in row.k, name
    first = df.select(*[make().alias(n) for n, make in text.PROPOSALS.items()]).first()
    assert first.suffix_stripped == ["acme"] and first.country_prefix6 == ["in#acmelt"] and first.initials == ["ala"]
    assert list(itertools.chain(*df.where("name_norm = ''").select(*[m().alias(n) for n, m in text.PROPOSALS.items()]).first())) == []
