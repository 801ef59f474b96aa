"""Text normalization. Python's Unicode tables decide, in one place: an Arrow UDF, as Spark has no NFKC and no folding of
accents by script."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NormConfig

_SPACES = re.compile(r"\s+")


class CharacterTable(dict):
    """What each character becomes, worked out when it is first met. Letters, marks and numbers stay, Latin letters lose
    their accents, controls, format characters and surrogates go, private use and separators are spaces, punctuation and
    symbols are spaces or go. Unassigned code points stay."""

    def __init__(self, fold_latin: bool, punctuation_to_space: bool):
        self.fold_latin, self.punctuation = fold_latin, " " if punctuation_to_space else ""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        kind = unicodedata.category(char)
        out = char
        if kind[0] == "L":
            if self.fold_latin and unicodedata.name(char, "").startswith("LATIN"):
                out = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c)) or char
        elif kind in ("Cc", "Cf", "Cs"):
            out = ""
        elif kind == "Co" or kind[0] == "Z":
            out = " "
        elif kind[0] in "PS":
            out = self.punctuation
        self[point] = out
        return out


@lru_cache(8)
def character_table(fold_latin: bool, punctuation_to_space: bool) -> CharacterTable:
    return CharacterTable(fold_latin, punctuation_to_space)


def normalize_text(value: object, config: NormConfig = NormConfig()) -> str:
    """A name or address in its normal form; "" for null and NaN, ``str`` of what isn't a string."""
    if value is None or value != value:
        return ""
    if isinstance(value, str) and value.isascii() and value.isalnum():  # one plain word: nothing to fold or cut at
        plain = value.lower()
        return plain[: config.max_length] if config.max_length else plain
    text = unicodedata.normalize(config.form, str(value)).translate(character_table(config.fold_latin, config.punctuation_to_space))
    text = text.lower() if config.case == "lower" else text.casefold()
    text = _SPACES.sub(" ", text).strip()
    return text[: config.max_length].rstrip() if config.max_length else text


def normalize_country(value: object, config: NormConfig = NormConfig()) -> str:
    """A country label: the same table, lower case, ends stripped; no collapsing and no cut."""
    if value is None:
        return ""
    return unicodedata.normalize(config.form, str(value)).translate(character_table(config.fold_latin, config.punctuation_to_space)).strip().lower()


def _udf(function, config: NormConfig):
    @F.arrow_udf("string")
    def normalized(values: pa.Array) -> pa.Array:
        met: dict[object, str] = {}  # a batch of names repeats many
        out = []
        for v in values.to_pylist():
            if v not in met:
                met[v] = function(v, config)
            out.append(met[v])
        return pa.array(out, pa.string())

    return normalized


def name_norm(column: Column, config: NormConfig = NormConfig()) -> Column:
    return _udf(normalize_text, config)(column)


address_norm = name_norm


def country_norm(column: Column, config: NormConfig = NormConfig()) -> Column:
    return _udf(normalize_country, config)(column)


def strip_separators(column: Column) -> Column:
    return F.replace(column, F.lit(" "), F.lit(""))


def add_normalized_columns(df: DataFrame, config: NormConfig = NormConfig(), name: str = "business_name", address: str = "business_address", country: str = "country") -> DataFrame:
    """Adds name_norm, name_key, address_norm and country_norm; the raw columns and the rows stay."""
    df = df.withColumns({"name_norm": name_norm(F.col(name), config), "address_norm": address_norm(F.col(address), config), "country_norm": country_norm(F.col(country), config)})
    return df.withColumn("name_key", strip_separators(F.col("name_norm")))
