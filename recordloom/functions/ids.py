"""Entity ids such as ``S2-166376419``, and stable buckets of them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = r"^S([0-9])-(0|[1-9][0-9]{0,9})$"


def source_code(entity_id: Column) -> Column:
    """The source of an id as a number; raises on what isn't an id."""
    wrong = F.raise_error(F.concat(F.lit("not an entity id: "), F.coalesce(entity_id, F.lit("null"))))
    return F.when(entity_id.rlike(_PATTERN), F.substring(entity_id, 2, 1)).otherwise(wrong).cast("int")


def id_number(entity_id: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("not an entity id: "), F.coalesce(entity_id, F.lit("null"))))
    return F.when(entity_id.rlike(_PATTERN), F.substr(entity_id, F.lit(4))).otherwise(wrong).cast("bigint")


def entity_code(entity_id: Column) -> Column:
    """A number that orders ids by source, then by number."""
    return source_code(entity_id).cast("bigint") * 10_000_000_000 + id_number(entity_id)


def decode_entity(code: Column) -> Column:
    n = 10_000_000_000
    return F.concat(F.lit("S"), F.floor(code / n).cast("string"), F.lit("-"), F.pmod(code, F.lit(n)).cast("string"))


def stable_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def hash_bucket(entity_id: Column, buckets: int, skip: int = 1) -> Column:
    """(hash // skip) % buckets of an id's 64-bit BLAKE2b."""

    @F.arrow_udf("long")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array([None if i is None else stable_hash(i) // skip % buckets for i in ids.to_pylist()], pa.int64())

    return bucket(entity_id)


def md5_bucket(entity_id: Column, buckets: int) -> Column:
    """The same idea in functions that every SQL engine has: 15 hexadecimal digits of the MD5."""
    return F.conv(F.substring(F.md5(entity_id.cast("binary")), 1, 15), 16, 10).cast("bigint") % buckets


def is_validation(entity_id: Column, fraction: float, mode: str = "blake2b", seed: int = 0) -> Column:
    """Whether an id is in the validation split. ``random`` is by a seeded hash, so it doesn't depend on the order of rows."""
    cut = int(fraction * 1_000_000)
    if mode == "md5":
        return md5_bucket(entity_id, 1_000_000) < cut
    if mode == "random":
        return F.pmod(F.xxhash64(entity_id, F.lit(seed)), F.lit(1_000_000)) < cut
    return hash_bucket(entity_id, 1_000_000) < cut


def is_sampled(entity_id: Column, fraction: float) -> Column:
    """Whether whole-entity sampling keeps an id, independently of the split."""
    return hash_bucket(entity_id, 1_000_000, 1_000_000) < round(fraction * 1_000_000)
