"""Exact deduplication in two passes over a counting Bloom filter.

Pass one adds every text's hash to a blocked Bloom filter and keeps the cells that were hit twice or more. Pass two
looks every row up: a row with a cell that only it has hit is unique and passes straight through, and only the rest,
the repeated texts and a few false positives, are shuffled and grouped by their SHA-256. A false positive costs a
little shuffle and never changes the result; a repeated text hits all of its cells at least twice, so none is missed.

All of it is DataFrame functions. The filter has 4 bytes a row, in buckets of 4 kB. What meets it are digests and row
numbers, never texts: up to ``BROADCAST_BYTES`` the filter is broadcast to them, beyond that they meet in a join by bucket.
Whole rows meet a second filter, that of the digests that do repeat, which never outgrows ``BROADCAST_BYTES`` and so is
always broadcast; the more of them there are, the more unique rows it lets into the shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, boxed as box, join_groups, stage

BUCKET_BITS = 32768  # what bitmap_construct_agg gives
BITS_PER_ROW = 32
CELLS = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z as a-z, all else unchanged."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # lower() is far faster, and the same on these
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _cells(digest: Column) -> Column:
    """Distinct bit positions within the bucket, from the second to fourth quarter of a SHA-256 in hexadecimal."""
    part = lambda i: F.conv(F.substring(digest, 17 + 8 * i, 8), 16, 10).cast("long") % BUCKET_BITS
    return F.array_distinct(F.array(*[part(i) for i in range(CELLS)]))


def _bucket(digest: Column, buckets: int) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % buckets


def _bitmaps(cells: DataFrame) -> DataFrame:
    return stage(cells.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("cell")).alias("bitmap")), "exact-filter")


def _all_cells(hashes: DataFrame, digest: str, buckets: int) -> DataFrame:
    return hashes.select(_bucket(F.col(digest), buckets).alias("bucket"), F.explode(_cells(F.col(digest))).alias("cell"))


def repeat_filter(hashes: DataFrame, digest: str, rows: int) -> tuple[DataFrame, int]:
    """Pass one: (bucket, bitmap of the cells hit at least twice), and the number of buckets.

    Counts of cells are combined before the shuffle, so a text with a third of all rows arrives as a few sums.
    """
    buckets = max(1, -(-rows * BITS_PER_ROW // BUCKET_BITS))
    twice = _all_cells(hashes, digest, buckets).groupBy("bucket", "cell").agg(F.count("*").alias("hits")).where("hits > 1")
    return _bitmaps(twice), buckets


def member_filter(hashes: DataFrame, digest: str, rows: int) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of ``rows`` distinct digests, of at most ``BROADCAST_BYTES``, and the number of buckets."""
    most = max(1, BROADCAST_BYTES // (BUCKET_BITS // 8))
    buckets = min(most, max(1, -(-rows * BITS_PER_ROW // BUCKET_BITS)))
    return _bitmaps(_all_cells(hashes, digest, buckets).distinct()), buckets


def mark_possible(df: DataFrame, digest: str, bitmaps: DataFrame, buckets: int) -> DataFrame:
    """Pass two: adds ``possible``, false where the row's text certainly isn't in the filter."""
    if buckets * (BUCKET_BITS // 8) <= BROADCAST_BYTES:
        bitmaps = F.broadcast(bitmaps)
    byte = lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), (i / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.forall(_cells(F.col(digest)), lambda i: F.coalesce(F.getbit(byte(i), (i % 8).cast("int")) == 1, F.lit(False)))
    return (
        df.withColumn("bucket", _bucket(F.col(digest), buckets))
        .join(bitmaps, "bucket", "left")
        .withColumn("possible", F.coalesce(hit, F.lit(False)))
        .drop("bucket", "bitmap")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id`` (largest id among equal texts), ``group_size``, ``kept`` and
    ``text_sha256`` of the normalised text. Texts are equal when identical after lower-casing A-Z only.

    Null texts count as empty and are equal to empty ones. A null id loses to any other; a group of null ids only has a
    null ``keep_id``. Where rows repeat with text and id, exactly one of them is kept. Other columns are not read, so
    their names can't clash. An empty table gives an empty result.
    """
    thin = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()),
        "exact-hashes",
    )
    rows = thin.count()
    bitmaps, buckets = repeat_filter(thin, "text_sha256", rows)
    marked = mark_possible(thin, "text_sha256", bitmaps, buckets)
    alone = marked.where(~F.col("possible")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    maybe = marked.where("possible").drop("possible")
    # coalesce: a null id sorts below all others
    best = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("order"), F.col("row"), F.col("doc_id"))).alias("best")
    groups = maybe.groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))
    grouped = join_groups(maybe, groups, "text_sha256", "group_size", rows).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest id, and all its columns.

    Null texts count as empty, a null id loses to any other, an empty table stays empty, and columns may have any names. Of
    rows equal in text and id but not in other columns, the one whose JSON has the greatest hash stays. Unique rows pass
    straight through; of whole rows only those with a repeated text, and few others, are shuffled.
    """
    digest, boxed = "text_sha256", "row_values"
    hashed = docs.select(box(docs).alias(boxed), F.sha2(normalised(F.col(text_col)), 256).alias(digest))
    thin = stage(hashed.select(digest, F.col(f"{boxed}.`{id_col}`").alias("doc_id")), "exact-hashes")
    rows = thin.count()
    bitmaps, buckets = repeat_filter(thin, digest, rows)
    groups = mark_possible(thin, digest, bitmaps, buckets).where("possible").groupBy(digest).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(groups.where("group_size > 1"), "exact-groups")
    bitmaps, buckets = member_filter(groups, digest, groups.count())
    marked = mark_possible(hashed, digest, bitmaps, buckets)
    alone = marked.where(~F.col("possible")).select(boxed)
    maybe = marked.where("possible").drop("possible")
    # rows that only seem to repeat have no group, and stay
    known = stage(mark_possible(thin, digest, bitmaps, buckets).where("possible").groupBy(digest).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-known")
    won = join_groups(maybe, known, digest, "group_size", rows).where(F.col(f"{boxed}.`{id_col}`").eqNullSafe(F.col("keep_id")))
    # rows that repeat with their id: a partial aggregate leaves one a task before the shuffle
    one = won.groupBy(digest).agg(F.max_by(boxed, F.xxhash64(F.to_json(boxed))).alias(boxed)).select(boxed)
    return alone.unionByName(one).select(f"{boxed}.*")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
