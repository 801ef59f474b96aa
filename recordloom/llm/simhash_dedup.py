"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Texts become fingerprints of 64 bits. Two fingerprints that differ in at most d bits differ in at most d of their eight
bytes, so at least 8 - d bytes match by position. The index lists fingerprints by positional bytes. A list for one byte
would hold a 256th of the corpus, so lists are intersected beforehand: an entry is a triple of positional bytes, for
twenty triples of positions chosen so that any four matching positions contain one of them, at every size. For the pairs
that meet in a list, matching bytes are tallied position by position, pairs below the guaranteed minimum are dropped, and
only the others are verified by their differing bits.

Equal fingerprints are one class from the start. A list's pairs are compared in place and never written: the list gives
a spanning forest of its links, which is all that connected components need. Lists over ``LIST`` classes are dealt
out to tiles, each of which compares two parts of the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed as box, join_groups, stage, trim
from .components import components
from .exact_dedup import mark_possible, member_filter
from .hashing import U64, mix
from .shingle_sets import MATCHES, links as alike, shingle_hashes, sketches

LIST = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8) * 256


def _print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of some hashes, eight bytes from the lowest on: a bit is set where it is in over half of them."""
    table = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((2 * (table @ _BITS) > len(hashes)).ravel(), bitorder="little")


def simhash(text: str | None, shingle: int, count: int = 1) -> list[int]:
    """``count`` fingerprints as signed 64-bit numbers. A bit is set where it is in over half of the hashes of the text's
    shingles, repeats counted. The first takes XXH64 itself, others remix it."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return [0] * count
    out = []
    for i in range(count):
        h = hashes if i == 0 else mix(hashes + U64(i * 0x9E3779B97F4A7C15 % 2**64))
        out.append(int(_print(h).view("<i8")[0]))
    return out


def fingerprints(text: Column, shingle: int, count: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def made(texts: pa.Array) -> pa.Array:
        out = pa.array([simhash(x.as_py(), shingle, count) for x in texts], pa.list_(pa.int64()))
        trim()
        return out

    return made(text)


def byte_sets(matches: int) -> list[tuple[int, ...]]:
    """Sets of three positions (fewer, where fewer bytes need match) such that any ``matches`` of the eight contain one. For
    four matches the cyclic construction on groups of 3, 3 and 2 positions will do: triples within a group, or two of a group
    and one of the next."""
    if matches < 4:
        return list(combinations(range(8), matches))
    group = lambda i: min(i // 3, 2)
    chosen = []
    for t in combinations(range(8), 3):
        n = [sum(group(i) == g for i in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(t)
    return chosen


def _keys(fingerprint: Column, sets: list[tuple[int, ...]], table: int) -> list[Column]:
    byte = lambda i: F.shiftright(fingerprint, 8 * i).bitwiseAND(F.lit(255))
    out = []
    for n, places in enumerate(sets):
        key = F.lit(table + n).cast("long")
        for i in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte(i))
        out.append(key)
    return out


_SETS = np.array(byte_sets(MATCHES)).T


def indexed(distinct: np.ndarray) -> tuple[int, np.ndarray]:
    """The fingerprint of a set of shingles' hashes and its keys in the index, one for each set of positions. Fingerprints with
    ``MATCHES`` bytes alike share a key."""
    bits = _print(distinct)
    a, b, c = bits.astype(np.int64)[_SETS]
    return int(bits.view("<i8")[0]), np.arange(len(a)) << 24 | a << 16 | b << 8 | c


def _forest(runs: np.ndarray, prints: np.ndarray, matches: int, bits: int) -> np.ndarray:
    """For rows sorted by run: the position of each row's root in a spanning forest of the links within runs."""
    n = len(runs)
    root = np.arange(n)
    planes = np.ascontiguousarray(prints).view(np.uint8).reshape(n, prints.shape[1], 8)
    last = np.searchsorted(runs, runs, "right") - 1
    at, step = np.flatnonzero(last > np.arange(n)), 1
    while len(at):
        pair = at[root[at] != root[at + step]]  # what is connected needs no comparison
        if len(pair):
            tally = np.zeros((len(pair), prints.shape[1]), np.int8)  # shared positional bytes, by fingerprint
            for place in range(8):
                tally += planes[pair, :, place] == planes[pair + step, :, place]
            pair = pair[tally.max(1) >= matches]
            linked = pair[np.bitwise_count(prints[pair] ^ prints[pair + step]).sum(1) <= bits]
            for i in linked.tolist():
                a, b = i, i + step
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(linked):
                while (root != root[root]).any():
                    root = root[root]
        step += 1
        at = at[last[at] >= at + step]
    return root


def _links(key: np.ndarray, cls: np.ndarray, prints: np.ndarray, matches: int, bits: int, limit: int) -> pa.RecordBatch:
    """Edges (a, b) of the forest; for rows of a list over ``limit``, a row (a, null) instead, to be dealt out."""
    runs, sizes = np.unique(key, return_inverse=True, return_counts=True)[1:]
    long_ = sizes[runs] > limit
    some = np.flatnonzero((sizes[runs] > 1) & ~long_)
    root = _forest(runs[some], prints[some], matches, bits)
    linked = np.flatnonzero(root != np.arange(len(some)))
    a = np.concatenate([cls[some][linked], cls[long_]])
    b = np.concatenate([cls[some][root[linked]], cls[long_]])
    k = np.concatenate([key[some][linked], key[long_]])
    dealt = np.arange(len(a)) >= len(linked)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(a), pa.array(b, mask=dealt)], names=["key", "a", "b"])


def _columns(batch, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, cls = (np.asarray(batch.column(x).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(x).to_numpy()) for x in ("key", "cls"))
    prints = np.stack([np.asarray(batch.column(f"f{i}").to_numpy()) for i in range(count)], axis=1).view(U64)
    return key, cls, prints


def _scan(count: int, matches: int, bits: int, limit: int):
    """Reads rows sorted by key, list by list. Of a list over ``limit``, only what has come since the last batch is held."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        flooded = None  # the key of a list that is over the limit already
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _columns(batch, count)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            key, cls, prints = now
            if flooded is not None:
                n = int(np.searchsorted(key, flooded, "right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(key[:n]), pa.array(cls[:n]), pa.nulls(n, pa.int64())], names=["key", "a", "b"])
                    key, cls, prints = key[n:], cls[n:], prints[n:]
                if not len(key):
                    held = None
                    continue
                flooded = None
            start = int(np.searchsorted(key, key[-1]))
            if len(key) - start > limit:  # goes on, but is long enough to know
                flooded, start, held = key[-1], len(key), None
            else:
                held = (key[start:], cls[start:], prints[start:])
            if start:
                yield _links(key[:start], cls[:start], prints[:start], matches, bits, limit)
        if held is not None and len(held[0]):
            yield _links(*held, matches, bits, limit)

    return scan


def links(classes: DataFrame, count: int, bits: int, matches: int, limit: int = LIST) -> DataFrame:
    """Edges (a, b) between classes (cls, prints) that connect all whose fingerprints meet in the index with at least
    ``matches`` bytes in one of them and differ in ``bits`` at most over all of them."""
    sets = byte_sets(matches)
    prints = [F.col("prints")[i].alias(f"f{i}") for i in range(count)]
    keys = [k for i in range(count) for k in _keys(F.col("prints")[i], sets, i * len(sets))]
    entries = classes.select("cls", *prints, F.explode(F.array(*keys)).alias("key"))
    lists = entries.repartition("key").sortWithinPartitions("key")
    names = [f"f{i}" for i in range(count)]
    found = stage(lists.select("key", "cls", *names).mapInArrow(_scan(count, matches, bits, limit), "key long, a long, b long"), "simhash-links")
    dealt = found.where("b is null").select("key", F.col("a").alias("cls"))
    short = found.where("b is not null").select("a", "b")
    if dealt.isEmpty():
        return short
    sizes = dealt.groupBy("key").agg(F.ceil(F.count("*") / limit).alias("parts"), F.count("*").alias("n"))
    parts = join_groups(dealt, sizes, "key", "n", dealt.count()).drop("n").join(classes, "cls").withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
    tiles = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = tiles.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cls", *prints)

    def tile(rows: pa.Table) -> pa.Table:
        key, cls, prints = _columns(rows, count)
        root = _forest(np.zeros(len(key), np.int64), prints, matches, bits)
        linked = np.flatnonzero(root != np.arange(len(key)))
        return pa.table([pa.array(cls[linked]), pa.array(cls[root[linked]])], names=["a", "b"])

    return short.unionByName(tiles.groupBy("key", "i", "j").applyInArrow(tile, "a long, b long"))


def near_groups(docs: DataFrame, shingle: int = 4, bits: int = 4, count: int = 1, matches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, prints (its ``count`` fingerprints), component_id (the smallest doc_id reachable
    over links), kept (true for one row of each component, that of the smallest doc_id) and text_hash.

    Fingerprints link at ``bits`` or fewer differing bits. With one fingerprint, and ``bits`` up to 4, no link is missed:
    ``matches`` is then 8 - bits, what such a link guarantees. With more fingerprints the index finds pairs with at least
    ``matches`` bytes alike in one of them, and ``bits`` counts over all. Null, empty and blank texts have fingerprint
    zero and link like any other. Ids may repeat, rows are told apart; null ids are ignored by component_id, which is
    null where there is no other. Other columns aren't read.
    """
    if matches is None:
        matches = 8 - bits
    if matches < 3 or (matches < 4 and count == 1):
        raise ValueError("the index needs at least four matching bytes, or three in one of several fingerprints")
    text = F.col(text_col)
    made = docs.select(F.col(id_col).alias("doc_id"), fingerprints(text, shingle, count).alias("prints"), F.xxhash64(text).alias("text_hash"))
    rows = stage(made.withColumn("row", F.monotonically_increasing_id()), "simhash-prints")
    total = rows.count()
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best")
    classes = stage(rows.groupBy("prints").agg(best, F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "simhash-classes")
    return _grouped(rows, classes, links(classes.select("cls", "prints"), count, bits, matches), "prints", total)


def _grouped(rows: DataFrame, classes: DataFrame, edges: DataFrame, by: str, total: int) -> DataFrame:
    """Rows with the component of their class, classes being told apart by column ``by``."""
    roots = components(edges)
    rooted = stage(classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "simhash-roots")
    whole = rooted.groupBy("root").agg(F.min("best").alias("whole"), F.count("*").alias("classes"))
    grouped = join_groups(rooted, whole, "root", "classes", total).select(by, "n", "whole")
    return join_groups(rows, grouped, by, "n", total).select(
        "doc_id", by, F.col("whole.doc_id").alias("component_id"), (F.col("row") == F.col("whole.row")).alias("kept"), "text_hash"
    )


def alike_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``near_groups``, but texts that the index brings together link where the Jaccard similarity of their whole sets of
    shingles is at least ``similarity``; has digest, that of the set, in place of prints. Repeats of a shingle count once, in
    fingerprints too. Min-wise keys find the pairs whose fingerprints have fewer than ``MATCHES`` bytes in common. Texts
    without words are alike, and like no other."""
    text = F.col(text_col)
    made = docs.select(F.col(id_col).alias("doc_id"), sketches(text, shingle, indexed).alias("sketch"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = stage(made.select("doc_id", "sketch.*", "text_hash", "text").withColumn("row", F.monotonically_increasing_id()), "shingle-rows")
    texts, rows, keys = rows.select("row", "text"), rows.select("doc_id", "digest", "text_hash", "row"), rows.select("row", "keys", "size", "parity", "print")
    total = rows.count()
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best")
    classes = stage(rows.groupBy("digest").agg(best, F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "simhash-classes")
    keyed = stage(classes.select("cls", F.col("best.row").alias("row")).join(keys, "row"), "shingle-keys")
    return _grouped(rows, classes, alike(keyed, texts, shingle, similarity), "digest", total)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest id, and all its columns.

    Unlike ``near_groups`` this verifies what the index finds by similarity, see ``alike_groups``. Rows that repeat whole, id included, stay or go
    together. Null and blank texts are near copies of each other; columns may have any names; an empty table stays empty.
    """
    groups = stage(alike_groups(docs, shingle, similarity, id_col, text_col), "simhash-groups")
    # of equal (id, text), none goes if one stays
    stays = F.max(F.col("kept").cast("int"))
    gone = groups.groupBy("doc_id", "text_hash").agg(stays.alias("stays")).where("stays = 0").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    # rows that don't pass the filter of those that go, of fixed size, stay where they are
    code = lambda i, h: F.md5(F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("")), h.cast("string")).cast("binary"))
    gone = stage(gone.withColumn("code", code(F.col("gone_id"), F.col("gone_hash"))), "simhash-gone")
    bitmaps, buckets = member_filter(gone, "code", gone.count())
    own = docs.select(box(docs).alias("row_values"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_hash"))
    marked = mark_possible(own.withColumn("own_code", code(F.col("own_id"), F.col("own_hash"))), "own_code", bitmaps, buckets)
    goes = (F.col("own_code") == F.col("code")) & F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash"))
    kept = marked.where("possible").join(gone, goes, "left_anti")
    return marked.where(~F.col("possible")).select("row_values.*").unionByName(kept.select("row_values.*"))


def table(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"), "component_id")
