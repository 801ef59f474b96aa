"""Texts whose sets of shingles are alike, by their exact Jaccard similarity.

Candidates come from the index that the caller brings (SimHash by positional bytes, see simhash_dedup.py), whose lists are
filtered by counts of matching bytes, and, for pairs that it can't promise to find, from min-wise hashes: ``BANDS`` keys of
``ROWS`` minima each. A pair of similarity s has none of these in common with probability (1 - s ** ROWS) ** BANDS, which is
5e-7 at 0.8 and less above. Keys of the index are not negative, those of minima are. Lists of a single set are dropped, and of
lists with the same members one stays. Sizes and parities of sets (see ``may_be_alike``) then rule out, exactly, most members
that are like no other in their list. Whole sets are made only for what is left and compared in the list, so that pairs
are never written: a list gives a spanning forest of its links. Lists with the same least member are compared in one place,
which gets each set once.

Lists over ``LIST`` sets are not compared pair by pair, as their pairs grow with the square of a group (see ``hubs``). Each
member is compared with the list's hub, the member that is in most long lists. Members like the hub are connected. Of any other,
most shingles that the hub doesn't have are rare: it can be like another member only if they share one of some of these, so
it meets others in the short lists of those. Only members for which that proves nothing are dealt out to tiles, with each other and the
hub's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, join_groups, stage, trim
from .hashing import U64, mix

SEED = 42
ROWS, BANDS = 6, 48
LIST = 512
#: A shingle that at most so many of a hub's members have is rare.
RARE = 32
#: Bytes that the prints of a pair from the index have in common, at least.
MATCHES = 4
_FACTORS = (mix(np.arange(1, ROWS * BANDS + 1, dtype=U64)) | U64(1)).astype(np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U64) << U64(32))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all words if they are fewer; repeats count."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - shingle + 1)
    lasts = ends[shingle - 1 :] or ends[-1:]
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[s : e - 1] for s, e in zip(starts, lasts)], repeat(SEED)), U64, n)


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes; an empty set has none."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    low = distinct.astype(np.uint32)
    least = np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(least, (low[at : at + 256, None] * _FACTORS).min(0), out=least)
    keys = _BAND
    for minima in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ minima.astype(U64))
    return (keys | U64(1 << 63)).view(np.int64)


def parity(distinct: np.ndarray) -> bytes:
    """Whether the number of hashes with the same low 10 bits is odd, a bit for each."""
    return np.packbits(np.bincount((distinct & U64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1).tobytes()


def may_be_alike(size_a: np.ndarray, size_b: np.ndarray, parity_a: np.ndarray, parity_b: np.ndarray, similarity: float) -> np.ndarray:
    """False where two sets certainly are below a similarity s: the smaller has less than s times the larger's size, or
    their parities (as rows of 64-bit words) differ in more bits than elements can be in one set only, which are
    (1 - s) / (1 + s) of both sizes at most."""
    sizes = np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) * (1 - 1e-9)
    apart = np.bitwise_count(parity_a ^ parity_b).sum(-1, dtype=np.int64)
    return sizes & (apart <= (1 - similarity) / (1 + similarity) * (size_a + size_b) * (1 + 1e-9))


def sketches(text: Column, shingle: int, index: Callable[[np.ndarray], tuple[int, np.ndarray]]) -> Column:
    """digest (128 bits, equal for equal sets), keys, size and parity of a text's set, and its print. ``index`` gives the
    print of a set that isn't empty and its keys in the index."""

    @F.arrow_udf("struct<digest: binary, keys: array<bigint>, size: int, parity: binary, print: bigint>")
    def made(texts: pa.Array) -> pa.Array:
        digests, keys, sizes, parities, prints = [], [], [], [], []
        for x in texts:
            distinct = np.unique(shingle_hashes(x.as_py(), shingle))
            digests.append(hashlib.md5(distinct.astype("<u8").tobytes()).digest())
            own, listed = index(distinct) if len(distinct) else (0, np.zeros(0, np.int64))
            prints.append(own)
            keys.append(np.concatenate([listed, band_keys(distinct)]))
            sizes.append(len(distinct))
            parities.append(parity(distinct))
        ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
        out = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(sizes, pa.int32()), pa.array(parities, pa.binary()), pa.array(prints, pa.int64())], names=["digest", "keys", "size", "parity", "print"])
        trim()
        return out

    return made(text)


def whole_sets(text: Column, shingle: int) -> Column:
    """Distinct hashes in order, eight bytes each."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        out = pa.array([np.unique(shingle_hashes(x.as_py(), shingle)).astype("<u8").tobytes() for x in texts], pa.binary())
        trim()
        return out

    return made(text)


def forest(sets: list[np.ndarray], similarity: float, hub: np.ndarray | None = None) -> np.ndarray:
    """The position of each set's root in a spanning forest of the links between sets with at least this Jaccard similarity. Those
    marked by ``hub`` are known to be connected."""
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])))
    ordered = [sets[i] for i in order]
    size = np.array([len(s) for s in ordered])
    parities = np.stack([np.frombuffer(parity(s), U64) for s in ordered])
    root = np.arange(len(sets))
    if hub is not None and hub.any():
        root[hub[order]] = np.flatnonzero(hub[order])[0]
    at, step = np.arange(len(sets) - 1), 1
    while len(at):
        at = at[size[at] >= similarity * size[at + step] * (1 - 1e-9)]  # sizes only grow with the step
        pair = at[root[at] != root[at + step]]
        pair = pair[may_be_alike(size[pair], size[pair + step], parities[pair], parities[pair + step], similarity)]
        for i in pair.tolist():
            a, b = root[i], root[i + step]
            if a != b:
                both = len(np.intersect1d(ordered[i], ordered[i + step], assume_unique=True))
                if both / (size[i] + size[i + step] - both) >= similarity:
                    root[root == max(a, b)] = min(a, b)
        step += 1
        at = at[at + step < len(sets)]
    out = np.empty(len(sets), np.int64)
    out[order] = order[root]
    return out


def with_partner(size: np.ndarray, parities: np.ndarray, similarity: float, prints: np.ndarray | None = None, hub: np.ndarray | None = None) -> np.ndarray:
    """Which members of a list may be like another one in it. In a list of the index, which has ``prints``, these are pairs with
    at least ``MATCHES`` of the eight bytes alike by position. Two that are marked by ``hub`` aren't asked about."""
    order = np.argsort(size, kind="stable")
    size, parities = size[order], parities[order]
    hub = np.zeros(len(size), bool) if hub is None else hub[order]
    planes = None if prints is None else np.ascontiguousarray(prints[order]).view(np.uint8).reshape(-1, 8)
    found = np.zeros(len(size), bool)
    at, step = np.arange(len(size) - 1), 1
    while len(at):
        at = at[size[at] >= similarity * size[at + step] * (1 - 1e-9)]
        pair = at[~(found[at] & found[at + step] | hub[at] & hub[at + step])]
        if planes is not None:
            pair = pair[(planes[pair] == planes[pair + step]).sum(1) >= MATCHES]
        pair = pair[may_be_alike(size[pair], size[pair + step], parities[pair], parities[pair + step], similarity)]
        found[pair] = found[pair + step] = True
        step += 1
        at = at[at + step < len(size)]
    out = np.empty(len(size), bool)
    out[order] = found
    return out


def candidate_lists(classes: DataFrame, limit: int = LIST) -> DataFrame:
    """(key, cls, n, least): the lists of two or more classes (cls, keys), n being the size and least the least class; one
    list of those with equal members. Lists of the index over ``limit`` are left out: a large group of near copies is in many,
    each with other members, and would be dealt out for each. Their pairs meet by min-wise keys, whose lists have no limit."""
    entries = classes.select("cls", F.explode("keys").alias("key"))
    # most keys are those of a single class: only counts are shuffled of them
    several = stage(entries.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1) & ((F.col("key") < 0) | (F.col("n") <= limit))), "shingle-several")
    if several.count() * 64 <= BROADCAST_BYTES:
        met = entries.join(F.broadcast(several), "key")
    else:
        met = join_groups(entries, several, "key", "n", classes.count() * BANDS)
    met = stage(met.select("key", "cls", "n"), "shingle-met")
    marks = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"m{i}") for i in range(2)]
    lists = met.groupBy("key").agg(F.first("n").alias("n"), F.min("cls").alias("least"), *marks)
    chosen = stage(lists.groupBy("n", "least", "m0", "m1").agg(F.min("key").alias("key")).select("key", "n", "least"), "shingle-lists")
    return stage(join_groups(met.drop("n"), chosen, "key", "n", met.count()), "shingle-entries")


def _runs(rows: pa.Table) -> tuple[pa.Table, zip]:
    """Rows sorted by key, and where each key's rows start and end."""
    rows = rows.sort_by("key").combine_chunks()
    key = rows.column("key").to_numpy()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return rows, zip(starts.tolist(), [*starts[1:].tolist(), len(key)])


def _spare(size: Column, smallest: Column, similarity: float) -> Column:
    """How many elements of a set of this size a set with at least this similarity and size ``smallest`` may be without."""
    other = F.greatest(smallest.cast("double"), size * similarity)
    return (size - F.ceil((size + other) * (similarity / (1 + similarity) * (1 - 1e-9)))).cast("int")


def _held(table: DataFrame, bytes_: int) -> DataFrame:
    return F.broadcast(table) if table.count() * bytes_ <= BROADCAST_BYTES else table


def hubs(lists: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lists (key, cls, n) come to without pairing their members: edges (a, b) to hubs, short lists (key, cls, least) by rare
    shingles, and (key, cls, hub, hubs, loose), by hub, where ``loose`` members are still to be compared with each other and the ``hubs`` like it.

    A member x that isn't like its hub has all its links in the short lists if more of its shingles are rare among the hub's members, and not the hub's, than
    x can spare: whatever is like x has one of any so many. Rows are as many as entries, pairs (member, hub) and their shingles beside the hub's.
    """
    inside = lists.groupBy("cls").agg(F.sum("n").alias("inside")).join(classes.select("cls", "row", "size"), "cls")
    members = stage(inside, "hub-members")
    hub = F.max_by("cls", F.struct("inside", -F.col("cls"))).alias("centre")
    centres = stage(lists.join(members, "cls").groupBy("key").agg(hub, F.min("size").alias("smallest"), F.count("*").alias("n")), "hub-centres")
    total = lists.count()
    if centres.count() * 64 <= BROADCAST_BYTES:
        listed = lists.select("key", "cls").join(F.broadcast(centres), "key")
    else:
        listed = join_groups(lists.select("key", "cls"), centres, "key", "n", total)
    listed = stage(listed.select("key", "cls", "centre", "smallest"), "hub-listed")
    pairs = listed.groupBy("cls", "centre").agg(F.min("smallest").alias("smallest"))
    sets = stage(texts.join(_held(members.select("cls", "row"), 32), "row").select("cls", whole_sets(F.col("text"), shingle).alias("elements")), "hub-sets")
    own = stage(sets.join(_held(centres.select(F.col("centre").alias("cls")).distinct(), 32), "cls").select(F.col("cls").alias("centre"), F.col("elements").alias("centres")), "hub-own")
    asked = pairs.join(sets, "cls")
    if own.agg(F.sum(F.length("centres"))).first()[0] <= BROADCAST_BYTES:
        asked = asked.join(F.broadcast(own), "centre")
    else:
        sizes = pairs.groupBy("centre").agg(F.count("*").alias("n"))
        asked = join_groups(asked, own.join(sizes, "centre"), "centre", "n", total)

    @F.arrow_udf("struct<size: int, hub: boolean, beside: array<bigint>>")
    def compared(sets: pa.Array, centres: pa.Array) -> pa.Array:
        sizes, hub, beside = [], [], []
        for x, y in zip(sets, centres):
            x, y = (np.frombuffer(z.as_py(), "<u8") for z in (x, y))
            rest = np.setdiff1d(x, y, assume_unique=True)
            both = len(x) - len(rest)
            sizes.append(len(x))
            hub.append(both / (len(x) + len(y) - both) >= similarity)
            beside.append(rest.view("<i8"))
        ends = np.cumsum([0, *map(len, beside)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *beside])))
        out = pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(hub, pa.bool_()), lists], names=["size", "hub", "beside"])
        trim()
        return out

    met = stage(asked.select("cls", "centre", "smallest", compared("elements", "centres").alias("c")).select("cls", "centre", "smallest", "c.*"), "hub-met")
    edges = met.where("hub and cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b"))
    elements = met.select("cls", "centre", F.explode("beside").alias("element"))
    often = stage(elements.groupBy("centre", "element").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("centre", "element"), "hub-often")
    rare = elements.join(_held(often, 64), ["centre", "element"], "left_anti")
    shared = stage(rare.groupBy("centre", "element").agg(F.array_sort(F.collect_list("cls")).alias("members")), "hub-shared")
    each = shared.select(F.explode("members").alias("cls"), "centre", F.struct(F.size("members").alias("n"), "element").alias("x"))
    rarest = each.groupBy("cls", "centre").agg(F.array_sort(F.collect_list("x")).alias("rarest"))
    apart = met.where("not hub").select("cls", "centre", _spare(F.col("size"), F.col("smallest"), similarity).alias("spare")).join(rarest, ["cls", "centre"])
    settled = stage(apart.where("size(rarest) > spare").select("cls", "centre", F.slice("rarest", 1, F.col("spare") + 1).alias("rarest")), "hub-settled")

    wanted = settled.select("centre", F.explode("rarest").alias("x")).where("x.n > 1").select("centre", "x.element").distinct()
    short = shared.join(wanted, ["centre", "element"], "left_semi").groupBy("members").agg(F.min(F.struct("centre", "element")).alias("x"))
    key = F.xxhash64("x.centre", "x.element").bitwiseOR(F.lit(-(2**63)))  # not one of the index
    short = short.select(key.alias("key"), F.array_min("members").alias("least"), F.explode("members").alias("cls"))

    # lists of one hub have much the same members, so these meet once and not in each
    code = F.xxhash64("centre").bitwiseOR(F.lit(-(2**63)))
    open_ = stage(met.join(settled.select("cls", "centre"), ["cls", "centre"], "left_anti").select(code.alias("key"), "cls", "hub"), "hub-open")
    sums = open_.groupBy("key").agg(F.sum(F.col("hub").cast("long")).alias("hubs"), F.sum((~F.col("hub")).cast("long")).alias("loose"), F.count("*").alias("n")).where("loose > 0")
    return edges, short, join_groups(open_, stage(sums, "hub-sums"), "key", "n", total).drop("n")


def tiles(lists: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, limit: int = LIST) -> tuple[DataFrame | None, DataFrame]:
    """Edges known from hubs (None without long lists), and the members to be compared: (lot, i, j, key, cls, hub), a list's rows in a tile (lot, i, j)
    being compared but for two marked by ``hub``."""
    zero = F.lit(0).cast("long")
    whole = ("lot", zero.alias("i"), zero.alias("j"), "key", "cls", F.lit(False).alias("hub"))
    short = lists.where(F.col("n") <= limit).withColumn("lot", F.col("least")).select(*whole)
    long_ = lists.where(F.col("n") > limit)
    if long_.isEmpty():
        return None, short
    edges, rare, left = hubs(long_.select("key", "cls", "n"), classes, texts, shingle, similarity)
    short = short.unionByName(rare.withColumn("lot", F.col("least")).select(*whole))
    # tiles (i, j) of two parts of the loose members, (i, -j) of a part of them and the j-th part of the hub's
    cut = left.withColumns({"of_loose": F.ceil(F.col("loose") / limit), "of_hubs": F.ceil(F.col("hubs") / limit)})
    cut = cut.withColumn("part", F.pmod(F.xxhash64("cls"), F.when(F.col("hub"), F.col("of_hubs")).otherwise(F.col("of_loose"))))
    others = F.sequence(zero, F.col("of_loose") - 1)
    loose = cut.where("not hub").withColumn("other", F.explode(F.concat(others, F.when(F.col("of_hubs") > 0, F.sequence(-F.col("of_hubs"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")))))
    met = F.col("other") < 0
    loose = loose.select(F.col("key").alias("lot"), F.when(met, F.col("part")).otherwise(F.least("part", "other")).alias("i"), F.when(met, F.col("other")).otherwise(F.greatest("part", "other")).alias("j"), "key", "cls", "hub")
    hub = cut.where("hub").withColumn("i", F.explode(others)).select(F.col("key").alias("lot"), "i", (-1 - F.col("part")).alias("j"), "key", "cls", "hub")
    return edges, short.unionByName(loose).unionByName(hub)


def links(classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, limit: int = LIST) -> DataFrame:
    """Edges (a, b) that connect all classes (cls, keys, row, size, parity and, if keys are of an index too, print) whose shingle
    sets meet in a list, in one of the index with ``MATCHES`` bytes, and have at least this similarity. ``texts`` (row, text)
    has a text of each class."""
    known = classes if "print" in classes.columns else classes.withColumn("print", F.lit(0).cast("long"))
    edges, placed = tiles(candidate_lists(classes, limit), classes, texts, shingle, similarity, limit)
    placed = placed.join(known.select("cls", "size", "parity", "print"), "cls")

    def narrowed(rows: pa.Table) -> pa.Table:
        rows, runs = _runs(rows)
        size = rows.column("size").to_numpy().astype(np.int64)
        parities = np.frombuffer(b"".join(rows.column("parity").to_pylist()), U64).reshape(len(size), 16)
        indexed, prints = rows.column("key").to_numpy() >= 0, rows.column("print").to_numpy()
        hub = rows.column("hub").to_numpy()
        keep = np.concatenate([np.zeros(0, bool), *[with_partner(size[a:b], parities[a:b], similarity, prints[a:b] if indexed[a] else None, hub[a:b]) for a, b in runs]])
        return rows.select(["lot", "i", "j", "key", "cls", "hub"]).filter(pa.array(keep))

    left = stage(placed.groupBy("lot", "i", "j").applyInArrow(narrowed, "lot long, i long, j long, key long, cls long, hub boolean"), "shingle-left")
    few = stage(left.select("cls").distinct().join(classes.select("cls", "row"), "cls"), "shingle-classes")
    few = F.broadcast(few) if few.count() * 32 < BROADCAST_BYTES else few
    sets = stage(texts.join(few, "row").select("cls", whole_sets(F.col("text"), shingle).alias("elements")), "shingle-sets")
    sent = stage(left.select("lot", "i", "j", "cls").distinct(), "shingle-sent").join(sets, "cls")

    def tile(rows: pa.Table, sent: pa.Table) -> pa.Table:
        rows, runs = _runs(rows)
        cls, hub = rows.column("cls").to_numpy(), rows.column("hub").to_numpy()
        elements = {c: np.frombuffer(x.as_py(), "<u8").astype(U64) for c, x in zip(sent.column("cls").to_pylist(), sent.column("elements"))}
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in runs:
            root = forest([elements[c] for c in cls[start:end].tolist()], similarity, hub[start:end])
            linked = np.flatnonzero(root != np.arange(end - start))
            a.append(cls[start:end][linked])
            b.append(cls[start:end][root[linked]])
        del elements
        trim()
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    found = left.groupBy("lot", "i", "j").cogroup(sent.groupBy("lot", "i", "j")).applyInArrow(tile, "a long, b long")
    return found if edges is None else found.unionByName(edges)
