"""Removal of long passages that repeat, by compacted paths of a de Bruijn graph.

The graph's edges are the k-mers of the corpus, windows of ``k`` successive words; its nodes are (k-1)-mers, an edge leading
from its first k-1 words to its last. An edge is repeated if its k-mer starts at two places or more, and every word that a
repeated edge covers is removed. Only repeated edges make it into the graph:

1. A document's edges are cut into pieces, a piece being a run of successive edges with the same minimizer (the least hash,
   by its upper 43 bits, of a short run of words within the window, the leftmost on a tie). As a k-mer decides its minimizer, equal edges are in
   pieces of equal minimizers, and those of a minimizer that occurs once, most of them, are unrepeated.
2. Where all pieces of a minimizer are equal, the piece is a path that doesn't branch: it enters the graph as one compact
   edge. Where they differ, the graph branches within them, and they enter it edge by edge.
3. Nodes count what enters and what leaves them; where more than one item does, the graph forks.
4. What repeats, and the forks on its way, are joined back to their blocks. There it is looked for by a rolling hash and
   verified by a 128-bit digest of the very words at its source coordinates, and items that follow each other through nodes
   that don't fork are compacted into one path, a span of words. Spans are what is removed.

Work and shuffle are linear in the text: nothing is paired, and counts are combined by block before the shuffle. Blocks hold
words, not texts (see blocks.py). Equality is that of 128-bit digests of words; rolling hashes only choose what to look at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import BROADCAST_BYTES, WORD, join_groups, stage, trim
from .exact_dedup import mark_possible, member_filter
from .hashing import U64, is_in, mix, rolling, rollings, signed, sliding_min, unsigned

K = 35
SUB = 8
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACES = 1 << 14
#: A place in a range and the window after it.
_PLACE_BITS = U64(21)
_PLACE = U64((1 << 21) - 1)
ITEM = "roll long, digest binary, src long, dst long, edges int, block long, n long"


@dataclass
class Pieces:
    """The pieces of a range of a block's documents: first and last edge, minimizer, rolling hash; and hashes of all edges
    and nodes."""

    words: list[bytes]
    part: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray
    roll: np.ndarray
    edges: np.ndarray
    nodes: np.ndarray
    _text: tuple[memoryview, np.ndarray] | None = None

    def digests(self, first: np.ndarray, size: np.ndarray | int) -> list[bytes]:
        """128-bit digests of the words from each ``first`` on, ``size`` of them."""
        if self._text is None:
            own = [self.words[c] for c in self.part.tolist()]
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)])
            self._text = memoryview(b" ".join(own)), ends
        text, ends = self._text
        return [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(ends[first].tolist(), (ends[first + size] - 1).tolist())]


def leftmost_least(seeds: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every ``width`` successive seeds is, the leftmost on a tie. Seeds are below 2^43: by ranges of
    ``_PLACES``, seed and place fit in one number, however long the text, and nothing is sorted."""
    out = []
    for at in range(0, max(0, len(seeds) - width + 1), _PLACES):
        part = seeds[at : at + _PLACES + width - 1]
        least = sliding_min(part << _PLACE_BITS | np.arange(len(part), dtype=U64), width)
        out.append(at + signed(least & _PLACE))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _hashes(h: tuple[np.ndarray, np.ndarray], k: int, sub: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all edges and nodes (none without ``whole``) and of all runs of ``sub`` words, by ranges that a processor's cache holds."""
    n = len(h[0])
    edges, nodes, seeds = (np.zeros(max(0, n - size + 1) * there, U64) for size, there in ((k, whole), (k - 1, whole), (sub, True)))
    for at in range(0, n, _PLACES):
        first, second = (x[at : at + _PLACES + k - 1] for x in h)
        if whole and k > 1:
            edge, node, seed = rollings(first, (k, k - 1, sub), _BASES[0])
            node = mix(node + mix(rolling(second, k - 1, _BASES[1])))
            edges[at : at + _PLACES], nodes[at : at + _PLACES] = edge[:_PLACES], node[:_PLACES]
        else:
            seed = rolling(first, sub, _BASES[0])
            if whole:  # nodes of no words are all alike
                edges[at : at + _PLACES] = rolling(first, k, _BASES[0])[:_PLACES]
        seeds[at : at + _PLACES] = mix(seed[:_PLACES])
    return edges, nodes, seeds


def _pieces(words: list[bytes], part: np.ndarray, h: tuple[np.ndarray, np.ndarray], ends: np.ndarray, k: int, sub: int, whole: bool = True) -> Pieces:
    """h: both hashes of each word; ends: of the documents, from 0. Without ``whole``, pieces have their minimizers only."""
    none = np.zeros(0, U64)
    edges, nodes, seeds = _hashes(h, k, sub, whole)
    place = leftmost_least(seeds >> _PLACE_BITS, k - sub + 1)
    starts = np.arange(len(place))
    starts = starts[starts + k <= np.repeat(ends[1:], np.diff(ends))[: len(starts)]]
    place = place[starts]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    at = np.concatenate([[0], cut]) if len(starts) else cut
    to = np.concatenate([cut, [len(starts)]]) - 1 if len(starts) else cut
    first, last = starts[at], starts[to]
    # first and last edge overlap, so they tell the whole piece
    if not whole:
        return Pieces(words, part, first, last, seeds[place[at]], none, none, none)
    roll = mix(edges[first] * U64(0xA24BAED4963EE407) + edges[last] * U64(0x9FB21C651E98DF25) + (last - first).astype(U64))
    return Pieces(words, part, first, last, seeds[place[at]], roll, edges, nodes)


def _each(row: dict, k: int, sub: int, whole: bool = True) -> Iterator[tuple[int, int, Pieces]]:
    """Pieces of a block, by ranges of documents that bound the memory."""
    words, codes, ends = blocks.block_words(row)
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    both = tuple(np.ascontiguousarray(digest[:, i]) for i in (0, 1))
    for a, b in blocks.doc_chunks(ends):
        part = codes[ends[a] : ends[b]]
        trim()
        yield a, b, _pieces(words, part, (both[0][part], both[1][part]), ends[a : b + 1] - ends[a], k, sub, whole)


def _spread(p: Pieces, chosen: np.ndarray) -> np.ndarray:
    """Starts of all edges of the chosen pieces."""
    first, n = p.first[chosen], p.last[chosen] - p.first[chosen] + 1
    total = np.cumsum(n)
    return np.repeat(first - (total - n), n) + np.arange(int(n.sum()))


class _Items:
    """Distinct items of a block by digest, with how often they occur."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, p: Pieces, digests: list[bytes], roll: np.ndarray, src: np.ndarray, dst: np.ndarray, edges: np.ndarray, least: np.ndarray) -> None:
        halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        self.parts.append((halves, signed(roll), signed(src), signed(dst), edges.astype(np.int32), signed(least)))

    def table(self, block: int, with_least: bool) -> pa.Table:
        empty = (np.zeros((0, 2), np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.int32), np.zeros(0, np.int64))
        halves, *columns = (np.concatenate(x) for x in zip(empty, *self.parts))
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        ordered = halves[order]
        starts = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(1)]) if len(order) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(order)))
        at = order[starts]
        roll, src, dst, edges, least = (pa.array(np.ascontiguousarray(c[at])) for c in columns)
        digest = pa.Array.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(np.ascontiguousarray(halves[at]).tobytes())]).cast(pa.binary())
        made = [roll, digest, src, dst, edges, pa.array(np.full(len(at), block, np.int64)), pa.array(counts.astype(np.int64))]
        names = [x.split()[0] for x in ITEM.split(", ")]
        return pa.table([*made, least], names=[*names, "least"]) if with_least else pa.table(made, names=names)


def _number(block: pa.Table) -> int:
    return block.column("block")[0].as_py() if len(block) else 0


def branching_nodes(items: DataFrame) -> DataFrame:
    """Nodes that more than one of the distinct items (digest, src, dst) enters or leaves. All others are inside of a path, or
    at its end."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = items.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.out").alias("out"), F.sum("x.in").alias("in"))
    return nodes.where((F.col("out") > 1) | (F.col("in") > 1)).select("node")


def repeated_spans(docs: DataFrame, k: int = K, sub: int = SUB, id_col: str = "doc_id", text_col: str = "text", block_words: int = blocks.BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (spans of words: first, words), kept, the other words with a
    space between, and paths, the compact paths of the graph that it walks, in order, each told by its first item.

    A word is removed if a window of ``k`` words over it also starts elsewhere, in this or any other document, as judged
    on the input. Null texts have no words, texts of under ``k`` words lose none, texts may be of any length. Ids become longs
    (null, where they can't) and may be null or repeat: rows that repeat whole are copies of each other, and lose all that a
    window covers. An empty table gives none. Other columns aren't read.
    """
    if not 1 <= sub <= k:
        raise ValueError("sub must be from 1 to k")
    packed = blocks.pack(docs, "span-blocks", id_col, text_col, block_words)
    by_block = packed.groupBy("block")

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = [p.least for *_, p in _each(row, k, sub, False)]
                least, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
                yield from pa.table([pa.array(signed(least)), pa.array(np.full(len(least), row["block"])), pa.array(n)], names=["least", "block", "n"]).to_batches(1 << 16)

    seeds = stage(packed.select("block", "doc_words", "words", "codes").mapInArrow(minimizers, "least long, block long, n long"), "span-seeds")
    again = seeds.groupBy("least").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("all > 1").drop("all")
    wanted = join_groups(seeds, again, "least", "rows", seeds.count()).select("block", "least")

    def contents(seeds: pa.Table, block: pa.Table) -> pa.Table:
        wanted, items = unsigned(seeds.column("least")), _Items()
        for row in block.to_pylist() if len(wanted) else []:
            for *_, p in _each(row, k, sub):
                i = np.flatnonzero(is_in(p.least, wanted))
                first, last = p.first[i], p.last[i]
                items.add(p, p.digests(first, last - first + k), p.roll[i], p.nodes[first], p.nodes[last + 1], last - first + 1, p.least[i])
        return items.table(_number(block), True)

    def told(name: str) -> Column:  # the words tell the rest
        return F.first(name).alias(name)

    pieces = stage(wanted.groupBy("block").cogroup(by_block).applyInArrow(contents, f"{ITEM}, least long"), "span-pieces")
    same = stage(pieces.groupBy("digest").agg(F.sum("n").alias("all"), F.count("*").alias("rows"), *map(told, ("src", "dst", "edges", "least"))), "span-same")
    kinds = same.groupBy("least").agg(F.count("*").alias("kinds"))
    known = stage(join_groups(same, kinds, "least", "kinds", same.count()), "span-known")
    branching = join_groups(pieces.select("digest", "block", "least"), known.where("kinds > 1").select("digest", "rows"), "digest", "rows", pieces.count()).select("block", "least").distinct()

    def opened(branching: pa.Table, block: pa.Table) -> pa.Table:
        wanted, items = unsigned(branching.column("least")), _Items()
        for row in block.to_pylist() if len(wanted) else []:
            for *_, p in _each(row, k, sub):
                at = _spread(p, np.flatnonzero(is_in(p.least, wanted)))
                items.add(p, p.digests(at, k), p.edges[at], p.nodes[at], p.nodes[at + 1], np.ones(len(at), np.int64), np.zeros(len(at), U64))
        return items.table(_number(block), False)

    edges = stage(branching.groupBy("block").cogroup(by_block).applyInArrow(opened, ITEM), "span-edges")
    totals = stage(edges.groupBy("digest").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("all > 1").select("digest", "rows"), "span-totals")
    # most edges are unrepeated and don't pass a filter of fixed size; only the rest is shuffled with all that it carries
    code = F.lower(F.hex("digest"))
    bitmaps, buckets = member_filter(totals.select(code.alias("code")), "code", totals.count())
    possible = mark_possible(edges.withColumn("code", code), "code", bitmaps, buckets).where("possible")
    carried = ("digest", "roll", "src", "dst", "block")
    single = stage(join_groups(possible.select(*carried), totals, "digest", "rows", edges.count()).select(*carried), "span-single")
    once = known.where("kinds = 1 and all > 1").select("digest", "rows", "src", "dst")
    whole = join_groups(pieces.select("digest", "roll", "block"), once.select("digest", "rows"), "digest", "rows", pieces.count()).select("block", "roll", "digest", F.lit(True).alias("whole"))
    items = once.select("digest", "src", "dst").unionByName(single.groupBy("digest").agg(*map(told, ("src", "dst"))))
    forks = stage(branching_nodes(items), "span-forks")
    forks = F.broadcast(forks) if forks.count() * 48 <= BROADCAST_BYTES else forks
    met = single.select("block", F.col("src").alias("node")).unionByName(join_groups(pieces.select("digest", "block"), once.select("digest", "rows", "src"), "digest", "rows", pieces.count()).select("block", F.col("src").alias("node")))
    forked = met.join(forks, "node").distinct().select("block", F.col("node").alias("roll"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("boolean").alias("whole"))
    repeated = whole.unionByName(single.select("block", "roll", "digest", F.lit(False).alias("whole"))).unionByName(forked)

    spans = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", spans), ("kept", pa.string()), ("paths", pa.list_(pa.int64()))])

    def removed(repeated: pa.Table, block: pa.Table) -> pa.Table:
        rolls, kinds, batches = unsigned(repeated.column("roll")), repeated.column("whole").to_pylist(), []
        kinds = np.array([2 if x is None else int(x) for x in kinds], np.int8)
        known = {d for d in repeated.column("digest").to_pylist() if d is not None}
        for row in block.to_pylist():
            words, doc_ids, counts = [w.decode() for w in blocks.words_of(row["words"])], row["doc_ids"], row["doc_words"]
            for a, b, p in _each(row, k, sub):
                compact = is_in(p.roll, rolls[kinds == 1])
                i = np.flatnonzero(compact)
                at = _spread(p, np.flatnonzero(~compact))
                at = at[is_in(p.edges[at], rolls[kinds == 0])]
                first = np.concatenate([p.first[i], at])
                size = np.concatenate([p.last[i] - p.first[i] + 1, np.ones(len(at), np.int64)])
                # by the words that are there: what only its rolling hash brought here is no repeat
                digests = p.digests(first, size + k - 1)
                good = np.array([d in known for d in digests], bool)
                order = np.flatnonzero(good)[np.argsort(first[good], kind="stable")]
                first, size = first[order], size[order]
                # a path goes on where the next item starts at the node that the last one ends in, and nothing forks there
                turn = np.ones(len(order), bool)
                turn[1:] = (first[1:] != first[:-1] + size[:-1]) | is_in(p.nodes[first[1:]], rolls[kinds == 2])
                path = np.array([int.from_bytes(digests[j][:8], "little", signed=True) for j in order[turn].tolist()], np.int64)
                starts = np.flatnonzero(turn)
                ends = np.concatenate([starts[1:], [len(order)]]) - 1 if len(order) else starts
                step = np.zeros(len(p.part) + 1, np.int64)
                np.add.at(step, first[starts], 1)
                np.add.at(step, first[ends] + size[ends] - 1 + k, -1)
                gone = np.cumsum(step[:-1]) > 0
                rows, place = [], 0
                for j in range(a, b):
                    mine, mask = p.part[place : place + counts[j]], gone[place : place + counts[j]]
                    x, y = np.searchsorted(first[starts], [place, place + counts[j]])
                    place += counts[j]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                    shared = list(dict.fromkeys(path[x:y].tolist()))
                    rows.append((doc_ids[j], counts[j], int(mask.sum()), [{"first": int(s), "words": int(e - s)} for s, e in zip(edge[::2], edge[1::2])], " ".join(map(words.__getitem__, mine[~mask].tolist())), shared))
                batches.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))
        trim()
        return pa.Table.from_batches(batches, schema)

    out = "doc_id long, n_words long, n_removed long, removed array<struct<first: int, words: int>>, kept string, paths array<long>"
    return repeated.groupBy("block").cogroup(by_block).applyInArrow(removed, out)


def digests(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), p AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), e AS (
  SELECT r, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)) AS h,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING) AS n
  FROM p
), s AS (
  SELECT r, i, n = {K} AND count(*) OVER (PARTITION BY h, n) > 1 AS again FROM e
), c AS (
  SELECT p.r, p.i, p.word, bool_or(again) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM p JOIN s ON p.r = s.r AND p.i = s.i
), k AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
