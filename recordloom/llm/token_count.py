"""Token counts by byte-pair merging on a heap and a linked list, without producing identifiers.

A piece of text starts as one symbol per byte. The heap holds the ranks of all adjacent pairs; the lowest is popped
and merged, its two neighbours' new pairs are pushed, until no pair has a rank. The count is the number of initial
symbols less the number of merges. Work is O(n log n) in the piece, so a piece of a megabyte is no trap.

Texts are read by chunk, a chunk being what stands between two single spaces, with the space before it. The
tokenizer's pattern never joins what a single space parts, as long as no two white-space characters stand together, so a
chunk's count doesn't depend on its surroundings and is remembered. Other texts are cut by the tokenizer's own
pre-tokenizer as a whole. The memory of counts is emptied at ``REMEMBERED`` chunks; it only saves time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

REMEMBERED = 1 << 20
LIMIT = 512
_TWO_SPACES = re.compile(r"[\s\x85][\s\x85]")


class Merger:
    """Counts tokens as one tokenizer file of the tokenizers library does, for byte-level BPE."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or (data["pre_tokenizer"] or {}).get("type") != "ByteLevel" or data["normalizer"] or model.get("end_of_word_suffix"):
            raise ValueError("counts by merging are for byte-level BPE without a normalizer")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.pairs, self.ranks = pairs, {p: r for r, p in enumerate(pairs)}
        self.cut = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        specials = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of ``piece``, a string with one character per byte."""
        n = len(piece)
        ranks, pairs = self.ranks, self.pairs
        symbol, after, before = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(piece, piece[1:])) if p in ranks]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            a, b = pairs[rank]
            j = after[i]
            if j >= n or symbol[i] != a or symbol[j] != b:
                continue  # one of the two was merged meanwhile
            whole = symbol[i] = a + b
            symbol[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (whole, symbol[k]) in ranks:
                    heapq.heappush(heap, (ranks[whole, symbol[k]], i))
            h = before[i]
            if h >= 0 and (symbol[h], whole) in ranks:
                heapq.heappush(heap, (ranks[symbol[h], whole], h))
        return left

    def count_part(self, text: str) -> int:
        """Tokens of a text or part of one, cut by the pre-tokenizer; special strings are a token each."""
        total = 0
        for part in self.specials.split(text) if self.specials else [text]:
            if not part:
                continue
            if self.specials and self.specials.fullmatch(part):
                total += 1
                continue
            for piece, _ in self.cut(part):
                n = self.pieces.get(piece)
                if n is None:
                    if len(self.pieces) >= REMEMBERED:
                        self.pieces.clear()
                    n = self.merged(piece)
                    if len(piece) < 100:
                        self.pieces[piece] = n
                total += n
        return total

    def count(self, text: str) -> int:
        if _TWO_SPACES.search(text):
            return self.count_part(text)
        first, *rest = text.split(" ")
        known = self.chunks
        total = self.count_part(first)
        try:
            return total + sum(map(known.__getitem__, rest))
        except KeyError:
            pass
        for chunk in rest:
            n = known.get(chunk)
            if n is None:
                n = self.count_part(" " + chunk)
                if len(chunk) < 100:
                    known[chunk] = n
            total += n
        if len(known) >= REMEMBERED:
            known.clear()
        return total


_mergers: dict[bytes, Merger] = {}


def merger(spec: str) -> Merger:
    """One for each tokenizer and Python worker."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _mergers:
        _mergers[key] = Merger(spec)
    return _mergers[key]


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Number of tokens of a text; null texts have none. ``tokenizer`` is the path of a tokenizer file on the driver."""
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = merger(spec).count
        return pa.array([count(x.as_py() or "") for x in texts], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes of the UTF-8 text, n_tokens, and whether it is over ``limit`` tokens.

    Null and empty texts have 0 bytes and tokens. Rows are independent, so ids may be null or repeat; columns other than
    the two aren't read. There is no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, tokenizer).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
