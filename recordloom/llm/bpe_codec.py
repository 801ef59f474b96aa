"""BPE encoding and decoding through a table of distinct words.

Spark splits texts at ASCII white space into words, which are packed in blocks (see blocks.py). The table of distinct words
is partitioned by hash. A block sends each partition the sorted list of its own words, compressed, as a single row; the
partition merges the lists of all blocks, has the tokenizer encode each distinct word once, and answers every list with
a list of ids. Ids then join words by position: a block's answers are put in the order of its words, and its documents
gather them. Decoding starts from those ids alone and meets them with the broadcast table of the vocabulary's pieces.

Of very many blocks, ``COHORT`` share a table: so neither a word that is in every block nor the number of lists, blocks times
partitions, grows without bound in one place, and a word is encoded once for each 4 billion words or so of text.

That words can be encoded one by one is a property of the tokenizer, not of the texts: its pattern drops white space and
matches nothing across it, and its normalizer (NFC, white space, lower case by character) doesn't look past a space.
Tokenizer files of another kind are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import blocks
from .common import BROADCAST_BYTES, trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's workers are forked, and one task has one core
BLOCK_WORDS = 1 << 20
#: Words that a partition of the table gets from all blocks, about.
PARTITION_WORDS = 1 << 18
#: Blocks that share a table of distinct words, about.
COHORT = 4096
_tokenizers: dict[bytes, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer.from_str(spec)
        _tokenizers[key].no_truncation()
        _tokenizers[key].no_padding()
    return _tokenizers[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    data = json.loads(spec)
    kinds = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", [])]
    steps = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = steps[0] if steps and steps[0]["type"] == "Split" else {}
    by_word = split.get("behavior") == "Removed" and split.get("invert") and r"\s" in split["pattern"].get("Regex", "")
    special = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"])
    if not by_word or not set(kinds) <= {"NFC", "Replace", "Lowercase"} or special or data["decoder"] or data["post_processor"]:
        raise ValueError("words can't be encoded one by one with this tokenizer")
    return spec


def vocabulary(spec: str) -> list[str | None]:
    """Pieces by id; their size is checked, as they go to every task."""
    known = _tokenizer(spec).get_vocab(with_added_tokens=True)
    if sum(len(p.encode()) + 16 for p in known) > BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to send to every task")
    pieces: list[str | None] = [None] * (max(known.values(), default=-1) + 1)
    for piece, i in known.items():
        pieces[i] = piece
    return pieces


def _dealt(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers by part and alphabet, and where each part starts."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
    order = order[np.argsort(part[order], kind="stable")] if len(order) else order
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def word_lists(packed: DataFrame, parts: int, cohorts: int = 1) -> DataFrame:
    """(cohort, part, block, n, words): the words of each block by part of its cohort's table."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = blocks.words_of(blob)
                order, starts = _dealt(words, parts)
                cohort = zlib.crc32(block.to_bytes(8, "little")) % cohorts
                rows = []
                for p in np.flatnonzero(np.diff(starts)).tolist():
                    mine = [words[i] for i in order[starts[p] : starts[p + 1]].tolist()]
                    rows.append((cohort, p, block, len(mine), zstandard.compress(b" ".join(mine), 5)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["cohort", "part", "block", "n", "words"])

    return packed.select("block", "words").mapInArrow(dealt, "cohort long, part long, block long, n int, words binary")


def encode_words(lists: DataFrame, spec: str) -> DataFrame:
    """(block, part, n, total, lengths, ids): the answers to ``lists``. Each distinct word is encoded once, in its part."""

    def encoded(rows: pa.Table) -> pa.Table:
        trim()
        table: dict[bytes, int] = {}
        asked = []
        for blob in rows.column("words"):
            words = blocks.words_of(blob.as_py())
            asked.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
        tokenizer, words = _tokenizer(spec), list(table)
        lengths, ids = [], []
        for i in range(0, len(words), 1 << 12):
            for found in tokenizer.encode_batch([w.decode() for w in words[i : i + (1 << 12)]], add_special_tokens=False):
                lengths.append(len(found.ids))
                ids += found.ids
        lengths, ids = np.array(lengths, np.int64), np.array(ids, np.int64)
        starts = np.cumsum(lengths) - lengths
        out = []
        for block, part, mine in zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), asked):
            got = _gather(ids, starts[mine], lengths[mine])
            out.append((block, part, len(mine), len(got), blocks.squeeze(lengths[mine]), blocks.squeeze(got)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        del table, asked, words, lengths, ids
        trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["block", "part", "n", "total", "lengths", "ids"])

    return lists.groupBy("cohort", "part").applyInArrow(encoded, "block long, part long, n int, total int, lengths binary, ids binary")


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` one after the other."""
    total = np.cumsum(lengths)
    return flat[np.repeat(starts - (total - lengths), lengths) + np.arange(int(lengths.sum()))]


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>, and decoded, the text that those ids decode to.

    Null texts count as empty: no ids, an empty text. Ids of documents become longs (null, where they can't), and may be null
    or repeat, as words go back to places in blocks and never by doc_id. An empty table gives none. Other columns aren't read.
    A word occurs in the shuffle once for each block that has it. A very long text is a block of its own.
    """
    return decode(encode(docs, tokenizer, id_col, text_col), tokenizer, keep_ids=True)


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of ``encode_decode``."""
    spec = read_spec(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    packed = blocks.pack(docs, "bpe-blocks", id_col, text_col, BLOCK_WORDS)
    n_words, n_blocks = packed.agg(F.sum("n_words"), F.count("*")).first()
    cohorts = max(1, -(-n_blocks // COHORT))
    parts = max(1, -(-(n_words or 0) // (PARTITION_WORDS * cohorts)))
    answers = encode_words(word_lists(packed, parts, cohorts), spec)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def assembled(answers: pa.Table, block: pa.Table) -> pa.Table:
        trim()
        batches = []
        for row in block.to_pylist():
            words, codes, ends = blocks.block_words(row)
            order, starts = _dealt(words, parts)
            length, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            flat = []
            at = 0
            for a in answers.to_pylist():
                mine = order[starts[a["part"]] : starts[a["part"] + 1]]
                n = blocks.codes_of(a["lengths"], a["n"])
                length[mine], start[mine] = n, at + np.cumsum(n) - n
                flat.append(blocks.codes_of(a["ids"], a["total"]).astype(np.int32))
                at += a["total"]
            flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            del words, order
            for a, b in blocks.doc_chunks(ends, 1 << 18):
                mine = codes[ends[a] : ends[b]]
                n = length[mine]
                edges = np.concatenate([[0], np.cumsum(n)])[ends[a : b + 1] - ends[a]]
                ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(_gather(flat, start[mine], n)))
                batches.append(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][a:b], pa.int64()), ids], schema=schema))
        trim()
        return pa.Table.from_batches(batches, schema)

    return answers.groupBy("block").cogroup(packed.drop("n_words").groupBy("block")).applyInArrow(assembled, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = False) -> DataFrame:
    """(doc_id, [ids,] decoded) of any table of ids, whatever made them: ids meet the broadcast table of pieces, which is
    in the order of ids, so that an id is its own place in it, and keep their positions. Ids that the vocabulary lacks are
    left out, as the tokenizer's own decode does; null or empty lists decode to an empty text."""
    spec = read_spec(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    pieces = F.from_json(F.lit(json.dumps(vocabulary(spec))), "array<string>")  # a constant of the plan, of checked size
    found = F.transform(F.col(ids_col), lambda i: F.get(pieces, i))
    text = F.coalesce(F.array_join(found, " "), F.lit(""))  # leaves nulls out
    return coded.select(F.col(id_col).alias("doc_id"), *[F.col(ids_col).alias("ids")] * keep_ids, text.alias("decoded"))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, a space between) and of the decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
