"""Documents packed into blocks of words, for operators that send something about words away and get it back.

Spark splits texts into words. A block holds whole documents of one partition, up to ``block_words`` words and
``BLOCK_DOCS`` documents (a longer document is a block of its own): its distinct words, and the document's words as
positions in that list, compressed. That is about a third of the text's size. Blocks are written to the shared folder, so
that their numbers are settled, and bucketed by number, so that they stay where they are when what was sent away comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_by, trim

BLOCK_WORDS = 1 << 21
BLOCK_DOCS = 1 << 16
_SPACE = " \t\n\x0b\f\r"
SCHEMA = "block long, doc_ids array<long>, doc_words array<int>, n_words int, words binary, codes binary"
ARROW = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32())), ("n_words", pa.int32()), ("words", pa.binary()), ("codes", pa.binary())]
)


def squeeze(codes: np.ndarray) -> bytes:
    """Codes are mostly small, so their bytes are stored plane by plane."""
    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def words_of(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b" ") if blob else []


def codes_of(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64)


def words(text: Column) -> Column:
    """The words of a text, runs of anything but ASCII white space; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _pack(batches: Iterator[pa.RecordBatch], block_words: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    trim()
    number = TaskContext.get().partitionId() << 32
    ids, counts, parts, total = [], [], [], 0

    def flush() -> pa.RecordBatch:
        coded = pa.concat_arrays(parts).dictionary_encode()
        distinct = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py()
        row = {"block": number, "doc_ids": ids, "doc_words": counts, "n_words": len(distinct), "words": zstandard.compress(joined.encode(), 3) if len(distinct) else b"", "codes": squeeze(coded.indices.to_numpy())}
        return pa.RecordBatch.from_pylist([row], ARROW)

    for batch in batches:
        lists = batch.column(1)
        doc_ids, ends = batch.column(0).to_pylist(), lists.offsets.to_numpy()
        flat, first = lists.values, 0
        while first < len(doc_ids):
            last = int(np.searchsorted(ends, ends[first] + block_words - total, "right")) - 1
            last = min(max(last, first + (not ids)), first + block_docs - len(ids), len(doc_ids))
            if last > first:
                ids += doc_ids[first:last]
                counts += np.diff(ends[first : last + 1]).tolist()
                parts.append(flat.slice(ends[first], ends[last] - ends[first]))
                total += int(ends[last] - ends[first])
            if last < len(doc_ids):
                yield flush()
                number += 1
                ids, counts, parts, total = [], [], [], 0
                trim()
            first = last
    if ids:
        yield flush()
    del ids, counts, parts
    trim()


def pack(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of ``docs``, staged by block. Null texts have no words; ids become longs, null where they can't, and may repeat.

    A single document of more than ``block_words`` words is a block, and so in memory, as a whole: as a row it is that
    anyway."""
    split = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), words(F.col(text_col)).alias("words"))
    return stage_by(split.mapInArrow(partial(_pack, block_words=block_words, block_docs=BLOCK_DOCS), SCHEMA), name, "block")


def block_words(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, codes of all words, and the number of the first word of each document and of the end."""
    counts = np.asarray(row["doc_words"], np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return words_of(row["words"]), codes_of(row["codes"], int(ends[-1])), ends


def doc_chunks(ends: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents with up to ``most`` words together, or one document."""
    first = 0
    while first < len(ends) - 1:
        last = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(ends) - 1)
        yield first, last
        first = last
