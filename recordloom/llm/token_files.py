"""Token ids of documents in files, in ascending order of doc_id, coded by an adaptive context-mixing range coder.

Texts become ids, and ids become code and ids again, in the JVM (jvm/TokenFiles.java). Texts with characters or strings on
which tokenizer versions may differ, and all texts of tokenizers that aren't byte-level, go through the library itself.

Documents are dealt by ranges of doc_id, sorted within a range, and each range is written as segments of about
``SEGMENT_IDS`` ids by one task. A segment is a row of a Parquet folder, written and read by Spark, so the files can be
in any store that Spark knows: its range and number, the ids and documents in it, an index of the documents, and the ids'
code, in blocks that are reset and checksummed each for itself.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..sources.session import scratch_dir
from .common import BROADCAST_BYTES
from .jvm_functions import byte_pairs, decode_blocks, encode_blocks, pair_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
END = 2
SEGMENT_IDS = 1 << 22
SEGMENTS = "range int, number int, n_ids long, n_docs int, width int, index binary, data binary"
_tokenizers: dict[bytes, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer.from_str(spec)
        _tokenizers[key].no_truncation()
        _tokenizers[key].no_padding()
    return _tokenizers[key]


def pack_index(doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A checksum, the number of documents, and which ids are null, ids as differences and lengths, compressed."""
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    body = zstandard.compress(null.tobytes() + np.diff(numbers, prepend=0).astype("<i8").tobytes() + np.asarray(lengths, "<i8").tobytes())
    head = len(doc_ids).to_bytes(8, "little")
    return zlib.crc32(body, zlib.crc32(head)).to_bytes(4, "little") + head + body


def read_index(data: bytes) -> tuple[list[int | None], np.ndarray]:
    """What ``pack_index`` was given. Raises ValueError where the checksum doesn't hold."""
    head, body = data[4:12], data[12:]
    if zlib.crc32(body, zlib.crc32(head)) != int.from_bytes(data[:4], "little"):
        raise ValueError("a segment's index is damaged")
    n, plain = int.from_bytes(head, "little"), zstandard.decompress(body)
    at = (n + 7) // 8
    null = np.unpackbits(np.frombuffer(plain[:at], np.uint8))[:n].astype(bool)
    numbers = np.cumsum(np.frombuffer(plain[at : at + 8 * n], "<i8"))
    return [None if x else d for d, x in zip(numbers.tolist(), null.tolist())], np.frombuffer(plain[at + 8 * n :], "<i8").astype(np.int64)


def place_of(ids: np.ndarray, ties: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ranges by id. An id that is several cuts has so many rows that it fills ranges of its own: these are shared out by
    the order of ``ties``, so that range order stays that of (id, tie)."""
    first, last = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    several = (last - first) > 1
    part = ((ties >> 32) + (1 << 31)).astype(np.float64) / 2.0**32 * (last - first)
    return np.where(several, first + part.astype(np.int64), first).astype(np.int32)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by ``end``, to a new folder.

    Null texts count as empty, and so have the end id only. Ids become longs; those that can't are null. Null ids come
    first, as if they were the least long; documents that share an id follow each other by a hash of their texts, then by
    their token ids. Any number of rows may share an id. There are as many ranges as ``docs`` has partitions or the cluster
    cores, whichever is more. A document of more than ``SEGMENT_IDS`` ids is a segment of its own. Other columns aren't read.
    """
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    text = F.coalesce(F.col(text_col), F.lit(""))
    try:
        width = pair_table(spec)[1]
        coded = byte_pairs(spark, text, spec)
    except ValueError:
        width = 2 if max(_tokenizer(spec).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
        coded = F.concat(F.lit(b"\x01"), text.cast("binary"))
    kind = np.dtype(f"<u{width}")
    last = np.array([end], kind).tobytes()
    doc_id = F.col(id_col).try_cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("tie"), coded.alias("coded"))
    least = F.coalesce(doc_id, F.lit(-(2**63)))
    ranges = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.select(F.percentile_approx(least, shares, min(max(10_000, 100 * ranges), 1 << 22))).first()[0] if shares else []
    cuts = np.array(cuts or [], np.int64)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, ties, coded = batch.column(0), batch.column(1).to_numpy(), [c.as_py() for c in batch.column(2)]
            place = place_of(doc_ids.fill_null(-(2**63)).to_numpy(), ties, cuts)
            left = [i for i, c in enumerate(coded) if c[0]]
            if left:
                found = _tokenizer(spec).encode_batch([coded[i][1:].decode() for i in left], add_special_tokens=False)
                for i, e in zip(left, found):
                    coded[i] = b"\0" + np.array(e.ids, kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(place), doc_ids, batch.column(1), pa.array([c[1:] + last for c in coded], pa.binary())], names=["range", "doc_id", "tie", "ids"])

    dealt = keyed.mapInArrow(ranged, "range int, doc_id long, tie long, ids binary").repartitionById(ranges, "range").sortWithinPartitions("range", "doc_id", "tie", "ids")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, doc_ids, parts, total = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) // width for p in parts])
            row = [own, number, int(lengths.sum()), len(doc_ids), width, pack_index(doc_ids, lengths), b"".join(parts)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["range", "number", "n_ids", "n_docs", "width", "index", "raw"])

        for batch in batches:
            for place, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                ids = ids.as_py()
                if parts and (place != own or total + len(ids) // width > SEGMENT_IDS):
                    yield flush()
                    number = number + 1 if place == own else 0
                    doc_ids, parts, total = [], [], 0
                own = place
                doc_ids.append(doc_id)
                parts.append(ids)
                total += len(ids) // width
        if parts:
            yield flush()

    rows = dealt.mapInArrow(packed, "range int, number int, n_ids long, n_docs int, width int, index binary, raw binary")
    rows.withColumn("data", encode_blocks(spark, F.col("raw"), width)).drop("raw").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of all documents in the folder, from the decoded and checked blocks; ``start`` is
    the number of ids before the document's in all of the files."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", lambda ids, at, n: pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + n[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the folder, the CRC-32 over little-endian 32-bit ids."""

    def crc(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Array:
        data = memoryview(ids.astype("<u4").tobytes())
        return pa.StructArray.from_arrays([pa.array(n), pa.array([zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), n.tolist())], pa.int64())], names=["n_tokens", "ids_crc32"])

    found = _read(spark, path, "doc_id long, start long, found struct<n_tokens: long, ids_crc32: long>", crc)
    return found.select("doc_id", "start", "found.n_tokens", "found.ids_crc32")


def _read(spark: SparkSession, path: str, schema: str, made) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("range", "number", "n_ids")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a window over ranges, of which there are as many as partitions, and one within each
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier(Window.orderBy("range"))), F.lit(0)))
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("range").orderBy("number"))), F.lit(0)))
    starts = starts.join(ranges, "range").select("range", "number", (F.col("before") + F.col("inner")).alias("base"))
    if segments.count() * 32 <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    names = [c.strip().split()[0] for c in schema.split(", ", 2)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, raw, width, base in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                doc_ids, n = read_index(index.as_py())
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                at = np.cumsum(n) - n
                for i in range(0, len(n), 4096):
                    part = slice(i, i + 4096)
                    first, last = int(at[i]), int(at[part][-1] + n[part][-1])
                    value = made(ids[first:last], at[part] - first, n[part])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[part], pa.int64()), pa.array(at[part] + base), value], names=names)

    whole = segments.join(starts, ["range", "number"])
    return whole.select("index", decode_blocks(spark, F.col("data"), F.col("width")).alias("raw"), "width", "base").mapInArrow(told, schema)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``write`` to the shared folder, then ``summary`` of what was written: one row per document, whatever its id or text
    (see ``write``); an empty table gives none."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return summary(spark, path)
