"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Components are whole numbers. The index is made of blocks of vectors; a block's postings (dimension, vector, impact) lie in
segments by quantised impact, the bit length of the component's magnitude, the greatest first. A query's scores against
all vectors of a block grow segment by segment. After a segment, each score is known up to a bound on what is left: the
norm of the query times the norm of the vector's components that are still to come. The k-th best lower bound proves
which vectors can't be among the best k; processing stops when few are left, or when nothing is, and those are scored
again exactly. Queries go through a block together. A segment of few postings is scored posting by posting, one that
fills over a ``DENSE``th of its block as a matrix product, which is then the faster way to the same sums.

Query batches are broadcast, in groups of checked size, to the blocks of the index, which stay where they are: the stated
query set against all vectors, in blocks. Each pair of batch and block gives k rows a query, and a window ranks those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Vectors in a block and queries in a batch, at most, and components in either: wide vectors make smaller blocks.
BLOCK_ROWS = 8192
BATCH_ROWS = 4096
CELLS = 1 << 20
TOGETHER = 256
#: Bytes of query batches that are broadcast at once.
GROUP_BYTES = 16 << 20
DENSE = 32
#: Vectors of a block that are scored again rather than narrowed down further.
RESCORED = 64
SCALE = 256
_INDEX = "block long, ids binary, values binary, levels array<int>, ends array<long>, dims binary, vecs binary, impacts binary, rest binary"


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as longs; null for null vectors, or with null or non-finite components."""
    x = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    return F.when(fine, F.transform(vector, lambda v: F.floor(x(v) * SCALE)))


def _dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(lists), width), np.int64)
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _index(width: int):
    def build(rows: pa.Table) -> pa.Table:
        ids, values = rows.column("vec_id").to_numpy(), _dense(rows.column("q").combine_chunks(), width)
        size = np.abs(values.astype(np.float64))
        level = np.where(size > 0, np.frexp(size)[1], 0)
        levels, ends, dims, vecs, rest = [], [], [], [], []
        total = 0
        for b in sorted(set(np.unique(level).tolist()) - {0}, reverse=True):
            d, v = np.nonzero((level == b).T)
            levels.append(int(b))
            dims.append(d.astype(np.int32))
            vecs.append(v.astype(np.int32))
            total += len(d)
            ends.append(total)
            rest.append(np.sqrt((np.where(level < b, size, 0) ** 2).sum(1)))
        join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        d, v = join(dims, np.int32), join(vecs, np.int32)
        row = [rows.column("block")[0].as_py(), ids.tobytes(), values.tobytes(), levels, ends, d.tobytes(), v.tobytes(), values[v, d].tobytes(), join(rest, np.float64).tobytes()]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])

    return build


def _exact_type(queries: np.ndarray, values: np.ndarray) -> type:
    """A type in which no sum of products is rounded."""
    most = int(max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0))))) * int(max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))) * values.shape[1]
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _segment(queries: np.ndarray, dims: np.ndarray, vecs: np.ndarray, impacts: np.ndarray, n: int, kind: type) -> np.ndarray:
    """What the postings (dimension, vector, impact) of a segment add to the scores of all queries and vectors."""
    width = queries.shape[1]
    if len(dims) * DENSE > width * n or kind is object:
        segment = np.zeros((width, n), kind)
        segment[dims, vecs] = impacts.astype(kind)
        return queries.astype(kind) @ segment
    out = np.zeros((len(queries), n), kind)
    order = np.argsort(vecs, kind="stable")
    starts = np.flatnonzero(np.diff(vecs[order], prepend=-1))
    if len(order):
        parts = queries.astype(kind)[:, dims[order]] * impacts[order].astype(kind)
        out[:, vecs[order][starts]] = np.add.reduceat(parts, starts, axis=1)
    return out


def _search(row: dict, width: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(numbers of queries in the batch, query ids, vector ids, scores) of the best k of a block, for each query of a batch."""
    ids, values = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"], np.int64).reshape(-1, width)
    query_ids, queries = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"], np.int64).reshape(-1, width)
    dims, vecs, impacts = (np.frombuffer(row[c], t) for c, t in (("dims", np.int32), ("vecs", np.int32), ("impacts", np.int64)))
    ends, kind, n = [0, *row["ends"]], _exact_type(queries, values), len(ids)
    rest = np.frombuffer(row["rest"], np.float64).reshape(-1, n)
    for a in range(0, len(queries), TOGETHER):
        q, own = queries[a : a + TOGETHER], query_ids[a : a + TOGETHER]
        rivals = own[:, None] != ids[None, :]
        score = np.zeros((len(q), n), kind)
        going = np.arange(len(q))
        members: list[np.ndarray | None] = [None] * len(q)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        for s in range(len(ends) - 1):
            at = slice(ends[s], ends[s + 1])
            score[going] += _segment(q[going], dims[at], vecs[at], impacts[at], n, kind)
            if kind is not np.float64 or n <= RESCORED:
                continue  # for sizes that doubles round, all segments are taken
            slack = norm[going, None] * rest[s] * (1 + 1e-9) + (1e-6 if s < len(ends) - 2 else 0)
            low = np.where(rivals[going], score[going] - slack, -np.inf)
            least = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(going), -np.inf)
            possible = rivals[going] & (score[going] + slack >= least[:, None])
            few = possible.sum(1) <= RESCORED
            for i in np.flatnonzero(few):
                members[going[i]] = np.flatnonzero(possible[i])
            going = going[~few]
            if not len(going):
                break
        for i in range(len(q)):
            mine = members[i]
            if mine is None:  # all segments are in, so the scores are exact: only those that reach the k-th matter
                mine = np.flatnonzero(rivals[i])
                if len(mine) > k and kind is not object:
                    mine = mine[score[i, mine] >= np.partition(score[i, mine], len(mine) - k)[len(mine) - k]]
            exact = values[mine].astype(kind) @ q[i].astype(kind)
            best = sorted(zip((-exact).tolist(), ids[mine].tolist()))[:k]
            yield np.full(len(best), a + i), np.full(len(best), own[i]), np.array([x[1] for x in best], np.int64), np.array([-int(x[0]) for x in best], np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` greatest inner
    products with other rows, ties to the smaller id; all, if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Shorter vectors
    are filled up with zeros. Rows that repeat whole count once; rows that share an id but not the vector are queries of their
    own, each with its own ranks, and no row is a candidate for a query of its own id. Scores beyond 64 bits raise
    OverflowError. An empty table gives none. Other columns aren't read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("q")).where("vec_id is not null and q is not null").distinct()
    rows = stage(rows, "search-vectors")
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("q"))).first()
    width = max(1, width or 0)
    rows_of = lambda most: max(k, min(most, CELLS // width))
    blocks, batches = max(1, -(-n // rows_of(BLOCK_ROWS))), max(1, -(-n_queries // rows_of(BATCH_ROWS)))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    index = stage(rows.withColumn("block", place(blocks)).groupBy("block").applyInArrow(_index(width), _INDEX), "search-index")

    def batch(rows: pa.Table) -> pa.Table:
        values = _dense(rows.column("q").combine_chunks(), width)
        return pa.table([pa.array([rows.column("batch")[0].as_py()]), pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["batch", "query_ids", "queries"])

    asked = rows.where(F.col("vec_id") % every == 0).withColumn("batch", place(batches)).groupBy("batch").applyInArrow(batch, "batch long, query_ids binary, queries binary")
    asked = stage(asked, "search-queries")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1).to_pylist()[0]
                for number, *found in _search(row, width, k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((row["batch"] << 32) + number, *found)], names=["query", "query_id", "vec_id", "score"])

    together = max(1, GROUP_BYTES // (rows_of(BATCH_ROWS) * (width + 1) * 8))
    near = None
    for first in range(0, batches, together):
        mine = asked.where(F.col("batch").between(first, first + together - 1))
        met = index.withColumn("batch", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(min(first + together, batches) - 1).cast("long")))).join(F.broadcast(mine), "batch")
        found = met.drop("block").mapInArrow(search, "query long, query_id long, vec_id long, score long")
        near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
) WHERE rank <= 5
"""
