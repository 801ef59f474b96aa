"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mix by its weight, and a schedule that says when in training it is asked for. The
schedule's integral is the source's cumulative demand in words over training time from 0 to 1. Documents of a source
stand in a fixed pseudo-random order, repeated from the start when it runs out; the words before a document, put
through the inverse of that integral, give its position in training, and the mix is range-sorted by position.

Running sums over a source never meet in one task: a source is cut by hash into buckets of about ``BUCKET_ROWS``
documents, sums of buckets are accumulated over the much smaller table of buckets, and a window within a bucket does
the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, boxed, join_groups, stage

BUCKET_ROWS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Demand in equal phases of training, one schedule per weight: even, falling, rising.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))
_HASH = "conv(substring(md5(cast({id} as string)), 1, 15), 16, 10)"
_SPAN = 2.0**60  # the hash is below


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): ``share`` of all sizes split by weight, none over ``most`` times
    its source's size, what is over shared again by weight.

    The fixed point has a closed form: sources fill up in the order of size / weight, so with those sorted, the level
    after the first k are full is what is left over the weights left, and the sources below their level are full. The
    one unpartitioned window is over sources, not documents.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % n + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = F.try_divide(
        F.lit(share) * F.sum("source_size").over(every) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    # the first that does not fill up sets the level for itself and all after it
    levelled = ranked.withColumn("own_level", level).withColumn("full", F.lit(float(most)) * F.col("source_size") <= F.col("own_level") * F.col("weight"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "rank", F.col("own_level").alias("level")))).over(every)["level"]
    target = F.when(F.col("full"), F.lit(float(most)) * F.col("source_size")).otherwise(shared * F.col("weight"))
    return levelled.withColumn("target", target.cast("double")).drop("own_level", "full")


def position(offset: Column, target: Column, schedule: Column, phases: int) -> Column:
    """The time at which cumulative demand reaches ``offset`` of ``target`` words.

    Demand is constant within a phase, so its integral is piecewise linear, and so is the inverse: time is the sum, over
    phases, of the phase's length times the part of the phase's demand that lies below the offset.
    """
    part = F.coalesce(F.least(F.try_divide(offset.cast("double"), target), F.lit(1.0)), F.lit(0.0))
    total = sum((schedule[k] for k in range(phases)), F.lit(0.0))
    time, below = F.lit(0.0), F.lit(0.0)
    for k in range(phases):
        own = schedule[k] / total
        through = F.coalesce(F.try_divide(part - below, own), F.when(part > below, 1.0).otherwise(0.0))  # no demand: no time there
        time += F.greatest(F.lit(0.0), F.least(F.lit(1.0), through)) / phases
        below += own
    return F.least(F.lit(1.0), time)


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies``, ``taken`` and ``positions`` to rows with doc_id, source and size.

    A document's n-th copy is taken if its middle lies within the source's target, so each source's taken words differ
    from its target by half a document at most. The order within a source is the md5 of doc_id, then doc_id; rows that
    share a doc_id, null among them, take places next to each other by size; those equal in both share their places out in
    an order of Spark's, so that any of them may be the one that is taken more often. Null is a source of its own, last in rank. A source without
    words has target 0. Reruns agree as nothing depends on partitions.
    """
    keyed = sized.withColumn("place", F.expr(_HASH.format(id="doc_id")).cast("double")).withColumn("place", F.coalesce("place", F.lit(0.0)))
    totals = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    cycle = len(schedules)
    shapes = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    phases = len(schedules[0])
    targets = stage(
        source_targets(totals, weights, share, most)
        .withColumn("buckets", F.ceil(F.col("source_rows") / BUCKET_ROWS))
        .withColumn("schedule", shapes[((F.col("rank") - 1) % cycle).cast("int")])
        .withColumn("source_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
        .drop("source", "weight"),
        "mix-targets",
    )
    n_sources, widest, rows = targets.agg(F.count("*"), F.max(F.octet_length("source_key.name")), F.sum("source_rows")).first()
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    named = keyed.withColumn("source_key", key)
    if n_sources * (200 + (widest or 0)) <= BROADCAST_BYTES:
        met = named.join(F.broadcast(targets), "source_key")
    else:  # hot sources are few, and their rows stay where they are
        met = join_groups(named, targets, "source_key", "source_rows", rows)
    placed = met.drop("source_rows").withColumn("bucket", F.floor(F.col("place") / _SPAN * F.col("buckets")))
    sums = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")

    within = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # the window is first, so that its shuffle by (source, bucket) also serves the join
    inner = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = inner.join(sums, ["source_key", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("before"))
    middle = F.col("start") + F.col("size") / 2
    copies = sum((F.when(middle + k * F.col("source_size") <= F.col("target"), 1).otherwise(0) for k in range(int(most))), F.lit(0))
    out = start.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    at = lambda k: position(F.col("start") + k * F.col("source_size"), F.col("target"), F.col("schedule"), phases)
    out = out.withColumn("positions", F.slice(F.array(*[at(k) for k in range(int(most))]), F.lit(1), F.col("copies")))
    return out.drop("place", "source_key", "bucket", "buckets", "schedule", "rank", "before", "bucket_start", "start")


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs``: doc_id, size, source_size, target, taken, copies and first_position, sorted by
    range of first_position (null where the mix takes no copy). Null texts have size 0; other columns aren't read."""
    thin = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = mix(thin).withColumn("first_position", F.get("positions", F.lit(0)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position").sort("first_position", "doc_id")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as they are taken, sorted by range of position."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), boxed(docs).alias("row_values"))
    taken = mix(rows).select("row_values", F.explode("positions").alias("position"))
    return taken.sort("position", "row_values.doc_id").select("row_values.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT::DOUBLE AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS own_level
  FROM w WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 2.0::DOUBLE * source_size <= own_level * weight AS is_full FROM l
), t AS (
  SELECT source, source_size, (rank - 1) % 3 AS kind, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
         ELSE (SELECT arg_min(own_level, (source_size / weight, rank)) FROM f WHERE NOT is_full) * weight END AS target
  FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.kind,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, start + size / 2.0::DOUBLE AS middle, CASE WHEN target = 0 THEN 0.0::DOUBLE ELSE least(start / target, 1.0::DOUBLE) END AS part,
         [CASE kind WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END / 3.0::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE,
          CASE kind WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END / 3.0::DOUBLE] AS own
  FROM p
)
SELECT doc_id, size, source_size, target, (middle <= target)::INT + (middle + source_size <= target)::INT AS copies,
       size * ((middle <= target)::INT + (middle + source_size <= target)::INT)::BIGINT AS taken,
       CASE WHEN middle <= target THEN least(1.0::DOUBLE,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, part / own[1])) / 3 + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (part - own[1]) / own[2])) / 3
         + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (part - (own[1] + own[2])) / own[3])) / 3) END AS first_position
FROM q
"""
