"""Connected components by alternating large and small stars, with the edges in a table at all times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, stage


def _star(edges: DataFrame, total: int, small: bool) -> DataFrame:
    """For each node the least of it and its neighbours becomes the neighbour of those that are larger than the node
    (large star), or of the node and of those that are smaller (small star)."""
    if small:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    met = join_groups(sides, least, "u", "n", 2 * total).withColumn("m", F.least("m", "u"))
    if small:
        met = met.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    else:
        met = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long), root being the least node reachable.

    The number of rounds grows with the logarithm of the longest path. Each round writes its edges to the shared folder,
    so a lost executor costs a round at most. Self-loops and repeated edges are harmless, an empty table gives none.
    """
    state = None
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = stage(_star(_star(edges, now[0], False), now[0], True), "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
