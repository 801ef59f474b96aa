"""Row numbers and running sums over a whole table, without one task that holds it.

Rows are range-partitioned by their order. A window numbers and sums within a partition, and what stands before a partition
comes from the table of the partitions' totals, which has a row each and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import staged


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_part``, numbers of ranges by ``order``. Staged, as a range partitioning that is run again may cut at
    other rows."""
    return staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``name``, the row's number from 0 by ``order``, and for each of ``sums`` the sum up to and with the row."""
    sums = sums or {}
    rows = ranged(df, order)
    totals = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{k}") for k, v in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({name: F.row_number().over(own) - 1} | {k: F.coalesce(F.sum(v).over(upto), F.lit(0)) for k, v in sums.items()})
    out = inner.join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col(name)).alias(name), *[(F.col(f"_b_{k}") + F.col(k)).alias(k) for k in sums])
