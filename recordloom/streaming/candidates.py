"""Candidates for reference records that arrive as a stream, against targets that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LinkConfig
from ..operators.blocking import candidates


def exact_stream(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact-name candidates as a stream: a join of a stream with a table, without state."""
    right = targets.where(F.length("name_norm") > 0).select("name_norm", F.col("entity_id").alias("target_id"), "source")
    return s1.where(F.length("name_norm") > 0).join(right, "name_norm").select(F.col("entity_id").alias("s1_id"), "target_id", "source")


def start(s1: DataFrame, targets: DataFrame, path: str, checkpoint: str, config: LinkConfig = LinkConfig()) -> StreamingQuery:
    """All blockers on each micro-batch, into a folder a batch, so that a batch that runs again replaces what it wrote.

    Frequencies are those of the targets, so a record's candidates don't depend on the batch that it comes in.
    """

    def one(batch: DataFrame, number: int) -> None:
        candidates(batch, targets, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return s1.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
