"""Consecutive numbers for rows, without a sort in one task and without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROW = (1 << 33) - 1


def numbered(rows: DataFrame, name: str = "n", first: int = 0) -> DataFrame:
    """rows with numbers from ``first`` on, in the order of the partitions and of the rows in them.

    Rows are checkpointed where a checkpoint folder is set, so that both passes
    see the same partitions; the counts are one row a partition.
    """
    rows = rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows
    at = rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))})
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    return at.join(F.broadcast(starts), "__p").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__s") + F.col("__i") + first).alias(name))
