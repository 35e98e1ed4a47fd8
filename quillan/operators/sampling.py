"""Seeded samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def draw(seed: int, *keys: str):
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def sample(df: DataFrame, k: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """k rows without replacement, all rows when there are fewer; a top-k on a seeded hash of the id."""
    return df.orderBy(draw(seed, id_col), id_col).limit(k)


def sample_with_replacement(df: DataFrame, k: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """k draws (draw, ...): each picks the row with the least rank-th hash in its own order."""
    n = df.count()
    if not n:
        return df.withColumn("draw", F.lit(0)).limit(0)
    spots = df.sparkSession.range(k).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("_at"))
    return spots.join(numbered(df, "_at"), "_at").drop("_at")


def reservoir(df: DataFrame, k: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A uniform sample of what has arrived so far: the k least hashes, so batches merge by union and sample again."""
    return sample(df, k, seed, id_col)
