"""Restrictions on ids: predicates on columns and tables of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def everything() -> Column:
    return F.lit(True)


def in_range(column: Column, start: int, end: int) -> Column:
    """start <= id < end; reaches the file scan."""
    return (column >= start) & (column < end)


def all_of(*parts: Column) -> Column:
    """True when nothing is asked for."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(*parts: Column) -> Column:
    """False when nothing is offered."""
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def none_of(part: Column) -> Column:
    return ~part


def allow(df: DataFrame, ids: DataFrame, id_col: str = "id", capacity: int | None = None) -> DataFrame:
    """Rows whose id is listed; listed ids beyond the capacity do not count."""
    ids = ids.select(F.col("id").alias(id_col)).distinct()
    if capacity is not None:
        ids = ids.where(in_range(F.col(id_col), 0, capacity))
    return df.join(ids, id_col, "left_semi")


def deny(df: DataFrame, ids: DataFrame, id_col: str = "id", capacity: int | None = None) -> DataFrame:
    """Rows whose id is not listed; with a capacity, ids beyond it are denied too."""
    out = df.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    return out if capacity is None else out.where(in_range(F.col(id_col), 0, capacity))


def count_allowed(ids: DataFrame, capacity: int) -> DataFrame:
    return ids.where(in_range(F.col("id"), 0, capacity)).agg(F.count_distinct("id").alias("n"))


def count_not_denied(ids: DataFrame, capacity: int) -> DataFrame:
    return ids.where(in_range(F.col("id"), 0, capacity)).agg((F.lit(capacity) - F.count_distinct("id")).alias("n"))


def with_any_token(tokens: DataFrame, wanted: list) -> DataFrame:
    """(id): ids of the table (id, token) that have any of the tokens."""
    return tokens.where(F.col("token").isin(list(wanted))).select("id").distinct()
