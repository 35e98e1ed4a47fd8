"""Vector columns: dense arrays and sparse (dim, indices, vals) structs.

Elements are cast to double before arithmetic; folds are sequential, so
results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def fold(v: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def element(v: Column, i: int) -> Column:
    """Element i, 0 where there is none."""
    return F.coalesce(F.get(doubles(v), F.lit(i)), F.lit(0.0))


def with_element(v: Column, i: int, value: float) -> Column:
    """v with element i replaced; unchanged where i is out of range."""
    return F.transform(doubles(v), lambda x, at: F.when(at == i, F.lit(float(value))).otherwise(x))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def squared_norm(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def normalize(v: Column, least: float = 0.0) -> Column:
    """v at unit length; a vector no longer than ``least`` stays as it is."""
    n = norm(v)
    return F.when(n > least, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def horizontal_sum(v: Column) -> Column:
    return fold(doubles(v))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """a + sign * b, element by element."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + sign * y)


def truncate(v: Column, dim: int, start: int = 0) -> Column:
    """Elements start .. start + dim, padded with zeros."""
    part = F.slice(doubles(v), start + 1, dim)
    return F.concat(part, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(part)))


def untruncate(v: Column, dim: int, start: int = 0) -> Column:
    """The inverse of truncate: zeros outside of the window."""
    whole = F.concat(zeros(start), doubles(v))
    return truncate(whole, dim)


def chunk(v: Column, i: int, size: int) -> Column:
    return F.slice(doubles(v), i * size + 1, size)


def chunks(v: Column, number: int) -> Column:
    """Equal chunks of size(v) div number elements; a remainder is one more chunk."""
    size = F.greatest(F.floor(F.size(v) / number), F.lit(1)).cast("int")
    last = F.ceil(F.size(v) / size).cast("int")
    return F.when(F.size(v) == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.slice(doubles(v), i * size + 1, size)))


def join_chunks(parts: Column) -> Column:
    return F.flatten(parts)


def to_sparse(v: Column) -> Column:
    """Non-zero elements as a struct, indices ascending."""
    hits = F.filter(F.transform(doubles(v), lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return F.struct(F.size(v).cast("long").alias("dim"), hits["i"].alias("indices"), hits["x"].alias("vals"))


def sparse_map(s: Column) -> Column:
    return F.map_from_arrays(s["indices"], doubles(s["vals"]))


def to_dense(s: Column) -> Column:
    """Dense array of a sparse struct; dimensions without a value are 0."""
    m = sparse_map(s)
    return F.when(s["dim"] > 0, F.transform(F.sequence(F.lit(0).cast("long"), s["dim"] - 1), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def sparse_element(s: Column, i: int) -> Column:
    return F.coalesce(F.element_at(sparse_map(s), F.lit(i).cast("long")), F.lit(0.0))
