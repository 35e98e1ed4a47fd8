"""Schemas with more fields, without touching the frame's own."""

from __future__ import annotations

from pyspark.sql import types as T

INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
DOUBLES, SHORTS, INTS = T.ArrayType(DOUBLE), T.ArrayType(T.ShortType()), T.ArrayType(INT)


def extended(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields.items()]])
