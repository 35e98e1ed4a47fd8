"""Bit functions on 64-bit columns and binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillan.schema import INTS


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _each(f):
    """A series function that leaves nulls alone."""
    return lambda s: s.map(f, na_action="ignore")


@F.pandas_udf(INTS)
def bytes_of(b: pd.Series) -> pd.Series:
    """A binary column as an array of numbers 0 to 255."""
    return _each(lambda x: np.frombuffer(x, np.uint8).astype(np.int32))(b)


@F.pandas_udf(T.BinaryType())
def pack_bits(flags: pd.Series) -> pd.Series:
    """An array of booleans as bytes, the first flag in the lowest bit."""
    return _each(lambda x: np.packbits(np.asarray(x, bool), bitorder="little").tobytes())(flags)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _unpack_bits(packed: pd.Series) -> pd.Series:
    return _each(lambda x: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").astype(bool))(packed)


def unpack_bits(packed: Column, number: int) -> Column:
    return F.slice(_unpack_bits(packed), 1, number)


@F.pandas_udf(T.BinaryType())
def pack_nibbles(codes: pd.Series) -> pd.Series:
    """Numbers 0 to 15, two to a byte, the first in the low nibble; an odd one out gets 0 beside it."""

    def one(x) -> bytes:
        x = np.asarray(x, np.uint8) & 15
        x = np.append(x, 0) if len(x) % 2 else x
        return (x[::2] | x[1::2] << 4).astype(np.uint8).tobytes()

    return _each(one)(codes)


@F.pandas_udf(INTS)
def unpack_nibbles(packed: pd.Series) -> pd.Series:
    def one(b: bytes) -> np.ndarray:
        x = np.frombuffer(b, np.uint8)
        return np.stack([x & 15, x >> 4], 1).ravel().astype(np.int32)

    return _each(one)(packed)


def popcount_bytes(b: Column) -> Column:
    return F.aggregate(bytes_of(b), F.lit(0), lambda a, x: a + F.bit_count(x))


def hamming_bytes(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(bytes_of(a), bytes_of(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bit(x: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.call_function("shiftright", x, i.cast("int")).bitwiseAND(F.lit(1))


def bit_list(x: Column) -> Column:
    """Positions of the set bits of a 64-bit number, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(x, i) == 1)


def select_bit(x: Column, k: int) -> Column:
    """Position of the k-th set bit, counted from 1; null where there is none."""
    return F.get(bit_list(x), F.lit(k - 1))


def lowest_set_bit(x: Column) -> Column:
    return F.get(bit_list(x), F.lit(0))


def highest_set_bit(x: Column) -> Column:
    return F.when(x != 0, F.length(F.bin(x)) - 1)


def clear_lowest_bit(x: Column) -> Column:
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(x.bitwiseAND(x - 1))


def isolate_lowest_bit(x: Column) -> Column:
    return x.bitwiseAND(-x)


def is_power_of_2(x: Column) -> Column:
    return F.bit_count(x) == 1


def next_power_of_2(x: Column) -> Column:
    """The least power of two not below x; 1 for 0."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


def _spread(x: Column) -> Column:
    steps = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
    x = x.cast("long")
    for by, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def interleave(x: Column, y: Column) -> Column:
    """Morton code of two unsigned 31-bit numbers, x in the even bits."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def _gather(z: Column) -> Column:
    z = z.bitwiseAND(F.lit(0x5555555555555555))
    for by, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        z = z.bitwiseOR(F.shiftrightunsigned(z, by)).bitwiseAND(F.lit(mask))
    return z


def deinterleave(z: Column) -> Column:
    return F.struct(_gather(z).alias("x"), _gather(F.shiftrightunsigned(z, 1)).alias("y"))


def bitmap_ids(words: Column) -> Column:
    """Ids in a bitmap of 64-bit words, ascending."""
    return F.flatten(F.transform(words, lambda w, i: F.transform(bit_list(w), lambda b: b + i * 64)))


def prefix_popcount(words: Column) -> Column:
    """Set bits before each word, and in all: one entry more than words."""
    return F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.bit_count(w))))
