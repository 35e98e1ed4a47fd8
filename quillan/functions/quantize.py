"""Scalar, 4-bit, 8-bit-float and 16-bit-float quantizers.

Scalar and 4-bit codes are Catalyst expressions; float formats are bit work
on Arrow batches, exposed as pandas UDFs on array columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.schema import DOUBLES, INTS

from .bits import pack_nibbles, unpack_nibbles
from .vectors import doubles


@dataclass(frozen=True)
class ScalarParams:
    """Code c stands for low + c * scale, 0 <= c <= levels."""

    low: float
    high: float
    bits: int = 8

    @property
    def levels(self) -> int:
        return 2**self.bits - 1

    @property
    def scale(self) -> float:
        return (self.high - self.low) / self.levels if self.high > self.low else 1.0


def calibrate(stats, bits: int = 8, symmetric: bool = False, sigmas: float | None = None, low: float | None = None, high: float | None = None) -> ScalarParams:
    """Range: given bounds, else symmetric, else mean +- sigmas * std inside the extremes, else the extremes.

    stats has lowest, highest, mean and std.
    """
    if not 1 <= bits <= 8:
        raise InvalidArgument("bits must be 1 to 8")
    if low is not None and high is not None:
        return ScalarParams(low, high, bits)
    if symmetric:
        most = max(abs(stats["lowest"]), abs(stats["highest"]))
        return ScalarParams(-most, most, bits)
    if sigmas is not None:
        return ScalarParams(max(stats["lowest"], stats["mean"] - sigmas * stats["std"]), min(stats["highest"], stats["mean"] + sigmas * stats["std"]), bits)
    return ScalarParams(stats["lowest"], stats["highest"], bits)


def quantize(v: Column, p: ScalarParams) -> Column:
    """Codes as smallint; halves are rounded up, which is away from zero here."""
    return F.transform(doubles(v), lambda x: F.floor((F.least(F.greatest(x, F.lit(p.low)), F.lit(p.high)) - p.low) / p.scale + 0.5).cast("smallint"))


def dequantize(codes: Column, p: ScalarParams) -> Column:
    return F.transform(codes, lambda c: c * p.scale + p.low)


def pack_int4(codes: Column) -> Column:
    """Numbers -8 to 7, two to a byte, the first in the low nibble, biased by 8."""
    return pack_nibbles(F.transform(codes, lambda c: c.cast("int") + 8))


def unpack_int4(packed: Column, number: Column | int) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    return F.transform(F.slice(unpack_nibbles(packed), F.lit(1), number), lambda c: c - 8)


def _flat(s: pd.Series, f, kind) -> pd.Series:
    """f over all elements of a series of arrays at once."""
    sizes = [0 if x is None else len(x) for x in s]
    flat = np.concatenate([np.asarray(x, dtype=kind) for x in s if x is not None and len(x)]) if sum(sizes) else np.zeros(0, kind)
    out = f(flat)
    cuts = np.cumsum([0, *sizes])
    return pd.Series([None if x is None else out[a:b] for x, a, b in zip(s, cuts, cuts[1:])])


def bf16_codes(x: np.ndarray) -> np.ndarray:
    """Upper 16 bits, rounded to the nearest, ties to even; NaN stays NaN."""
    bits = np.asarray(x, dtype=np.float32).view(np.uint32).astype(np.uint64)
    out = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint32)
    return np.where(np.isnan(np.asarray(x, np.float32)), 0x7FC0, out).astype(np.int32)


def bf16_values(c: np.ndarray) -> np.ndarray:
    return (np.asarray(c).astype(np.uint32) << 16).view(np.float32).astype(np.float64)


#: exponent bits, mantissa bits, bias, largest code, its value: fixed values of the two formats
FP8 = {"e4m3": (4, 3, 7, 0x7E, 448.0), "e5m2": (5, 2, 15, 0x7C, 65536.0)}


def fp8_values(kind: str) -> np.ndarray:
    """Value of each of the 256 codes."""
    exp_bits, man_bits, bias, _, _ = FP8[kind]
    code = np.arange(256)
    exp, man = (code >> man_bits) & (2**exp_bits - 1), code & (2**man_bits - 1)
    size = (1 + man / 2**man_bits) * 2.0 ** (exp - bias)
    size[(exp == 0) & (man == 0)] = 0
    return np.where(code >> 7, -size, size)


def fp8_codes(x: np.ndarray, kind: str) -> np.ndarray:
    """Nearest code (halves away from zero, carrying into the exponent); too small is zero, too large the largest."""
    exp_bits, man_bits, bias, top, _ = FP8[kind]
    x = np.asarray(x, dtype=np.float64)
    size = np.abs(np.nan_to_num(x, nan=0.0, posinf=1e30, neginf=-1e30))
    with np.errstate(divide="ignore"):
        exp = np.floor(np.log2(np.where(size > 0, size, 1)))
    man = np.floor((size / 2.0**exp - 1) * 2**man_bits + 0.5)
    exp, man = np.where(man == 2**man_bits, exp + 1, exp), np.where(man == 2**man_bits, 0, man)
    code = ((exp + bias) * 2**man_bits + man).astype(np.int64)
    code = np.where((size == 0) | (exp + bias < 1), 0, np.minimum(code, top))
    return (code | np.where(np.signbit(x), 0x80, 0)).astype(np.int32)


@F.pandas_udf(INTS)
def to_bf16(v: pd.Series) -> pd.Series:
    return _flat(v, bf16_codes, np.float32)


@F.pandas_udf(DOUBLES)
def from_bf16(c: pd.Series) -> pd.Series:
    return _flat(c, bf16_values, np.int32)


@F.pandas_udf(DOUBLES)
def through_f16(v: pd.Series) -> pd.Series:
    """Values after a round trip through IEEE half precision."""
    return _flat(v, lambda x: x.astype(np.float16).astype(np.float64), np.float32)


def to_fp8(kind: str = "e4m3", scale: float = 1.0):
    """A pandas UDF: array of numbers to array of codes of value * scale."""
    if kind not in FP8:
        raise InvalidArgument(f"unknown format {kind}")

    @F.pandas_udf(INTS)
    def run(v: pd.Series) -> pd.Series:
        return _flat(v, lambda x: fp8_codes(x * scale, kind), np.float64)

    return run


def from_fp8(codes: Column, kind: str = "e4m3", scale: float = 1.0) -> Column:
    table = F.array(*[F.lit(float(x)) for x in fp8_values(kind)])
    return F.transform(codes, lambda c: F.get(table, c) / scale)


def fp8_scale(most: float, kind: str = "e4m3") -> float:
    return FP8[kind][4] / most if most > 0 else 1.0
