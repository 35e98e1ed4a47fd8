"""Distance measures; lower is nearer for all of them.

``distance`` is a Catalyst expression on two dense columns, ``sparse_distance``
one on two sparse structs, ``pairs`` the NumPy twin for Arrow batches.
"""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument

from .vectors import doubles, fold, sparse_map, squared_norm


class Measure(str, Enum):
    L1 = "l1"
    L2 = "l2"
    SQUARED_L2 = "squared_l2"
    DOT = "dot"
    COSINE = "cosine"
    HAMMING = "hamming"
    JACCARD = "jaccard"
    DICE = "dice"
    LIMITED_INNER_PRODUCT = "limited_inner_product"
    GENERAL_INNER_PRODUCT = "general_inner_product"
    NON_ZERO_INTERSECT = "non_zero_intersect"

    @property
    def requires_sparse(self) -> bool:
        return self in (Measure.JACCARD, Measure.DICE)

    @property
    def lower_is_better(self) -> bool:
        return True


def _zip(a: Column, b: Column, f) -> Column:
    return fold(F.zip_with(doubles(a), doubles(b), f))


def dot(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.abs(x - y))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    na, nb = squared_norm(a), squared_norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def distance(measure: Measure | str, a: Column, b: Column, dense_fallback: bool = False) -> Column:
    """Jaccard and Dice compare sets; on dense vectors they are squared L2, if that is asked for."""
    measure = Measure(measure)
    if measure.requires_sparse:
        if not dense_fallback:
            raise InvalidArgument(f"{measure.value} needs sparse vectors")
        return squared_l2(a, b)
    if measure is Measure.L1:
        return l1(a, b)
    if measure is Measure.L2:
        return F.sqrt(squared_l2(a, b))
    if measure is Measure.SQUARED_L2:
        return squared_l2(a, b)
    if measure in (Measure.DOT, Measure.GENERAL_INNER_PRODUCT):
        return -dot(a, b)
    if measure is Measure.COSINE:
        return 1 - cosine_similarity(a, b)
    if measure is Measure.HAMMING:
        return _zip(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))
    if measure is Measure.NON_ZERO_INTERSECT:
        return -_zip(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0))
    return F.when((squared_norm(a) > 1) | (squared_norm(b) > 1), F.lit(float("inf"))).otherwise(-dot(a, b))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Of two index arrays; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice_coefficient(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 where a set is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def _merged(a: Column, b: Column, f) -> Column:
    zero = F.lit(0.0)
    return F.map_values(F.map_zip_with(sparse_map(a), sparse_map(b), lambda _, x, y: f(F.coalesce(x, zero), F.coalesce(y, zero))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """1 - sum of least / sum of greatest absolute weights; 0 where there is no weight."""
    low = fold(_merged(a, b, lambda x, y: F.least(F.abs(x), F.abs(y))))
    high = fold(_merged(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y))))
    return F.when(high == 0, F.lit(0.0)).otherwise(1 - low / high)


def sparse_dot(a: Column, b: Column) -> Column:
    return fold(_merged(a, b, lambda x, y: x * y))


def sparse_distance(measure: Measure | str, a: Column, b: Column) -> Column:
    measure = Measure(measure)
    if measure is Measure.JACCARD:
        return 1 - jaccard_similarity(a["indices"], b["indices"])
    if measure is Measure.DICE:
        return 1 - dice_coefficient(a["indices"], b["indices"])
    if measure is Measure.L1:
        return fold(_merged(a, b, lambda x, y: F.abs(x - y)))
    if measure in (Measure.L2, Measure.SQUARED_L2):
        d = fold(_merged(a, b, lambda x, y: (x - y) * (x - y)))
        return F.sqrt(d) if measure is Measure.L2 else d
    if measure is Measure.HAMMING:
        raise InvalidArgument("hamming needs dense vectors")
    if measure is Measure.NON_ZERO_INTERSECT:
        return -fold(_merged(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))
    na, nb = squared_norm(a["vals"]), squared_norm(b["vals"])
    if measure is Measure.COSINE:
        return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - sparse_dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))
    if measure is Measure.LIMITED_INNER_PRODUCT:
        return F.when((na > 1) | (nb > 1), F.lit(float("inf"))).otherwise(-sparse_dot(a, b))
    return -sparse_dot(a, b)


def pairs(measure: Measure | str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of rows of q to the same rows of x, summed as the Catalyst expression does up to rounding."""
    measure = Measure(measure)
    if measure is Measure.L1:
        return np.abs(q - x).sum(1)
    if measure in (Measure.L2, Measure.SQUARED_L2, Measure.JACCARD, Measure.DICE):
        d = ((q - x) ** 2).sum(1)
        return np.sqrt(d) if measure is Measure.L2 else d
    if measure is Measure.HAMMING:
        return (q != x).sum(1).astype(float)
    if measure is Measure.NON_ZERO_INTERSECT:
        return -((q != 0) & (x != 0)).sum(1).astype(float)
    product = (q * x).sum(1)
    if measure in (Measure.DOT, Measure.GENERAL_INNER_PRODUCT):
        return -product
    nq, nx = (q**2).sum(1), (x**2).sum(1)
    if measure is Measure.COSINE:
        flat = (nq == 0) | (nx == 0)
        return np.where(flat, 1.0, 1 - product / np.where(flat, 1.0, np.sqrt(nq) * np.sqrt(nx)))
    return np.where((nq > 1) | (nx > 1), np.inf, -product)


def matrix(measure: Measure | str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances of rows of q to rows of x; matrix products where the measure allows."""
    measure = Measure(measure)
    if measure in (Measure.L2, Measure.SQUARED_L2, Measure.JACCARD, Measure.DICE):
        d = np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (q @ x.T), 0)
        return np.sqrt(d) if measure is Measure.L2 else d
    if measure in (Measure.DOT, Measure.GENERAL_INNER_PRODUCT):
        return -(q @ x.T)
    if measure is Measure.COSINE:
        nq, nx = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
        scale = nq[:, None] * nx[None, :]
        return np.where(scale == 0, 1.0, 1 - (q @ x.T) / np.where(scale == 0, 1.0, scale))
    if measure is Measure.LIMITED_INNER_PRODUCT:
        far = ((q**2).sum(1) > 1)[:, None] | ((x**2).sum(1) > 1)[None, :]
        return np.where(far, np.inf, -(q @ x.T))
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        out[i] = pairs(measure, row[None, :], x)
    return out
