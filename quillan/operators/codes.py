"""Search over stored codes, without a table of decoded vectors.

A coded table is (id, codes).  Scalar codes stand for ``low + c * scale``, so
products with a query need the codes and one prepared query alone; 8-bit and
16-bit floats are looked up as a batch is read.  Scans, ranking and limits are
those of ``knn``: queries are broadcast in bounded blocks, the coded table is
never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.functions.distance import Measure
from quillan.functions.distance import matrix as distances
from quillan.functions.quantize import ScalarParams, bf16_values, fp8_values

from .knn import RESULT, Payload, ranked, scan, vectors


@dataclass(frozen=True)
class Prepared:
    """What a block of queries needs against scalar codes: scaled queries, their share of the offset, squared lengths."""

    scaled: np.ndarray
    offset: np.ndarray
    norms: np.ndarray

    def dots(self, codes: np.ndarray) -> np.ndarray:
        return self.scaled @ codes.T + self.offset[:, None]


class ScalarCodes(Payload):
    """8-bit and shorter codes of one range."""

    column, bytes_each = "codes", 1

    def __init__(self, params: ScalarParams):
        self.params = params

    def values(self, x: np.ndarray) -> np.ndarray:
        return x * self.params.scale + self.params.low

    def prepare(self, q: np.ndarray) -> Prepared:
        return Prepared(q * self.params.scale, q.sum(1) * self.params.low, (q**2).sum(1))

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of what the codes stand for, from sums of codes."""
        low, scale = self.params.low, self.params.scale
        return codes.shape[1] * low * low + 2 * low * scale * codes.sum(1) + scale * scale * (codes * codes).sum(1)

    def matrix(self, measure: Measure, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        prepared = self.prepare(q)
        if measure in (Measure.DOT, Measure.GENERAL_INNER_PRODUCT):
            return -prepared.dots(codes)
        if measure in (Measure.L2, Measure.SQUARED_L2):
            d = np.maximum(prepared.norms[:, None] + self.norms(codes)[None, :] - 2 * prepared.dots(codes), 0)
            return np.sqrt(d) if measure is Measure.L2 else d
        if measure is Measure.COSINE:
            size = np.sqrt(prepared.norms)[:, None] * np.sqrt(self.norms(codes))[None, :]
            return np.where(size == 0, 1.0, 1 - prepared.dots(codes) / np.where(size == 0, 1.0, size))
        return distances(measure, q, self.values(codes))


class Bf16Codes(Payload):
    column, bytes_each = "codes", 2

    def values(self, x: np.ndarray) -> np.ndarray:
        return bf16_values(x.astype(np.int64))


class Fp8Codes(Payload):
    """Codes of value * scale in one of the two 8-bit formats."""

    column, bytes_each = "codes", 1

    def __init__(self, kind: str = "e4m3", scale: float = 1.0):
        self.table = fp8_values(kind) / scale

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.table[x.astype(np.int64)]


def nearest(coded: DataFrame, queries: DataFrame, payload: Payload, k: int = 10, measure: Measure | str = Measure.SQUARED_L2) -> DataFrame:
    """(qid, id, dist, rank): float queries (id, vec) against coded rows (id, codes)."""
    if k <= 0:
        return coded.sparkSession.createDataFrame([], RESULT + ", rank int")
    return ranked(scan(_valid(coded), vectors(queries, "id", "vec"), Measure(measure), k, None, payload), k)


def within(coded: DataFrame, queries: DataFrame, payload: Payload, radius: float, measure: Measure | str = Measure.SQUARED_L2) -> DataFrame:
    """(qid, id, dist): coded rows at most ``radius`` away."""
    return scan(_valid(coded), vectors(queries, "id", "vec"), Measure(measure), None, radius, payload).where(F.col("dist") <= radius)


def _valid(coded: DataFrame) -> DataFrame:
    return coded.select(F.col("id").cast("long").alias("id"), "codes").where("id is not null and codes is not null")


def memory(coded: DataFrame, payload: Payload, norms: bool = True) -> DataFrame:
    """(n, bytes, float_bytes, ratio): size of the codes, with one float of length a row unless told otherwise, and against float32."""
    if payload.column != "codes":
        raise InvalidArgument("these are no codes")
    size = coded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("elements"))
    codes = F.col("elements") * payload.bytes_each
    return size.select("n", (codes + F.col("n") * (4 if norms else 0)).alias("bytes"), (F.col("elements") * 4).alias("float_bytes"), F.when(codes > 0, F.col("elements") * 4 / codes).otherwise(0.0).alias("ratio"))
