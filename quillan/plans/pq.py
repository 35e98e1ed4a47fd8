"""Product quantization: codebooks, codes, lookup tables, asymmetric distances.

Codebooks are trained on a hash sample of at most ``sample_rows`` vectors and
are small (subspaces x codes x width).  Encoding and scoring stream over
Arrow batches; scoring has a Catalyst twin for plain tables of codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillan.errors import InvalidArgument
from quillan.functions.bits import pack_nibbles, unpack_nibbles
from quillan.functions.vectors import fold
from quillan.operators.crossed import Scorer, by_columns
from quillan.operators.knn import stack
from quillan.operators.sampling import sample
from quillan.schema import DOUBLES, SHORTS, extended

from .kmeans import fit_local

SAMPLE_ROWS = 100_000


@dataclass(frozen=True)
class Codebook:
    """One matrix of centroids a subspace; subspaces are equal slices of the vector."""

    parts: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.parts[0].shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid in each subspace, the lower code on a tie, 0 where there is none."""
        out = np.zeros((len(x), len(self.parts)), dtype=np.int16)
        for s, c in enumerate(self.parts):
            sub = x[:, s * self.width : (s + 1) * self.width]
            d = ((sub[:, None, :] - c[None, :, :]) ** 2).sum(2) if len(c) * sub.size < 4e6 else (sub**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * sub @ c.T
            out[:, s] = np.nan_to_num(d, nan=np.inf).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, s]] for s, c in enumerate(self.parts)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of each query's slices to all centroids: queries x subspaces x codes, infinity where a code is unused."""
        most = max(len(c) for c in self.parts)
        out = np.full((len(q), len(self.parts), most), np.inf)
        for s, c in enumerate(self.parts):
            d = np.zeros((len(q), len(c)))
            for i in range(self.width):
                d += (q[:, s * self.width + i, None] - c[None, :, i]) ** 2
            out[:, s, : len(c)] = d
        return out

    def table(self, spark) -> DataFrame:
        """(subspace, code, centroid)"""
        rows = [(s, i, [float(x) for x in v]) for s, c in enumerate(self.parts) for i, v in enumerate(c)]
        return spark.createDataFrame(rows, "subspace int, code int, centroid array<double>")

    @staticmethod
    def of(table: DataFrame) -> Codebook:
        rows = sorted((r["subspace"], r["code"], r["centroid"]) for r in table.collect())
        parts: dict[int, list] = {}
        for s, _, c in rows:
            parts.setdefault(s, []).append(c)
        return Codebook(tuple(np.array(parts[s]) for s in sorted(parts)))


def train_matrix(x: np.ndarray, subspaces: int = 8, codes: int = 256, steps: int = 100, tol: float = 1e-5, seed: int = 42) -> Codebook:
    if codes > 256 or codes < 1:
        raise InvalidArgument("a code is one byte: 1 to 256 codes")
    if x.shape[1] % subspaces:
        raise InvalidArgument(f"{x.shape[1]} elements do not divide into {subspaces} subspaces")
    w = x.shape[1] // subspaces
    return Codebook(tuple(fit_local(x[:, s * w : (s + 1) * w], codes, steps, tol, seed + s).centers for s in range(subspaces)))


def _pool(rows: DataFrame, sample_rows: int) -> np.ndarray:
    got = sample(rows, sample_rows).select("vec").toArrow().combine_chunks()
    if not got.num_rows:
        raise InvalidArgument("no rows to train on")
    return stack(got["vec"].combine_chunks())


def train(rows: DataFrame, subspaces: int = 8, codes: int = 256, steps: int = 100, tol: float = 1e-5, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> Codebook:
    return train_matrix(_pool(rows, sample_rows), subspaces, codes, steps, tol, seed)


def _lists(x: np.ndarray, kind) -> pa.Array:
    flat = pa.array(x.ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def map_vectors(rows: DataFrame, f, name: str, kind: T.ArrayType, vec_col: str = "vec") -> DataFrame:
    """rows with a column: f of the matrix of vectors, batch by batch."""
    arrow = pa.int16() if kind == SHORTS else pa.float64()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(f(stack(b.column(vec_col))), arrow)], [*b.schema.names, name])

    return rows.mapInArrow(run, extended(rows.schema, **{name: kind}))


def encode(rows: DataFrame, book: Codebook) -> DataFrame:
    """rows (id, vec, ...) with codes."""
    return map_vectors(rows, book.encode, "codes", SHORTS)


def decode(coded: DataFrame, book: Codebook) -> DataFrame:
    return map_vectors(coded, lambda c: book.decode(c.astype(np.int64)), "decoded", DOUBLES, "codes")


def with_tables(queries: DataFrame, book: Codebook) -> DataFrame:
    """queries (id, vec) with lut: array of one array of distances a subspace."""
    flat = map_vectors(queries, lambda q: book.tables(q).reshape(len(q), -1), "_lut", DOUBLES)
    m, n = len(book.parts), max(len(c) for c in book.parts)
    return flat.withColumn("lut", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda s: F.slice("_lut", s * n + 1, n))).drop("_lut")


def adc(codes: Column, lut: Column) -> Column:
    """Asymmetric distance: the table entries of the codes, summed."""
    return fold(F.zip_with(codes, lut, lambda c, t: F.get(t, c.cast("int"))))


def to_int8(lut: Column) -> Column:
    """(codes, scale, low): table entries as 0 to 255 over the whole table's range."""
    flat = F.flatten(lut)
    low, high = F.array_min(flat), F.array_max(flat)
    scale = F.when(high > low, 255.0 / (high - low)).otherwise(F.lit(1.0))
    return F.struct(F.transform(lut, lambda t: F.transform(t, lambda x: F.floor((x - low) * scale + 0.5).cast("smallint"))).alias("codes"), scale.alias("scale"), low.alias("low"))


def adc_int8_raw(codes: Column, lut8: Column) -> Column:
    """Sum of 8-bit entries; ranks as the distance does."""
    return F.aggregate(F.zip_with(codes, lut8["codes"], lambda c, t: F.get(t, c.cast("int"))), F.lit(0), lambda a, x: a + x)


def adc_int8(codes: Column, lut8: Column) -> Column:
    return adc_int8_raw(codes, lut8) / lut8["scale"] + lut8["low"] * F.size(codes)


class Lookup(Scorer):
    """Asymmetric distances of vectors to codes: table entries, summed; null where the vector or the codes are."""

    column = "codes"

    def __init__(self, book: Codebook):
        self.book = book

    def ask(self, column):
        own, bad = by_columns(column, len(self.book.parts) * self.book.width)
        return [None if out else t for t, out in zip(self.book.tables(own.T), bad)]

    def score(self, asked, column):
        x, bad = by_columns(column, len(self.book.parts))
        codes, bad = x.astype(np.intp), bad if bad.any() else None
        for table in asked:
            if table is None:
                yield self._none(len(column)), np.ones(len(column), bool)
            else:
                yield self._one(table, codes), bad

    def _none(self, n: int) -> list[np.ndarray]:
        return [np.zeros(n)]

    def _one(self, table: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        return [_entries(table, codes)]


class Lookup8(Lookup):
    """The same through tables of 8-bit entries, made as ``to_int8`` does from the entries in use."""

    fields = "raw int, dist double"

    def ask(self, column):
        out = []
        for t in super().ask(column):
            if t is not None and (np.isnan(t).any() or np.isinf(t).all()):  # the vector is not finite, nor any distance
                t = np.zeros(t.shape, np.int32), 1.0, t.min()
            elif t is not None:
                used = t[np.isfinite(t)]
                low, high = used.min(), used.max()
                scale = 255.0 / (high - low) if high > low else 1.0
                t = np.floor((np.where(np.isfinite(t), t, high) - low) * scale + 0.5).astype(np.int32), scale, low
            out.append(t)
        return out

    def _none(self, n):
        return [np.zeros(n, np.int32), np.zeros(n)]

    def _one(self, table, codes):
        entries, scale, low = table
        raw = _entries(entries, codes)
        return [raw, raw / scale + low * len(codes)]


def _entries(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One entry of each row of the table, summed."""
    out = np.zeros(codes.shape[1], table.dtype)
    for entries, at in zip(table, codes):
        out += entries[at]
    return out


def pack4(codes: Column) -> Column:
    """Codes 0 to 15, two to a byte, the first in the low nibble."""
    return pack_nibbles(codes.cast("array<int>"))


def unpack4(packed: Column, number: int) -> Column:
    return F.slice(unpack_nibbles(packed), 1, number).cast("array<smallint>")


def adc_packed(packed: Column, lut: Column) -> Column:
    """Distance straight from packed 4-bit codes."""
    return adc(F.slice(unpack_nibbles(packed), F.lit(1), F.size(lut)), lut)


@dataclass(frozen=True)
class Stacked:
    """Codebooks in levels; each codes what the levels before it left over."""

    levels: tuple[Codebook, ...]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of all levels, one after the other."""
        out, rest = [], x
        for book in self.levels:
            c = book.encode(rest)
            out.append(c)
            rest = rest - book.decode(c)
        return np.concatenate(out, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        total, at = 0.0, 0
        for book in self.levels:
            m = len(book.parts)
            total = total + book.decode(codes[:, at : at + m])
            at += m
        return total

    def error(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.norm(x - self.decode(self.encode(x)), axis=1)


def train_stacked(rows: DataFrame, levels: int = 2, subspaces: int = 8, codes: int = 256, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> Stacked:
    rest = _pool(rows, sample_rows)
    books = []
    for level in range(levels):
        book = train_matrix(rest, subspaces, codes, seed=seed + level)
        books.append(book)
        rest = rest - book.decode(book.encode(rest))
    return Stacked(tuple(books))


def train_additive(rows: DataFrame, levels: int = 2, codes: int = 256, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> Stacked:
    """Levels of whole-vector codebooks."""
    return train_stacked(rows, levels, 1, codes, seed, sample_rows)
