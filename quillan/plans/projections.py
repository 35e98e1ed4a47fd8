"""Linear projections of vector columns.

Fitting needs the Gram matrix alone (d x d on the driver); applying is one
matrix product an Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillan.errors import InvalidArgument
from quillan.operators.statistics import moments

from quillan.schema import DOUBLES

from .pq import map_vectors


@dataclass(frozen=True)
class Linear:
    """y = (x - mean) W, and back by the transpose where W's columns are orthonormal."""

    weights: np.ndarray
    mean: np.ndarray
    variance: np.ndarray | None = None
    invertible: bool = True

    def __call__(self, rows: DataFrame, name: str = "projected") -> DataFrame:
        w, m = self.weights, self.mean
        return map_vectors(rows, lambda x: (x - m) @ w, name, DOUBLES)

    def inverse(self, rows: DataFrame, name: str = "restored", vec_col: str = "projected", single: bool = False) -> DataFrame:
        """The way back is right to about 1e-15 of a vector's length.

        ``single`` takes each element to the nearest 32-bit float: where the
        vectors were such floats, that gives them back without an error (but
        for elements under 1e-8 of the length).
        """
        if not self.invertible:
            raise InvalidArgument("this projection has no inverse")
        w, m, kind = self.weights.T, self.mean, np.float32 if single else np.float64
        return map_vectors(rows, lambda y: (y @ w + m).astype(kind), name, DOUBLES, vec_col)


def identity(dim: int) -> Linear:
    return Linear(np.eye(dim), np.zeros(dim))


def _eigen(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending, vectors with their largest element positive."""
    values, vectors = np.linalg.eigh(g)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(g))])
    return values, vectors * np.where(sign == 0, 1, sign)


def pca(rows: DataFrame, components: int) -> Linear:
    n, mean, g = moments(rows)
    if n < 2 or not 1 <= components <= min(n, len(mean)):
        raise InvalidArgument(f"{components} components of {n} rows with {len(mean)} elements")
    values, vectors = _eigen((g - n * np.outer(mean, mean)) / (n - 1))
    return Linear(vectors[:, :components], mean, np.maximum(values[:components], 0))


def random_orthogonal(dim: int, out: int, seed: int = 42) -> Linear:
    """Columns of a random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).uniform(-1, 1, (max(dim, out), max(dim, out))))
    return Linear((q * np.sign(np.diag(r)))[:dim, :out], np.zeros(dim))


def gaussian(dim: int, out: int, seed: int = 42) -> Linear:
    return Linear(np.random.default_rng(seed).normal(0, 1 / np.sqrt(out), (dim, out)), np.zeros(dim), invertible=False)


def sparse(dim: int, out: int, density: float | None = None, seed: int = 42) -> Linear:
    """Elements +s, -s or 0, with s = sqrt(1 / (density * out)); density is 1 / sqrt(dim) unless given."""
    density = density or 1 / np.sqrt(dim)
    draw = np.random.default_rng(seed).random((dim, out))
    scale = np.sqrt(1 / (density * out))
    return Linear(np.where(draw < density / 2, scale, np.where(draw < density, -scale, 0.0)), np.zeros(dim), invertible=False)


def opq(rows: DataFrame, subspaces: int = 8, steps: int = 20, seed: int = 42) -> Linear:
    """A rotation whose subspaces are uncorrelated inside: block eigenvectors of the rotated Gram matrix, repeated."""
    _, mean, g = moments(rows)
    d = len(mean)
    if not d or d % subspaces:
        raise InvalidArgument(f"{d} elements do not divide into {subspaces} subspaces")
    turn = random_orthogonal(d, d, seed).weights
    w = d // subspaces
    for _ in range(steps):
        h = turn.T @ g @ turn
        step = np.zeros((d, d))
        for s in range(0, d, w):
            step[s : s + w, s : s + w] = _eigen(h[s : s + w, s : s + w])[1]
        turn = turn @ step
        if np.allclose(np.abs(step).max(0), 1):
            break
    return Linear(turn, np.zeros(d))


def chunked(parts: list[Linear]) -> Linear:
    """Projections of consecutive chunks, side by side."""
    rows, cols = sum(len(p.weights) for p in parts), sum(p.weights.shape[1] for p in parts)
    w, at = np.zeros((rows, cols)), [0, 0]
    for p in parts:
        a, b = p.weights.shape
        w[at[0] : at[0] + a, at[1] : at[1] + b] = p.weights
        at = [at[0] + a, at[1] + b]
    return Linear(w, np.concatenate([p.mean for p in parts]), invertible=all(p.invertible for p in parts))
