"""Gaussian mixtures by expectation maximisation over a distributed table."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.operators.knn import stack
from quillan.operators.sampling import sample
from quillan.schema import DOUBLES, INT, extended

from .kmeans import SEED_ROWS, seed_centers

KINDS = ("diagonal", "full", "spherical")


@dataclass(frozen=True)
class Mixture:
    kind: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -np.inf
    steps: int = 0

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row and component."""
        n, d = x.shape
        out = np.empty((n, len(self.weights)))
        for c, (w, m, v) in enumerate(zip(self.weights, self.means, self.covariances)):
            if self.kind == "full":
                sign, log_det = np.linalg.slogdet(v)
                far = np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(v), x - m) if sign > 0 else np.full(n, np.inf)
            else:
                v = np.broadcast_to(v, (d,))
                log_det, far = np.log(v).sum(), ((x - m) ** 2 / v).sum(1)
            with np.errstate(divide="ignore"):
                out[:, c] = np.log(w) - 0.5 * (d * np.log(2 * np.pi) + log_det + far)
        return out

    def share(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log likelihood of each row)"""
        parts = self.log_parts(x)
        top = parts.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(parts - top).sum(1))
        return np.exp(parts - total[:, None]), total

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with component (the last of equals) and shares."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    r, _ = shared.value.share(stack(b.column("vec")))
                    best = r.shape[1] - 1 - r[:, ::-1].argmax(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(list(r), pa.list_(pa.float64()))], [*b.schema.names, "component", "shares"])

        return rows.mapInArrow(run, extended(rows.schema, component=INT, shares=DOUBLES))

    def sample(self, n: int, seed: int = 42) -> np.ndarray:
        rng = np.random.default_rng(seed)
        of = rng.choice(len(self.weights), n, p=self.weights / self.weights.sum())
        d = self.means.shape[1]
        out = rng.normal(size=(n, d))
        for c in range(len(self.weights)):
            v = self.covariances[c]
            mine = of == c
            out[mine] = self.means[c] + (out[mine] @ np.linalg.cholesky(v).T if self.kind == "full" else out[mine] * np.sqrt(np.broadcast_to(v, (d,))))
        return out


def _sums(rows: DataFrame, model: Mixture):
    """(mass, sum of r x, sum of r x x or r x x', log likelihood) over the table."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k, d = model.means.shape
    full = model.kind == "full"

    def run(batches):
        body, total = np.zeros((k, 1 + d + (d * d if full else d))), 0.0
        for b in batches:
            x = stack(b.column("vec"))
            if len(x):
                r, ll = shared.value.share(x)
                total += ll.sum()
                second = np.stack([((x * r[:, c : c + 1]).T @ x).ravel() for c in range(k)]) if full else r.T @ (x * x)
                body += np.column_stack([r.sum(0), r.T @ x, second])
        flat = np.append(body.ravel(), total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

    got = np.zeros(k * (1 + d + (d * d if full else d)) + 1)
    for i, x in rows.select("vec").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
        got[i] = x
    shared.unpersist()
    body = got[:-1].reshape(k, -1)
    return body[:, 0], body[:, 1 : d + 1], body[:, d + 1 :], float(got[-1])


def step(rows: DataFrame, model: Mixture, ridge: float = 1e-6) -> Mixture:
    """The mixture after one step of expectation and maximisation, with the log likelihood of the one before."""
    mass, first, second, ll = _sums(rows, model)
    d = model.means.shape[1]
    weights, means, cov = model.weights.copy(), model.means.copy(), model.covariances.copy()
    for c in np.flatnonzero(mass >= 1e-10):
        m = first[c] / mass[c]
        means[c], weights[c] = m, mass[c] / mass.sum()
        if model.kind == "full":
            cov[c] = second[c].reshape(d, d) / mass[c] - np.outer(m, m) + ridge * np.eye(d)
        else:
            v = np.maximum(second[c] / mass[c] - m * m, 0)
            cov[c] = (v if model.kind == "diagonal" else v.mean()) + ridge
    return Mixture(model.kind, weights, means, cov, ll, model.steps + 1)


def fit(rows: DataFrame, components: int = 8, kind: str = "diagonal", steps: int = 100, tol: float = 1e-3, ridge: float = 1e-6, seed: int = 42) -> Mixture:
    """Means start by k-means++ on a sample, covariances as units; stops once the log likelihood changes by less than tol."""
    if kind not in KINDS:
        raise InvalidArgument(f"kind is one of {KINDS}")
    pool = sample(rows, SEED_ROWS).select("vec").toArrow().combine_chunks()
    if pool.num_rows < components:
        raise InvalidArgument(f"{components} components need as many rows")
    x = stack(pool["vec"].combine_chunks())
    d = x.shape[1]
    unit = np.stack([np.eye(d)] * components) if kind == "full" else np.ones((components, d if kind == "diagonal" else 1))
    model = Mixture(kind, np.full(components, 1 / components), seed_centers(x, components, np.random.default_rng(seed)), unit)
    for number in range(1, steps + 1):
        after = step(rows, model, ridge)
        if abs(after.log_likelihood - model.log_likelihood) < tol:
            return replace(model, log_likelihood=after.log_likelihood, steps=number)
        model = replace(after, steps=number)
    return model
