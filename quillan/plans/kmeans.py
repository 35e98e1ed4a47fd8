"""k-means on vector tables, and trees of it.

Seeding works on a hash sample of at most ``SEED_ROWS`` rows; every Lloyd step
is one pass over the whole table with the centers broadcast, and only
k x d sums a task are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.operators.knn import stack
from quillan.operators.sampling import draw, sample
from quillan.schema import DOUBLE, INT, extended

SEED_ROWS = 20_000


@dataclass(frozen=True)
class Clusters:
    centers: np.ndarray
    inertia: float
    steps: int

    def table(self, spark) -> DataFrame:
        """(partition_id, centroid)"""
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        return spark.createDataFrame(rows, "partition_id int, centroid array<double>")


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance); the lower index wins a tie."""
    d = (x**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * (x @ centers.T)
    at = d.argmin(1)
    return at, ((x - centers[at]) ** 2).sum(1)


def seed_centers(x: np.ndarray, k: int, rng: np.random.Generator, plus: bool = True) -> np.ndarray:
    if not plus:
        return x[rng.choice(len(x), k, replace=False)]
    chosen = [int(rng.integers(len(x)))]
    least = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = least.cumsum()
        at = int(rng.integers(len(x))) if total[-1] == 0 else min(int(np.searchsorted(total, rng.random() * total[-1])), len(x) - 1)
        chosen.append(at)
        least = np.minimum(least, ((x - x[at]) ** 2).sum(1))
    return x[chosen].copy()


def assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rows (id, vec, ...) with cluster and cluster_dist."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))

    def run(batches):
        for b in batches:
            at, d = nearest_center(stack(b.column("vec")), shared.value) if b.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d)], [*b.schema.names, "cluster", "cluster_dist"])

    return rows.mapInArrow(run, extended(rows.schema, cluster=INT, cluster_dist=DOUBLE))


def _step(rows: DataFrame, centers: np.ndarray):
    """(sums, counts, inertia) of one assignment of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    k, d = centers.shape

    def run(batches):
        sums, n, inertia = np.zeros((k, d)), np.zeros(k), 0.0
        for b in batches:
            x = stack(b.column("vec"))
            if len(x):
                at, far = nearest_center(x, shared.value)
                np.add.at(sums, at, x)
                n += np.bincount(at, minlength=k)
                inertia += far.sum()
        body = np.column_stack([sums, n]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(body) + 1, dtype=np.int32)), pa.array(np.append(body, inertia))], ["i", "x"])

    flat = np.zeros(k * (d + 1) + 1)
    for i, x in rows.select("vec").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
        flat[i] = x
    shared.unpersist()
    body = flat[:-1].reshape(k, d + 1)
    return body[:, :d], body[:, d], float(flat[-1])


def fit(rows: DataFrame, k: int, steps: int = 100, tol: float = 1e-5, seed: int = 42, plus: bool = True, restarts: int = 1, start: np.ndarray | None = None) -> Clusters:
    """Best of ``restarts`` runs by inertia, or the one from the centers ``start``; k is at most the number of rows.

    A cluster that lost its rows takes row i mod n of the seeding sample, in
    hash order.  Stops before an update once inertia changes by less than tol.
    """
    pool = sample(rows, SEED_ROWS).select("vec").toArrow().combine_chunks()
    if not pool.num_rows:
        raise InvalidArgument("no rows to cluster")
    x = stack(pool["vec"].combine_chunks())
    k = min(k, len(x)) if start is None else len(start)
    best = None
    for r in range(max(1, restarts) if start is None else 1):
        centers = seed_centers(x, k, np.random.default_rng(seed + r), plus) if start is None else np.asarray(start, dtype=np.float64)
        before, done = np.inf, 0
        for done in range(1, steps + 1):
            sums, n, inertia = _step(rows, centers)
            if np.isfinite(before) and abs(before - inertia) / (before + 1e-10) < tol:
                break
            before = inertia
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[np.arange(k) % len(x)])
        _, _, inertia = _step(rows, centers)
        if best is None or inertia < best.inertia:
            best = Clusters(centers, inertia, done)
    return best


def fit_local(x: np.ndarray, k: int, steps: int = 100, tol: float = 1e-5, seed: int = 42) -> Clusters:
    """The same on a matrix, for small or sampled inputs."""
    k = min(k, len(x))
    centers = seed_centers(x, k, np.random.default_rng(seed))
    before, done = np.inf, 0
    for done in range(1, steps + 1):
        at, far = nearest_center(x, centers)
        inertia = float(far.sum())
        if np.isfinite(before) and abs(before - inertia) / (before + 1e-10) < tol:
            break
        before = inertia
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[np.arange(k) % len(x)])
    return Clusters(centers, float(nearest_center(x, centers)[1].sum()), done)


@dataclass
class Node:
    node_id: int
    parent: int | None
    depth: int
    size: int
    center: np.ndarray
    children: list = field(default_factory=list)
    split: np.ndarray | None = None


class Tree:
    """A k-means tree; leaves in depth-first order are the partitions."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.leaves = []
        stack_ = [0] if nodes else []
        while stack_:
            node = nodes[stack_.pop()]
            if node.children:
                stack_ += reversed(node.children)
            else:
                self.leaves.append(node.node_id)

    def centers(self) -> np.ndarray:
        return np.stack([self.nodes[i].center for i in self.leaves])

    def table(self, spark) -> DataFrame:
        """(node_id, parent_id, depth, size, num_leaves, is_leaf, center)"""
        count: dict[int, int] = {}
        for n in reversed(self.nodes):
            count[n.node_id] = sum(count[c] for c in n.children) if n.children else 1
        rows = [(n.node_id, n.parent, n.depth, n.size, count[n.node_id], not n.children, [float(x) for x in n.center]) for n in self.nodes]
        return spark.createDataFrame(rows, "node_id int, parent_id int, depth int, size long, num_leaves int, is_leaf boolean, center array<double>")

    def nearest_leaves(self, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(leaf number, squared distance) of the k nearest leaves: exact over all leaf centers."""
        d = ((self.centers() - q) ** 2).sum(1)
        order = np.argsort(d, kind="stable")[:k]
        return [(int(i), float(d[i])) for i in order]

    def place(self, rows: DataFrame) -> DataFrame:
        """rows with partition_id: the leaf that descending by nearest split center leads to."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            tree = shared.value
            number = {n: i for i, n in enumerate(tree.leaves)}
            for b in batches:
                x = stack(b.column("vec"))
                at = np.zeros(b.num_rows, dtype=np.int64)
                for node in tree.nodes:
                    if node.children:
                        here = np.flatnonzero(at == node.node_id)
                        if len(here):
                            at[here] = np.array(node.children)[nearest_center(x[here], node.split)[0]]
                leaf = pa.array([number[int(i)] for i in at], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, leaf], [*b.schema.names, "partition_id"])

        return rows.mapInArrow(run, extended(rows.schema, partition_id=INT))


def _step_nodes(placed: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(sums, counts, inertia) of each of the nodes (partition_id) against its own centers, in one pass."""
    shared = placed.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        total = {}
        for b in batches:
            part, x = np.asarray(b.column("partition_id")), stack(b.column("vec"))
            for node in np.unique(part).tolist():
                own = x[part == node]
                at, far = nearest_center(own, shared.value[node])
                k, d = shared.value[node].shape
                body = total.setdefault(node, np.zeros((k, d + 2)))
                np.add.at(body, at, np.column_stack([own, np.ones(len(own)), far]))
        for node, body in total.items():
            flat = body.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), node, dtype=np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["node", "i", "x"])

    held = {node: np.zeros(c.shape[0] * (c.shape[1] + 2)) for node, c in centers.items()}
    rows = placed.where(F.col("partition_id").isin(list(centers))).select("partition_id", "vec")
    got = rows.mapInArrow(run, "node int, i int, x double").groupBy("node", "i").agg(F.sum("x").alias("x")).toArrow()
    for node, i, x in zip(*(got[c].to_pylist() for c in ("node", "i", "x"))):
        held[node][i] = x
    shared.unpersist()
    out = {}
    for node, c in centers.items():
        body = held[node].reshape(len(c), -1)
        out[node] = body[:, :-2], body[:, -2], float(body[:, -1].sum())
    return out


def _fit_nodes(placed: DataFrame, nodes: list[int], k: int, steps: int, tol: float, seed: int) -> dict[int, np.ndarray]:
    """Centers of each node's rows, by Lloyd steps that all nodes share; a node rests once its inertia hardly changes."""
    each = max(4 * k, SEED_ROWS // len(nodes))
    order = Window.partitionBy("partition_id").orderBy(draw(42, "id"), "id")
    mine = placed.where(F.col("partition_id").isin(nodes))
    pool = mine.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("partition_id", "_n", "vec").toArrow().combine_chunks()
    part, number, x = np.asarray(pool["partition_id"].combine_chunks()), np.asarray(pool["_n"].combine_chunks()), stack(pool["vec"].combine_chunks())
    seeds = {node: x[part == node][np.argsort(number[part == node])] for node in nodes}
    centers = {node: seed_centers(s, min(k, len(s)), np.random.default_rng(seed)) for node, s in seeds.items()}
    before, moving = dict.fromkeys(nodes, np.inf), set(nodes)
    for _ in range(steps):
        got = _step_nodes(placed, {node: centers[node] for node in moving})
        for node, (sums, n, inertia) in got.items():
            if np.isfinite(before[node]) and abs(before[node] - inertia) / (before[node] + 1e-10) < tol:
                moving.discard(node)
                continue
            before[node] = inertia
            centers[node] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], seeds[node][np.arange(len(n)) % len(seeds[node])])
        if not moving:
            break
    return centers


def fit_tree(rows: DataFrame, children: int = 100, depth: int = 1, min_leaf: int = 1, steps: int = 100, tol: float = 1e-5, seed: int = 42) -> Tree:
    """Levels are built one after the other, all nodes of a level in the same passes; a node's rows are found by descending the tree so far."""
    n, d = rows.count(), rows.select(F.max(F.size("vec"))).first()[0]
    if not n:
        raise InvalidArgument("no rows to cluster")
    sums, _, _ = _step(rows, np.zeros((1, d)))
    tree = Tree([Node(0, None, 0, n, sums[0] / n)])
    for level in range(depth):
        number = {i: leaf for i, leaf in enumerate(tree.leaves) if tree.nodes[leaf].depth == level and tree.nodes[leaf].size > max(min_leaf, children)}
        if not number:
            break
        placed = tree.place(rows)
        centers = _fit_nodes(placed, list(number), children, steps, tol, seed + level)
        nodes, grown = list(tree.nodes), False
        for i, (sums, count, _) in sorted(_step_nodes(placed, centers).items(), key=lambda x: number[x[0]]):
            node, full = tree.nodes[number[i]], np.flatnonzero(count)
            if len(full) < 2:
                continue
            node.split, grown = centers[i][full], True
            for c in full:
                node.children.append(len(nodes))
                nodes.append(Node(len(nodes), node.node_id, level + 1, int(count[c]), sums[c] / count[c]))
        if not grown:
            break
        tree = Tree(nodes)
    return tree
