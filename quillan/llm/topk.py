"""Exact top-k inner products by descending vector length.

Vectors are rotated by the eigenvectors of the table's Gram matrix, so that
the first coordinates hold most of the length.  A first block of the longest
vectors gives each query a lower bound for its k-th score.  Then every
partition is sorted by descending length and read from the front: a vector is
left out when |q||v| is below the bound, or when the partial product over the
leading coordinates plus the product of the residual lengths (Cauchy-Schwarz)
is; once |q||v| is below the bound of every query, the rest of the partition is
not looked at.  What is left is scored exactly in integers.  Pruning never
changes a result.

Queries go to the executors in blocks of at most ``query_bytes``, so the
broadcast size is bounded; each block is one pass over the table.  Vectors are
taken in steps of at most ``CELLS`` vector-query pairs, which bounds the
matrices of a task whatever the numbers of queries and vectors.

Cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; vectors of unequal length are compared as if
padded with zeros; rows that repeat a query's id are not its candidates;
repeated candidate rows keep one result each; a query id with several vectors
gets the highest scores of all of them; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 1024
#: pairs of a vector and a query that a task holds at a time, 8 bytes for each in every matrix
CELLS, STEP = 2_000_000, 2048


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as float64 rows, padded with zeros to dim; exact for the scaled integers."""
    offsets = np.asarray(column.offsets)
    size = np.diff(offsets)
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(column), dim))
    if len(flat):
        row = np.repeat(np.arange(len(column)), size)
        within = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
        out[row, within] = flat
    return out


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the valid rows with components floor(1024 * x)."""
    v = F.col(vec_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).alias("vec_id"), v.alias("x")).where("vec_id is not null and x is not null")
    clean = clean.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return clean.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))


def rotation(points: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, largest eigenvalue first; dim x dim."""

    def partial(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim)
            total += m.T @ m
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "g"])

    gram = np.zeros((dim, dim))
    for i, j, g in points.select("v").mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g")).collect():
        gram[i, j] = gram[j, i] = g
    values, vectors = np.linalg.eigh(gram)
    return np.ascontiguousarray(vectors[:, ::-1])


class _Block:
    """A block of queries with what the bounds need."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, lead: int, k: int):
        self.ids, self.q, self.turn, self.lead, self.k = ids, q, turn, lead, k
        r = q @ turn
        self.head = np.ascontiguousarray(r[:, :lead].T)
        self.rest = np.sqrt(np.maximum(0, (r[:, lead:] ** 2).sum(1)))
        self.norm = np.sqrt((q**2).sum(1))
        self.floor = np.full(len(ids), -np.inf)

    @staticmethod
    def nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def best(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of (query, id, score) triples for each query; raises the bounds."""
        qi, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -s, qi))
        qi, ids, s = qi[order], ids[order], s[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        kth = rank == self.k - 1
        self.floor[qi[kth]] = np.maximum(self.floor[qi[kth]], s[kth])
        keep = rank < self.k
        return qi[keep], ids[keep], s[keep]

    def step(self) -> int:
        return max(1, min(STEP, CELLS // len(self.ids)))

    def scan(self, ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """All pairs of a vector and a query that the bounds let through and that reach the query's floor.

        The vectors come by descending length; None says that no query needs these or shorter ones.
        """
        norm = np.sqrt((c**2).sum(1))
        live = np.flatnonzero(self.norm * norm[0] * (1 + 1e-9) + 1e-3 >= self.floor)
        if not len(live):
            return None
        # The longest prefix of vectors that some query still needs.
        need = np.where(self.norm[live] > 0, self.floor[live] / np.maximum(self.norm[live], 1e-12), -np.inf)
        upto = int(np.searchsorted(-norm, -(need.min() * (1 - 1e-9) - 1e-3), side="right"))
        ids, c, norm = ids[:upto], c[:upto], norm[:upto]
        r = c @ self.turn
        rest = np.sqrt(np.maximum(0, (r[:, self.lead :] ** 2).sum(1)))
        bound = r[:, : self.lead] @ self.head[:, live] + rest[:, None] * self.rest[live][None, :]
        mask = bound * (1 + 1e-9 * np.sign(bound)) + 1e-2 >= self.floor[live][None, :]
        if mask.mean() > 0.05:
            score = c @ self.q[live].T
            ci, li = np.nonzero(mask & (score >= self.floor[live][None, :]))
            s = score[ci, li]
        else:
            ci, li = np.nonzero(mask)
            s, wide = np.empty(len(ci)), max(1, CELLS // max(1, c.shape[1]))
            for at in range(0, len(ci), wide):
                s[at : at + wide] = np.einsum("ij,ij->i", c[ci[at : at + wide]], self.q[live[li[at : at + wide]]])
            keep = s >= self.floor[live[li]]
            ci, li, s = ci[keep], li[keep], s[keep]
        other = ids[ci] != self.ids[live[li]]
        return live[li[other]], ids[ci[other]], s[other]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", lead: int = 16, query_bytes: int = 32 << 20, first_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the rows of vectors."""
    spark = vectors.sparkSession
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    points = scaled(vectors, id_col, vec_col).withColumn("n", length)
    asked = scaled(queries, id_col, vec_col).distinct()
    schema = "query_id long, vec_id long, score long"
    dim, total = asked.select(F.max(F.size("v")), F.count(F.lit(1))).first()
    wide = points.select(F.max(F.size("v"))).first()[0]
    if not total or wide is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, wide, 1)
    turn = rotation(points, dim)
    head = points.orderBy(F.desc("n"), "vec_id").limit(first_block).select("vec_id", "v").toArrow().combine_chunks()
    head_ids = np.asarray(head["vec_id"].combine_chunks()) if head.num_rows else np.zeros(0, np.int64)
    head_rows = _matrix(head["v"].combine_chunks(), dim) if head.num_rows else np.zeros((0, dim))
    blocks = -(-total // max(1, query_bytes // (8 * dim)))
    ordered = points.sortWithinPartitions(F.desc("n")).select("vec_id", "v")
    ordered = cut(ordered) if blocks > 1 else ordered
    parts = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = own.toArrow()
        if not got.num_rows:
            continue
        ids = np.asarray(got["vec_id"].combine_chunks())
        block = _Block(ids, _matrix(got["v"].combine_chunks(), dim), turn, min(lead, dim), k)
        have = block.nothing()
        for at in range(0, len(head_ids), block.step()):
            got = block.scan(head_ids[at : at + block.step()], head_rows[at : at + block.step()])
            if got is None:
                break
            have = block.best([have, got])
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            start = block.floor
            block.floor = start.copy()
            have = block.nothing()
            for at, ids, rows in ((at, x.column("vec_id"), x.column("v")) for x in batches for at in range(0, x.num_rows, block.step())):
                got = block.scan(np.asarray(ids.slice(at, block.step())), _matrix(rows.slice(at, block.step()), dim))
                if got is None:
                    break
                have = block.best([have, got])
            block.floor = start  # the next task of this worker starts from the shared bounds
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[have[0]]), pa.array(have[1]), pa.array(have[2].astype(np.int64))], ["query_id", "vec_id", "score"])

        part = ordered.mapInArrow(run, schema)
        if blocks > 1:
            part = cut(_ranked(part, k))
            shared.unpersist()
        else:
            part = _ranked(part, k)
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
