"""Exact nearest-neighbour search: one query, batches, radius, all pairs.

A batch is scored in blocks.  Queries are broadcast, at most
``MAX_QUERY_BYTES`` and ``MAX_QUERIES`` at once (more are done in several
passes), each task streams its part of the base table through matrix products
of at most ``CELLS`` distances, keeps k rows a query and passes on only those;
the merge is a window over k rows a task and query.  The base table is never
shuffled; lists of ids and candidates go to it while they have at most
``MAX_CANDIDATES`` rows, beyond that they are joined by a shuffle.  Products only select candidates,
with slack for rounding; distances are computed element by element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillan.errors import InvalidArgument
from quillan.functions.distance import Measure, distance, matrix, pairs
from quillan.functions.vectors import doubles

MAX_QUERY_BYTES, MAX_QUERIES = 64 << 20, 65_536
STEP, CELLS = 2048, 4_000_000
MAX_CANDIDATES = 1 << 20
RESULT = "qid long, id long, dist double"


def vectors(df: DataFrame, id_col: str, vec_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, vec, keep...): rows with an id and a vector without nulls."""
    v = doubles(F.col(vec_col))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), *keep).where("id is not null and vec is not null and not exists(vec, x -> x is null)")


def stack(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def dimension(df: DataFrame, column: str = "vec") -> int | None:
    """Common length of the vectors; None for an empty table."""
    low, high = df.select(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise InvalidArgument(f"vectors of {low} to {high} elements in one table")
    return low


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank from 1; ties by id."""
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_one(base: DataFrame, query: list[float], k: int = 10, measure: Measure | str = Measure.SQUARED_L2, id_col: str = "id", vec_col: str = "vec", where: Column | None = None) -> DataFrame:
    """(id, dist), nearest first: a projection and a top-k sort, no exchange of vectors."""
    rows = base if where is None else base.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors(rows, id_col, vec_col)
    return rows.select("id", distance(measure, q, F.col("vec"), True).alias("dist")).orderBy("dist", "id").limit(max(0, k))


class Payload:
    """What a scanned table holds beside its ids: here vectors, elsewhere codes of them."""

    column, bytes_each = "vec", 8

    def values(self, x: np.ndarray) -> np.ndarray:
        """The vectors that rows of the payload stand for."""
        return x

    def matrix(self, measure: Measure, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return matrix(measure, q, self.values(x))


def exact_pairs(measure: Measure, q: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray, payload: Payload | None = None) -> np.ndarray:
    """Distances of q[a] to x[b], a bounded number at a time."""
    out, step = np.empty(len(a)), max(1, CELLS // max(1, x.shape[1]))
    for at in range(0, len(a), step):
        part = x[b[at : at + step]]
        out[at : at + step] = pairs(measure, q[a[at : at + step]], part if payload is None else payload.values(part))
    return out


class _Queries:
    def __init__(self, ids: np.ndarray, q: np.ndarray, measure: Measure, k: int | None, radius: float | None, payload: Payload):
        self.ids, self.q, self.measure, self.k, self.radius, self.payload = ids, q, measure, k, radius, payload

    def step(self) -> int:
        return max(1, min(STEP, CELLS // max(1, len(self.ids))))

    def scan(self, ids: np.ndarray, x: np.ndarray, worst: np.ndarray):
        """Candidates (query row, id, distance) of one block of base rows."""
        d = self.payload.matrix(self.measure, self.q, x)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(d), d, 0)))
        if self.radius is not None:
            keep = d <= self.radius + slack
        elif len(ids) > self.k:
            near = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
            keep = d <= np.minimum(near, worst)[:, None] + slack
        else:
            keep = d <= worst[:, None] + slack
        a, b = np.nonzero(keep)
        return a, ids[b], exact_pairs(self.measure, self.q, a, x, b, self.payload)


def _keep(found, k: int, n: int):
    a, ids, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, d, a))
    a, ids, d = a[order], ids[order], d[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    worst = np.full(n, np.inf)
    last = rank == k - 1
    worst[a[last]] = d[last]
    keep = rank < k
    return (a[keep], ids[keep], d[keep]), worst


def scan(base: DataFrame, queries: DataFrame, measure: Measure, k: int | None, radius: float | None, payload: Payload | None = None) -> DataFrame:
    """(qid, id, dist) of base (id, payload): k rows a task and query, or all within the radius."""
    spark, payload = base.sparkSession, payload or Payload()
    dim, n = queries.select(F.max(F.size("vec")), F.count(F.lit(1))).first()
    own = dimension(base, payload.column)
    if not n or own is None:
        return spark.createDataFrame([], RESULT)
    if dimension(queries) != own:
        raise InvalidArgument(f"queries have {dim} elements, the table has {own}")
    blocks = max(-(-n * max(dim, 1) * 8 // MAX_QUERY_BYTES), -(-n // MAX_QUERIES))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = part.toArrow().combine_chunks()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast(_Queries(np.asarray(got["id"].combine_chunks()), stack(got["vec"].combine_chunks()), measure, k, radius, payload))

        def run(batches, shared=shared):
            block = shared.value
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            have, worst = none, np.full(len(block.ids), np.inf)
            for x in batches:
                ids, rows, step = np.asarray(x.column("id")), stack(x.column(block.payload.column)), block.step()
                for at in range(0, len(ids), step):
                    got = block.scan(ids[at : at + step], rows[at : at + step], worst)
                    if k is None:
                        yield _batch(block.ids[got[0]], *got[1:])
                    else:
                        have, worst = _keep([have, got], k, len(block.ids))
            if k is not None:
                yield _batch(block.ids[have[0]], *have[1:])

        found = base.mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def _batch(qid, ids, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], ["qid", "id", "dist"])


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, measure: Measure | str = Measure.SQUARED_L2, id_col: str = "id", vec_col: str = "vec", where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, dist, rank): each query's k nearest rows of base.

    ``where`` is a predicate on base, pushed to its scan; ``allowed`` a table
    (id) whose rows alone take part.
    """
    rows = base if where is None else base.where(where)
    rows = vectors(rows, id_col, vec_col)
    if allowed is not None:
        rows = only(rows, allowed)
    if k <= 0:
        return base.sparkSession.createDataFrame([], RESULT + ", rank int")
    return ranked(scan(rows, vectors(queries, id_col, vec_col), Measure(measure), k, None), k)


def within(base: DataFrame, queries: DataFrame, radius: float, measure: Measure | str = Measure.SQUARED_L2, id_col: str = "id", vec_col: str = "vec", where: Column | None = None, most: int | None = None) -> DataFrame:
    """(qid, id, dist): rows at most ``radius`` away, in the measure's own unit."""
    rows = base if where is None else base.where(where)
    found = scan(vectors(rows, id_col, vec_col), vectors(queries, id_col, vec_col), Measure(measure), None, radius).where(F.col("dist") <= radius)
    return found if most is None else ranked(found, most).drop("rank")


def pairwise(a: DataFrame, b: DataFrame, measure: Measure | str = Measure.SQUARED_L2, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(qid, id, dist) for every row of a against every row of b, a in blocks."""
    return scan(vectors(b, id_col, vec_col), vectors(a, id_col, vec_col), Measure(measure), None, float("inf"))


def paired(base: DataFrame, queries: DataFrame, at_once: int = 4096) -> DataFrame:
    """Each row of base beside each row of queries, for column expressions on both; queries in blocks, base unshuffled."""
    n = queries.count()
    blocks = max(1, -(-n // at_once))
    schema = T.StructType([*queries.schema.fields, *base.schema.fields])
    key = F.xxhash64(*[F.to_json(F.struct(c)) for c in queries.columns]) if blocks > 1 else None
    out = None
    for b in range(blocks):
        got = (queries if blocks == 1 else queries.where(F.pmod(key, F.lit(blocks)) == b)).toArrow().combine_chunks()
        shared = base.sparkSession.sparkContext.broadcast(got.to_batches())

        def run(batches, shared=shared):
            for x in batches:
                for block in shared.value:
                    for i in range(block.num_rows):
                        own = block.take(pa.array(np.full(x.num_rows, i)))
                        yield pa.RecordBatch.from_arrays([*own.columns, *x.columns], schema.names)

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def pairwise_dot(a: DataFrame, b: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Inner products themselves, not negated."""
    return pairwise(a, b, Measure.DOT, id_col, vec_col).withColumn("dist", -F.col("dist"))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in the table (id); a list of checked size goes to the rows."""
    ids = ids.select("id").distinct()
    small = ids.limit(MAX_CANDIDATES + 1).count() <= MAX_CANDIDATES
    return rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def rerank(found: DataFrame, base: DataFrame, queries: DataFrame, k: int, measure: Measure | str = Measure.SQUARED_L2, id_col: str = "id", vec_col: str = "vec", each: int | None = None) -> DataFrame:
    """Candidates (qid, id) again by exact distance; ids that base lacks are dropped.

    ``each`` is the most candidates that a query has, where that is known.
    """
    q = vectors(queries, id_col, vec_col).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    n, dim = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    wanted = found.select("qid", "id").distinct()
    wanted = F.broadcast(wanted) if each is not None and n * each <= MAX_CANDIDATES else wanted
    q = F.broadcast(q) if n * dim * 8 <= MAX_QUERY_BYTES else q
    exact = vectors(base, id_col, vec_col).join(wanted, "id").join(q, "qid")
    return ranked(exact.select("qid", "id", distance(measure, F.col("qvec"), F.col("vec"), True).alias("dist")), k)


def results(found: DataFrame) -> DataFrame:
    """(qid, ids, dists, top): one row a query, nearest first."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", "dist")))
    out = found.groupBy("qid").agg(rows.alias("r"))
    return out.select("qid", F.col("r.id").alias("ids"), F.col("r.dist").alias("dists"), F.element_at("r.id", 1).alias("top"))
