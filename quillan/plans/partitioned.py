"""Searching only a few partitions: IVF, with or without product quantization.

A table has ``partition_id`` beside its vectors or codes.  Queries are routed
to their nearest centroids; a query block goes to the executors with its
routes (bounded size, more blocks in more passes), and each task scores, by
partition, its rows against the queries that probe that partition.  Written
with ``partitionBy('partition_id')`` the probed partitions prune the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillan.functions.distance import Measure, matrix
from quillan.operators.knn import CELLS, MAX_QUERIES, MAX_QUERY_BYTES, RESULT, _keep, exact_pairs, nearest, only, ranked, stack, vectors

from .kmeans import Clusters, assign
from .pq import Codebook, encode

#: A list of probed partitions up to this length prunes the scan of the table.
PRUNE_UP_TO = 1000


def tokenize(rows: DataFrame, clusters: Clusters) -> DataFrame:
    """rows (id, vec, ...) with partition_id: the nearest centroid."""
    return assign(rows, clusters.centers).withColumnRenamed("cluster", "partition_id").drop("cluster_dist")


def route(queries: DataFrame, centroids: DataFrame, probes: int, sizes: DataFrame | None = None) -> DataFrame:
    """(qid, partition_id, dist, rank): the nearest partitions by squared L2, ties to the lower number; with their sizes, if given."""
    base = centroids.select(F.col("partition_id").cast("long").alias("id"), F.col("centroid").alias("vec"))
    out = nearest(base, queries, probes).select("qid", F.col("id").cast("int").alias("partition_id"), "dist", "rank")
    return out if sizes is None else out.join(sizes, "partition_id", "left")


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size"))


class _Probes:
    """A query block: vectors, and by partition the rows of those that probe it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, partition: np.ndarray):
        self.ids, self.q = ids, q
        by_id = np.argsort(ids, kind="stable")
        at = by_id[np.searchsorted(ids[by_id], qid)]
        order = np.lexsort((at, partition))
        names, first = np.unique(partition[order], return_index=True)
        self.by_partition = {int(p): v for p, v in zip(names, np.split(at[order], first[1:]))}


class Exact:
    """Scores base vectors by a measure."""

    payload = "vec"

    def __init__(self, measure: Measure):
        self.measure = measure

    def __call__(self, q: np.ndarray, partition: int, x: np.ndarray) -> np.ndarray:
        d = matrix(self.measure, q, x)
        if len(q) * len(x) <= 1 << 16:  # few rows: the distances themselves, without the rounding of products
            a, b = np.divmod(np.arange(len(q) * len(x)), max(1, len(x)))
            d = exact_pairs(self.measure, q, a, x, b).reshape(len(q), len(x))
        return d

    def queries_at_once(self, rows: int) -> int:
        return max(1, CELLS // max(1, rows))


class Coded:
    """Scores codes by lookup tables; of what is left beyond the centroid where residuals are coded."""

    payload = "codes"

    def __init__(self, book: Codebook, centers: np.ndarray | None):
        self.book, self.centers = book, centers

    def __call__(self, q: np.ndarray, partition: int, codes: np.ndarray) -> np.ndarray:
        tables = self.book.tables(q if self.centers is None else q - self.centers[partition])
        codes = codes.astype(np.int64)
        out = np.zeros((len(q), len(codes)))
        for s in range(codes.shape[1]):
            out += tables[:, s, codes[:, s]]
        return out

    def queries_at_once(self, rows: int) -> int:
        """Queries whose distances and lookup tables stay within CELLS numbers."""
        return max(1, CELLS // max(1, rows, sum(len(c) for c in self.book.parts)))


def probe_scan(rows: DataFrame, queries: DataFrame, routes: DataFrame, k: int, score, step: int = 4096) -> DataFrame:
    """(qid, id, dist, rank): the k best of each query in its partitions; rows (id, partition_id, payload)."""
    spark = rows.sparkSession
    n, dim = queries.select(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n or k <= 0:
        return spark.createDataFrame([], RESULT + ", rank int")
    blocks = max(-(-n * dim * 8 // MAX_QUERY_BYTES), -(-n // MAX_QUERIES))
    out = None
    for b in range(blocks):
        share = (lambda df, c: df) if blocks == 1 else (lambda df, c: df.where(F.pmod(F.xxhash64(c), F.lit(blocks)) == b))
        got = share(queries, "id").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        to = share(routes, "qid").select("qid", "partition_id").toArrow().combine_chunks()
        probes = _Probes(np.asarray(got["id"].combine_chunks()), stack(got["vec"].combine_chunks()), np.asarray(to["qid"].combine_chunks()), np.asarray(to["partition_id"].combine_chunks()))
        shared = spark.sparkContext.broadcast(probes)
        wanted = sorted(probes.by_partition)
        own = rows.where(F.col("partition_id").isin(wanted)) if len(wanted) <= PRUNE_UP_TO else rows

        def run(batches, shared=shared):
            block = shared.value
            have = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            worst = np.full(len(block.ids), np.inf)
            for x in batches:
                part, ids, load = np.asarray(x.column("partition_id")), np.asarray(x.column("id")), stack(x.column(score.payload))
                order = np.argsort(part, kind="stable")
                names, first = np.unique(part[order], return_index=True)
                found, held = [have], 0
                for p, at in zip(names, np.split(order, first[1:])):
                    probing = block.by_partition.get(int(p), np.zeros(0, np.int64))
                    for i in range(0, len(at), step):
                        rows_ = at[i : i + step]
                        most = score.queries_at_once(len(rows_))
                        for j in range(0, len(probing), most):
                            mine = probing[j : j + most]
                            d = score(block.q[mine], int(p), load[rows_])
                            # Only what may be among the k best of these rows and of those before.
                            near = np.partition(d, k - 1, axis=1)[:, k - 1] if len(rows_) > k else np.inf
                            a, c = np.nonzero(d <= np.minimum(near, worst[mine])[:, None])
                            found.append((mine[a], ids[rows_[c]], d[a, c]))
                            held += len(a)
                            if held > CELLS:
                                have, worst = _keep(found, k, len(block.ids))
                                found, held = [have], 0
                if len(found) > 1:
                    have, worst = _keep(found, k, len(block.ids))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[have[0]], pa.int64()), pa.array(have[1], pa.int64()), pa.array(have[2], pa.float64())], ["qid", "id", "dist"])

        part = own.select("id", "partition_id", score.payload).mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k)


def search(rows: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 10, probes: int = 10, measure: Measure | str = Measure.SQUARED_L2, where: Column | None = None) -> DataFrame:
    """IVF: the k nearest among the members of the probed partitions; there may be fewer."""
    rows = rows if where is None else rows.where(where)
    return probe_scan(rows, vectors(queries, "id", "vec"), route(queries, centroids, probes), k, Exact(Measure(measure)))


def residuals(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rows (id, partition_id, vec) with vec less its centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for b in batches:
            x = stack(b.column("vec"))
            if len(x):
                x = x - shared.value[np.asarray(b.column("partition_id"))]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield b.set_column(b.schema.names.index("vec"), "vec", flat)

    return rows.mapInArrow(run, rows.schema)


def code_rows(rows: DataFrame, book: Codebook, centers: np.ndarray | None = None) -> DataFrame:
    """(id, partition_id, codes), of residuals when centers are given."""
    source = rows if centers is None else residuals(rows.select("id", "partition_id", "vec"), centers)
    return encode(source, book).select("id", "partition_id", "codes")


def search_codes(coded: DataFrame, book: Codebook, queries: DataFrame, k: int, centroids: DataFrame | None = None, probes: int = 10, centers: np.ndarray | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Asymmetric-hash search: of all codes, or of the probed partitions'."""
    q = vectors(queries, "id", "vec")
    if centroids is None:
        coded = coded.withColumn("partition_id", F.lit(0))
        routes = q.select(F.col("id").alias("qid"), F.lit(0).alias("partition_id"))
    else:
        routes = route(queries, centroids, probes)
    if allowed is not None:
        coded = only(coded, allowed)
    return probe_scan(coded, q, routes, k, Coded(book, centers))
