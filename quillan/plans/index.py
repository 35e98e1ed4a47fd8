"""Indexes: a configuration, the tables that it leads to, and search over them.

Brute force, partitions (tree), codes (hash) or both; both code residuals
unless told otherwise.  Every part is a table, so an index is saved as a
folder of Parquet files, vectors and codes partitioned by ``partition_id``.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillan.errors import FailedPrecondition, InvalidArgument
from quillan.functions.distance import Measure
from quillan.operators.knn import nearest, only, rerank, vectors, within

from . import kmeans, partitioned, pq


@dataclass(frozen=True)
class Config:
    measure: str = "squared_l2"
    neighbors: int = 10
    partitions: int | None = None
    probes: int = 10
    subspaces: int | None = None
    codes: int = 256
    residual: bool = True
    candidates: int | None = None
    steps: int = 100
    tol: float = 1e-5
    seed: int = 42

    def brute_force(self) -> Config:
        return replace(self, partitions=None, subspaces=None)

    def tree(self, partitions: int = 100, probes: int = 10) -> Config:
        return replace(self, partitions=partitions, probes=probes)

    def hash(self, subspaces: int = 16, codes: int = 256, residual: bool = True) -> Config:
        return replace(self, subspaces=subspaces, codes=codes, residual=residual)

    def reorder(self, candidates: int = 100) -> Config:
        """Exact distances for that many candidates before the k nearest are taken."""
        return replace(self, candidates=candidates)

    @property
    def kind(self) -> str:
        return {(False, False): "brute_force", (True, False): "partitioned", (False, True): "hashed", (True, True): "tree_hash"}[(self.partitions is not None, self.subspaces is not None)]

    def build(self, df: DataFrame, id_col: str = "id", vec_col: str = "vec", keep: tuple[str, ...] = ()) -> Index:
        """An index of df; the columns ``keep`` stay for predicates."""
        rows = vectors(df, id_col, vec_col, keep)
        if rows.isEmpty():
            raise InvalidArgument("an index needs rows")
        clusters, centers = None, None
        if self.partitions is not None:
            clusters = kmeans.fit(rows, self.partitions, self.steps, self.tol, self.seed)
            rows, centers = partitioned.tokenize(rows, clusters), clusters.centers
        book, coded = None, None
        if self.subspaces is not None:
            own = rows if centers is None else rows.select("id", "partition_id", "vec", *keep)
            left = partitioned.residuals(own, centers) if centers is not None and self.residual else own
            book = pq.train(left, self.subspaces, self.codes, self.steps, self.tol, self.seed)
            coded = pq.encode(left, book).drop("vec")
        return Index(self, rows, centers, book, coded)


@dataclass
class Index:
    config: Config
    rows: DataFrame
    centers: np.ndarray | None = None
    book: pq.Codebook | None = None
    coded: DataFrame | None = None

    def centroids(self) -> DataFrame:
        if self.centers is None:
            raise FailedPrecondition("this index has no partitions")
        return kmeans.Clusters(self.centers, 0.0, 0).table(self.rows.sparkSession)

    def search(self, queries: DataFrame, k: int | None = None, probes: int | None = None, candidates: int | None = None, allowed: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """(qid, id, dist, rank) for queries (id, vec).

        Both filters apply before scoring: ``allowed`` is a table (id), ``where`` a
        predicate on id and the kept columns, which reaches the files' scan.
        """
        c = self.config
        k, probes, candidates = k or c.neighbors, probes or c.probes, candidates or c.candidates
        wide = max(k, candidates or 0)


        def semi(df: DataFrame) -> DataFrame:
            df = df if where is None else df.where(where)
            return df if allowed is None else only(df, allowed)

        if c.kind == "brute_force":
            return nearest(semi(self.rows), queries, k, c.measure)
        if c.kind == "partitioned":
            found = partitioned.search(semi(self.rows), self.centroids(), queries, wide, probes, c.measure)
        else:
            tree = c.kind == "tree_hash"
            found = partitioned.search_codes(semi(self.coded), self.book, queries, wide, self.centroids() if tree else None, probes, self.centers if tree and c.residual else None)
            if candidates:
                return rerank(found, self.rows, queries, k, c.measure, each=wide)
        return found.where(F.col("rank") <= k)

    def radius(self, queries: DataFrame, radius: float) -> DataFrame:
        return within(self.rows, queries, radius, self.config.measure)

    def save(self, path: str) -> None:
        by = ["partition_id"] if self.centers is not None else []
        self.rows.write.partitionBy(*by).parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        if self.centers is not None:
            self.centroids().write.parquet(f"{path}/centroids")
        if self.book is not None:
            self.book.table(spark).write.parquet(f"{path}/codebook")
            self.coded.write.partitionBy(*by).parquet(f"{path}/codes")
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "config string").coalesce(1).write.parquet(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        config = Config(**json.loads(spark.read.parquet(f"{path}/config").first()["config"]))
        tree, coded = config.partitions is not None, config.subspaces is not None
        centers = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("partition_id").collect()]) if tree else None
        book = pq.Codebook.of(spark.read.parquet(f"{path}/codebook")) if coded else None
        return Index(config, spark.read.parquet(f"{path}/rows"), centers, book, spark.read.parquet(f"{path}/codes") if coded else None)


def measure_of(index: Index) -> Measure:
    return Measure(index.config.measure)
