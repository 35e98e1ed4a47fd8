"""Statistics over vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import stack


def element_stats(rows: DataFrame) -> DataFrame:
    """(n, lowest, highest, mean, std) over all elements of (id, vec); std with n - 1."""
    x = rows.select(F.explode("vec").alias("x"))
    return x.agg(F.count("x").alias("n"), F.min("x").alias("lowest"), F.max("x").alias("highest"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def group_means(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, mean): the mean vector of each group; sums meet once per task, group and element."""

    def partial(batches):
        for b in batches:
            keys, x = b.column(key), stack(b.column("vec"))
            if not len(x):
                continue
            codes = keys.dictionary_encode()
            index = np.asarray(codes.indices)
            n = np.bincount(index, minlength=len(codes.dictionary))
            sums = np.zeros((len(n), x.shape[1]))
            np.add.at(sums, index, x)
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(n), pa.array(list(sums))], [key, "n", "s"])

    kind = rows.schema[key].dataType.simpleString()
    part = rows.where(F.col(key).isNotNull()).select(key, "vec").mapInArrow(partial, f"{key} {kind}, n long, s array<double>")
    flat = part.select(key, "n", F.posexplode("s").alias("pos", "x")).groupBy(key, "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return flat.groupBy(key).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("x")))).alias("m")).select(key, "n", F.col("m.x").alias("mean"))


def gramian(rows: DataFrame) -> DataFrame:
    """(i, j, g): sums of products of elements i <= j; i = -1 has the column sums and j = -1 there the row count.

    One matrix product a batch; what is shuffled is d * d numbers a task.
    """

    def partial(batches):
        total, sums, n = None, None, 0
        for b in batches:
            x = stack(b.column("vec"))
            if len(x):
                g = x.T @ x
                total = g if total is None else total + g
                sums = x.sum(0) if sums is None else sums + x.sum(0)
                n += len(x)
        if total is not None:
            i, j = np.triu_indices(len(total))
            d = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((i, np.full(d + 1, -1))).astype(np.int32)), pa.array(np.concatenate((j, np.arange(-1, d))).astype(np.int32)), pa.array(np.concatenate((total[i, j], [n], sums)))], ["i", "j", "g"]
            )

    return rows.select("vec").mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, Gram matrix) on the driver: d * d numbers."""
    got = gramian(rows).collect()
    if not got:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = max(r["j"] for r in got) + 1
    n, sums, g = 0, np.zeros(d), np.zeros((d, d))
    for r in got:
        if r["i"] < 0:
            if r["j"] < 0:
                n = int(r["g"])
            else:
                sums[r["j"]] = r["g"]
        else:
            g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return n, sums / n, g


def covariance(rows: DataFrame) -> np.ndarray:
    n, mean, g = moments(rows)
    return (g - n * np.outer(mean, mean)) / max(1, n - 1)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): mean over the queries of truth of shared ids / k, among the first k of each."""
    want = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = found.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit"))
    each = want.join(hits, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / k).alias("r"))
    return each.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("recall"))
