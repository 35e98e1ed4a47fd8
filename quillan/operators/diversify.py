"""Limits on how alike the results of one query may be.

Input is a finite candidate list (qid, id, dist, ...) per query; ask for more
candidates than results beforehand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knn import ranked


def crowding(found: DataFrame, k: int, per_crowd: int = 3, crowd_col: str = "crowd", enabled: bool = True) -> DataFrame:
    """At most ``per_crowd`` results of a crowd, in rank order, then k; a row without a crowd is in crowd 0."""
    if enabled:
        w = Window.partitionBy("qid", F.coalesce(F.col(crowd_col), F.lit(0))).orderBy("dist", "id")
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_crowd).drop("_n")
    return ranked(found.drop("rank"), k)


def crowds_full(found: DataFrame, per_crowd: int = 3, crowd_col: str = "crowd") -> DataFrame:
    """(qid, crowd, full): whether one more result of the crowd would break the limit."""
    crowd = F.coalesce(F.col(crowd_col), F.lit(0)).alias("crowd")
    return found.groupBy("qid", crowd).agg((F.count(F.lit(1)) >= per_crowd).alias("full"))


def crowding_many(found: DataFrame, k: int, limits: dict[str, int]) -> DataFrame:
    """Limits in several dimensions at once: a row stays only if each of its crowds has room.

    Greedy in rank order, so it runs on one query's candidates at a time.
    """
    schema = "qid long, id long, dist double, rank int"
    columns = list(limits)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dist", "id"])
        count: dict = {}
        out = []
        for r in rows.itertuples(index=False):
            if len(out) == k:
                break
            keys = [(c, getattr(r, c)) for c in columns]
            if all(count.get(key, 0) < limits[key[0]] for key in keys):
                for key in keys:
                    count[key] = count.get(key, 0) + 1
                out.append((r.qid, r.id, r.dist, len(out) + 1))
        return pd.DataFrame(out, columns=["qid", "id", "dist", "rank"])

    filled = found.select("qid", "id", "dist", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns])
    return filled.groupBy("qid").applyInPandas(one, schema)


def mmr(found: DataFrame, k: int, trade: float = 0.5, vec_col: str = "vec") -> DataFrame:
    """Maximal marginal relevance with cosine similarity: results in the order they were chosen.

    Each step takes the candidate with the largest
    trade * -dist - (1 - trade) * (greatest similarity to a chosen one); the
    nearest comes first, and the earlier candidate wins a tie.
    """
    trade = min(1.0, max(0.0, trade))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dist", "id"]).reset_index(drop=True)
        v = np.stack(rows["vec"].to_numpy()).astype(float)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(length == 0, 1, length)
        near = np.full(len(rows), -np.inf)
        left = np.ones(len(rows), dtype=bool)
        chosen = []
        while left.any() and len(chosen) < k:
            if not chosen:
                best = 0
            else:
                near = np.maximum(near, v @ v[chosen[-1]])
                score = trade * -rows["dist"].to_numpy() - (1 - trade) * near
                best = int(np.where(left, score, -np.inf).argmax())
            chosen.append(best)
            left[best] = False
        out = rows.loc[chosen, ["qid", "id", "dist"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    source = found.select("qid", "id", "dist", F.col(vec_col).cast("array<double>").alias("vec"))
    return source.groupBy("qid").applyInPandas(one, "qid long, id long, dist double, rank int")
