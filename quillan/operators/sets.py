"""Nearest sets by Jaccard distance over an inverted list of the asked sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import MAX_QUERY_BYTES, RESULT, _keep, ranked

#: set pairs that a task counts at a time
CELLS = 4_000_000


class _Lists:
    """For each element the asked sets that hold it."""

    def __init__(self, ids: np.ndarray, sets: pa.Array):
        self.ids, self.size = ids, np.diff(np.asarray(sets.offsets)).astype(np.int64)
        flat = sets.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(ids)), self.size)
        code = np.asarray(flat.indices)
        order = np.argsort(code, kind="stable")
        self.elements, self.owner = flat.dictionary, owner[order]
        self.first = np.searchsorted(code[order], np.arange(len(flat.dictionary) + 1))

    def shared(self, sets: pa.Array) -> np.ndarray:
        """Shared elements: sets x asked sets."""
        size = np.diff(np.asarray(sets.offsets))
        code = pc.index_in(sets.flatten(), value_set=self.elements)
        row, at = np.repeat(np.arange(len(sets)), size), np.asarray(code.fill_null(-1))
        row, at = row[at >= 0], at[at >= 0]
        n = np.diff(self.first)[at]
        owner = self.owner[np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return np.bincount(np.repeat(row, n) * len(self.ids) + owner, minlength=len(sets) * len(self.ids)).reshape(len(sets), -1)


def nearest(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, dist, rank) for tables (id, ws) and (qid, ws) of sets; sets that share nothing do not count.

    The asked sets go to the executors in blocks of bounded size; each task
    counts shared elements in one pass over its rows and keeps k rows a query.
    """
    spark = base.sparkSession
    sized = queries.where("qid is not null and size(ws) > 0")
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("ws", F.lit(0), lambda a, w: a + F.octet_length(w) + 16)), F.lit(0))).first()
    out, blocks = None, max(1, -(-total // MAX_QUERY_BYTES), -(-n // 65_536))
    for b in range(blocks if n else 0):
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        got = part.select("qid", "ws").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast(_Lists(np.asarray(got["qid"].combine_chunks()), got["ws"].combine_chunks()))

        def run(batches, shared=shared):
            lists = shared.value
            have, worst = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), None
            step = max(1, CELLS // len(lists.ids))
            for x in batches:
                for at in range(0, x.num_rows, step):
                    ids, sets = np.asarray(x.column("id").slice(at, step)), x.column("ws").slice(at, step)
                    c = lists.shared(sets)
                    size = np.diff(np.asarray(sets.offsets)).astype(np.int64)
                    row, q = np.nonzero(c)
                    both = c[row, q]
                    d = 1 - both / (size[row] + lists.size[q] - both)
                    near = slice(None) if worst is None else d <= worst[q]
                    have, worst = _keep([have, (q[near], ids[row[near]], d[near])], k, len(lists.ids))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ids[have[0]], pa.int64()), pa.array(have[1], pa.int64()), pa.array(have[2], pa.float64())], ["qid", "id", "dist"])

        found = base.select(F.col("id").cast("long").alias("id"), "ws").where("id is not null and ws is not null").mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT + ", rank int") if out is None else ranked(out, k)
