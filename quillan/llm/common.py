"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillan.errors import FailedPrecondition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names; only where that is
    unset on one machine (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise FailedPrecondition("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillan-checkpoint-"))
    return sc.getCheckpointDir()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class BitFilter:
    """A bit for each slot that a 64-bit key of a table falls into; at most ``bits`` of them.

    It holds every key of the table and some others, more of them as it fills.
    """

    def __init__(self, keys: DataFrame, key: str, n: int, bits: int = 1 << 26):
        self.size = 1 << min(bits.bit_length() - 1, max(10, (16 * n).bit_length()))
        words = keys.select(F.expr(self.slot(key)).alias("b")).distinct().groupBy(F.expr("b >> 6").alias("w"))
        words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
        table = np.zeros(max(1, self.size >> 6), dtype=np.int64)
        table[np.asarray(words["w"].combine_chunks())] = np.asarray(words["v"].combine_chunks())
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def slot(self, key: str) -> str:
        """The SQL expression that gives a key's slot, which ``hits`` takes."""
        return f"({key}) & {self.size - 1}L"


def hits(shared, slots: pa.Array) -> np.ndarray:
    """Which slots are set in the broadcast words of a filter."""
    at = np.asarray(slots)
    return (shared.value[at >> 6] >> (at & 63)) & 1 == 1


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` gave."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
