"""Mutable vector tables from a log of mutations.

A log row is (seq, op, id, vec) with op add, update or remove.  The live
table is each id's latest row unless that removes it; a removed id lives
again when it is updated.  Logs are tables or file streams; compaction writes
a new version of the base, together with the last log row that it holds, so
what is pending follows from the files alone.  A reader that keeps a version's
number reads the same rows however often the table is compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillan.errors import NotFound
from quillan.operators.numbering import numbered

LOG = "seq long, op string, id long, vec array<float>"


def latest(log: DataFrame) -> DataFrame:
    """The last row of each id; only (seq, row) pairs meet in the shuffle, one a task and id."""
    rest = [c for c in log.columns if c not in ("id",)]
    best = log.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def live(log: DataFrame) -> DataFrame:
    """(id, seq, vec) of what exists."""
    return latest(log).where("op <> 'remove'").select("id", "seq", "vec")


def snapshot_log(base: DataFrame) -> DataFrame:
    """A base table (id, vec) as a log before all others."""
    return base.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "id", "vec")


def apply(base: DataFrame, log: DataFrame) -> DataFrame:
    """(id, vec) of base after the log."""
    return live(snapshot_log(base).unionByName(log.select("seq", "op", "id", "vec"))).select("id", "vec")


def unknown(base: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows that update or remove an id that neither base nor an earlier row has."""
    first = Window.partitionBy("id").orderBy("seq")
    marked = snapshot_log(base).unionByName(log.select("seq", "op", "id", "vec")).withColumn("first", F.row_number().over(first))
    return marked.where("first = 1 and op <> 'add'").drop("first")


def checked(base: DataFrame, log: DataFrame) -> DataFrame:
    bad = unknown(base, log).limit(1).collect()
    if bad:
        raise NotFound(f"{bad[0]['op']} of unknown id {bad[0]['id']}")
    return apply(base, log)


def add(base: DataFrame, log: DataFrame, rows: DataFrame) -> DataFrame:
    """Log rows that add rows (vec) under ids never used before, after all others."""
    seq = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    used = base.select("id").unionByName(log.select("id")).agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    n = F.col("__n")
    return numbered(rows.select("vec"), "__n").select((seq + 1 + n).alias("seq"), F.lit("add").alias("op"), (used + 1 + n).alias("id"), F.col("vec").cast("array<float>").alias("vec"))


def get(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, id, vec) in the order asked for, vec null where there is none; wanted (pos, id)."""
    return wanted.join(table.select("id", "vec"), "id", "left").select("pos", "id", "vec")


def pending(log: DataFrame, since: int) -> DataFrame:
    return log.where(F.col("seq") > since)


def needs_rebuild(log: DataFrame, since: int, threshold: int = 100) -> bool:
    return pending(log, since).limit(threshold).count() >= threshold


class Versions:
    """Versions of a table below one folder; the pointer is the newest complete one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def newest(self) -> int | None:
        return (self._numbers() or [None])[-1]

    def at(self, number: int) -> DataFrame:
        """The table as of a version."""
        if number not in self._numbers():
            raise NotFound(f"no version {number}")
        return self.spark.read.parquet(f"{self.path}/v{number}")

    def current(self) -> DataFrame | None:
        number = self.newest()
        return None if number is None else self.at(number)

    def upto(self) -> int:
        """seq of the last log row in the newest version; -1 where none is."""
        number = self.newest()
        return -1 if number is None else self.spark.read.parquet(f"{self.path}/upto-v{number}").first()["seq"]

    def store(self, table: DataFrame, upto: int = -1) -> int:
        """The number of the new version, which holds the log up to the row ``upto``; complete once its table is."""
        number = (self.newest() or 0) + 1
        self.spark.createDataFrame([(upto,)], "seq long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/upto-v{number}")
        table.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number


def compact(versions: Versions, log: DataFrame) -> int:
    """A new version without removed rows, from the newest one and the log rows after it; ids stay."""
    base, upto = versions.current(), versions.upto()
    last = log.agg(F.max("seq")).first()[0]
    table = live(log).select("id", "vec") if base is None else apply(base, pending(log, upto))
    return versions.store(table, max(upto, -1 if last is None else last))


def follow(stream: DataFrame, log_path: str, checkpoint: str, versions: Versions | None = None, rebuild_after: int | None = None, truncate: bool = False) -> StreamingQuery:
    """Appends a stream of mutations to a log table, batch by batch.

    A batch is written to its own folder, so that a repeated batch replaces
    itself; once ``rebuild_after`` rows wait in the log, which a restart does not
    forget, it is compacted into a version.  With ``truncate``, folders of
    batches that a version holds are removed.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("seq", "op", "id", "vec").write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        if versions is None or rebuild_after is None:
            return
        log = spark.read.schema(LOG + ", batch long").parquet(log_path)
        if needs_rebuild(log, versions.upto(), rebuild_after):
            compact(versions, log.drop("batch"))
            if truncate:
                jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
                for r in log.groupBy("batch").agg(F.max("seq").alias("last")).where(F.col("last") <= versions.upto()).collect():
                    path = jvm.org.apache.hadoop.fs.Path(f"{log_path}/batch={r['batch']}")
                    path.getFileSystem(conf).delete(path, True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
