"""Vector tables from rows, flat buffers, JSON exports and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.operators.knn import nearest
from quillan.operators.numbering import numbered

DENSE = "id long, vec array<float>"
SPARSE = "id long, dim long, indices array<long>, vals array<float>"


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """(id, vec), ids from 0; all rows must be as long as the first."""
    if any(len(r) != len(rows[0]) for r in rows):
        raise InvalidArgument("rows differ in length")
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], DENSE)


def from_flat(spark: SparkSession, data: list[float], dim: int) -> DataFrame:
    if dim <= 0 or len(data) % dim:
        raise InvalidArgument(f"{len(data)} numbers are not rows of {dim}")
    return from_rows(spark, [data[i : i + dim] for i in range(0, len(data), dim)]) if data else spark.createDataFrame([], DENSE)


def checked(df: DataFrame, dim: int) -> DataFrame:
    """df, failing at run time on a vector of another length."""
    return df.where(F.when(F.size("vec") == dim, True).otherwise(F.raise_error(F.concat(F.lit("vector length is not "), F.lit(str(dim))))))


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of more after those of df, with new ids from df's largest on."""
    top = df.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return df.unionByName(numbered(more.select("vec"), "id", top + 1).select("id", F.col("vec").cast("array<float>").alias("vec")))


def append_named(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows (docid, vec) after those of df (id, docid, vec), with new ids; a name that df has gets one more row."""
    top = df.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    new = numbered(more.select("docid", "vec"), "id", top + 1).select("id", "docid", F.col("vec").cast("array<float>").alias("vec"))
    return df.select("id", "docid", "vec").unionByName(new)


def sparse_rows(df: DataFrame) -> DataFrame:
    """SPARSE table with indices sorted, zeros dropped, and equal lengths asserted."""
    pairs = F.filter(F.array_sort(F.arrays_zip("indices", "vals")), lambda p: p["vals"] != 0)
    same = F.when(F.size("indices") == F.size("vals"), pairs).otherwise(F.raise_error(F.lit("indices and values differ in number")))
    return df.withColumn("_p", same).select("id", "dim", F.col("_p.indices").alias("indices"), F.col("_p.vals").alias("vals"))


def id_map(df: DataFrame, name_col: str = "docid") -> DataFrame:
    """(docid, id): the latest id of each name."""
    return df.groupBy(name_col).agg(F.max("id").alias("id"))


def with_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """Results with the name of each id, null where it has none."""
    return found.join(names, "id", "left")


def benchmark_json(spark: SparkSession, path: str, k: int, train_rows: int | None = None, test_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, truth) of a file {train, test, neighbors}; truth (qid, id, rank) cut at k."""
    kind = "train array<array<float>>, test array<array<float>>, neighbors array<array<long>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    table = lambda name, most: raw.select(F.posexplode(name).alias("id", "vec")).select(F.col("id").cast("long").alias("id"), "vec").where(F.col("id") < most if most else F.lit(True))
    train, test = table("train", train_rows), table("test", test_rows)
    truth = raw.select(F.posexplode("neighbors").alias("qid", "ids")).where(F.col("qid") < test_rows if test_rows else F.lit(True))
    truth = truth.select(F.col("qid").cast("long").alias("qid"), F.posexplode("ids").alias("rank", "id")).where(F.col("rank") < k).withColumn("rank", F.col("rank") + 1)
    if train_rows is not None or raw.where("neighbors is null").count():
        truth = nearest(train, test, k).select("qid", "rank", "id")
    return train, test, truth


def synthetic(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """Uniform numbers in [0, 1), a function of the seed, the row and the element alone."""
    one = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(rows).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one).cast("array<float>").alias("vec"))
