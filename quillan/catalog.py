"""Queries over the driver's tables, each with the SQL that checks it.

Searches take every embedding whose id is divisible by 50 as a query, against
the whole table.  Distances are rounded in the last projection only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillan.functions import bits, distance, quantize
from quillan.functions import vectors as vec
from quillan.functions.distance import Measure
from quillan.operators import crossed, diversify, filters, knn, sampling, sets, statistics
from quillan.schema import DOUBLES
from quillan.plans import gmm, index, kmeans, partitioned, pq, projections
from quillan.streaming import mutations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
K, EVERY, DIM, SUB = 10, 50, 64, 8
#: of the ten labels' partitions; recall is over 0.9
PROBES = 8
WIDTH = DIM // SUB


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % EVERY == 0)


def six(c) -> F.Column:
    return (F.round(c, 6) + 0.0)


def found(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", six("dist").alias("dist"), "rank")


E = "e AS (SELECT vec_id AS id, embedding::double[] AS v, label FROM embeddings)"
Q = f"q AS (SELECT id AS qid, v AS w FROM e WHERE id % {EVERY} = 0)"


def over(f: str, a: str = "w", b: str = "v") -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {f.format(a=f'{a}[i]', b=f'{b}[i]')}))"


DIST = {
    "l1": over("abs({a} - {b})"),
    "l2": "list_distance(w, v)",
    "squared_l2": over("({a} - {b}) * ({a} - {b})"),
    "dot": "-list_inner_product(w, v)",
    "general_inner_product": "-list_inner_product(w, v)",
    "cosine": "list_cosine_distance(w, v)",
    "hamming": over("CASE WHEN {a} <> {b} THEN 1.0::double ELSE 0.0::double END"),
    "non_zero_intersect": "-" + over("CASE WHEN {a} <> 0 AND {b} <> 0 THEN 1.0::double ELSE 0.0::double END"),
    "limited_inner_product": "-list_inner_product(w, v)",
}


def knn_sql(d: str, where: str = "true", extra: str = "", source: str = E, k: int = K) -> str:
    return f"""WITH {source}, {Q}{extra}, s AS (SELECT qid, id, {d} AS d FROM q, e WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s)
SELECT qid, id, round(d, 6) + 0.0 AS dist, rank::int AS rank FROM r WHERE rank <= {k}"""


def _changed(v: str) -> str:
    return f"e AS (SELECT vec_id AS id, list_transform(embedding::double[], lambda x: {v}) AS v, label FROM embeddings)"


#: what the elements become first, for measures that need other values
SHAPES = {
    "hamming": (lambda x: F.when(x > 0, 1.0).otherwise(0.0), "CASE WHEN x > 0 THEN 1.0::double ELSE 0.0::double END"),
    "non_zero_intersect": (lambda x: F.when(x > 0.1, x).otherwise(0.0), "CASE WHEN x > 0.1 THEN x ELSE 0.0 END"),
    "limited_inner_product": (lambda x: x * 0.5, "x * 0.5"),
}


def _knn(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = embeddings(spark, sf_dir)
        if name in SHAPES:
            rows = rows.withColumn("vec", F.transform("vec", SHAPES[name][0]))
        return found(knn.nearest(rows, asked(rows), K, name))

    run.__name__ = f"knn_{name}"
    query(knn_sql(DIST[name], source=_changed(SHAPES[name][1]) if name in SHAPES else E))(run)


for _name in DIST:
    _knn(_name)


@query(f"WITH {E}, q AS (SELECT v AS w FROM e WHERE id = 0) SELECT id, round({DIST['squared_l2']}, 6) + 0.0 AS dist FROM q, e ORDER BY {DIST['squared_l2']}, id LIMIT {K}")
def knn_one(spark, sf_dir):
    """One query vector: a projection and a distributed top-k."""
    rows = embeddings(spark, sf_dir)
    q = rows.where("id = 0").select("vec").first()["vec"]
    return knn.nearest_one(rows, q, K).select("id", six("dist").alias("dist"))


@query(f"WITH {_changed('x * 2')}, {Q} SELECT qid, count(*) AS n FROM q, e WHERE list_inner_product(w, w) > 1 OR list_inner_product(v, v) > 1 GROUP BY qid")
def lip_infinite(spark, sf_dir):
    """Limited inner products are infinite beyond unit length."""
    rows = embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * 2))
    all_ = knn.pairwise(asked(rows), rows, Measure.LIMITED_INNER_PRODUCT)
    return all_.where(F.col("dist") == float("inf")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


def _radius(name: str, radius: float):
    def run(spark, sf_dir):
        rows = embeddings(spark, sf_dir)
        return knn.within(rows, asked(rows), radius, name).select("qid", "id", six("dist").alias("dist"))

    run.__name__ = f"radius_{name}"
    query(f"WITH {E}, {Q} SELECT qid, id, round({DIST[name]}, 6) + 0.0 AS dist FROM q, e WHERE {DIST[name]} <= {radius}")(run)


_radius("squared_l2", 1.2)
_radius("cosine", 0.6)
_radius("l1", 7.0)


@query(f"WITH {E}, {Q} SELECT qid, id, round({DIST['squared_l2']}, 6) + 0.0 AS sql2, round(list_inner_product(w, v), 6) + 0.0 AS dot, round(list_cosine_distance(w, v), 6) + 0.0 AS cosine FROM q, e")
def pairwise(spark, sf_dir):
    """Distance matrices in long form, by three measures."""
    rows = embeddings(spark, sf_dir)
    a, b = asked(rows), rows
    parts = [knn.pairwise(a, b), knn.pairwise_dot(a, b), knn.pairwise(a, b, Measure.COSINE)]
    named = [p.select("qid", "id", six("dist").alias(n)) for p, n in zip(parts, ("sql2", "dot", "cosine"))]
    return named[0].join(named[1], ["qid", "id"]).join(named[2], ["qid", "id"])


@query(f"""WITH {E}, {Q} SELECT qid, id, round({DIST['l1']}, 6) AS l1, round({DIST['l2']}, 6) AS l2, round({DIST['squared_l2']}, 6) AS sql2,
round(-list_inner_product(w, v), 6) + 0.0 AS dot, round(list_cosine_distance(w, v), 6) + 0.0 AS cosine, {DIST['hamming']} AS hamming,
{DIST['non_zero_intersect']} AS nzi, round({DIST['squared_l2']}, 6) AS dice FROM q, e""")
def measures(spark, sf_dir):
    """One-to-one measures of all pairs; ``distance.distance`` is their expression on a table of pairs."""
    rows = embeddings(spark, sf_dir)
    score = crossed.Dense("l1", "l2", "squared_l2", "dot", "cosine", "hamming", "non_zero_intersect", "dice", names={"squared_l2": "sql2", "non_zero_intersect": "nzi"})
    return crossed.crossed(rows, asked(rows), score, 6)


_SPARSE = "sp AS (SELECT id, list_transform(range(1, 65), lambda i: CASE WHEN v[i] > 0.1 THEN v[i] ELSE 0.0 END) AS v FROM e), " + "sx AS (SELECT id, v, list_filter(range(0, 64), lambda i: v[i + 1] <> 0) AS ix FROM sp)"


@query(f"""WITH {E}, {_SPARSE}, b AS (SELECT a.id AS qid, b.id, a.v AS w, b.v, a.ix AS i1, b.ix AS i2, len(list_intersect(a.ix, b.ix)) AS c FROM sx AS a, sx AS b WHERE a.id % {EVERY} = 0)
SELECT qid, id,
round(CASE WHEN len(i1) + len(i2) - c = 0 THEN 0.0 ELSE 1 - c / (len(i1) + len(i2) - c)::double END, 6) + 0.0 AS jaccard,
round(CASE WHEN len(i1) + len(i2) = 0 THEN 0.0 ELSE 1 - 2 * c / (len(i1) + len(i2))::double END, 6) + 0.0 AS dice,
round(CASE WHEN least(len(i1), len(i2)) = 0 THEN 0.0 ELSE c / least(len(i1), len(i2))::double END, 6) + 0.0 AS overlap,
-c::double + 0.0 AS nzi,
round(CASE WHEN {over('greatest({a}, {b})')} = 0 THEN 0.0 ELSE 1 - {over('least({a}, {b})')} / {over('greatest({a}, {b})')} END, 6) + 0.0 AS wjaccard,
round({over('abs({a} - {b})')}, 6) AS l1, round({over('({a} - {b}) * ({a} - {b})')}, 6) AS sql2, round(-list_inner_product(w, v), 6) + 0.0 AS dot,
round(CASE WHEN list_sum(w) = 0 OR list_sum(v) = 0 THEN 1.0 ELSE 1 - list_inner_product(w, v) / (sqrt(list_inner_product(w, w)) * sqrt(list_inner_product(v, v))) END, 6) + 0.0 AS cosine FROM b""")
def sparse_measures(spark, sf_dir):
    """Set and sparse measures of all pairs of structs of indices and values; ``distance.sparse_distance`` is their expression on a table of pairs."""
    rows = embeddings(spark, sf_dir).select("id", vec.to_sparse(F.transform("vec", lambda x: F.when(x > 0.1, x).otherwise(0.0))).alias("s"))
    short = {"non_zero_intersect": "nzi", "weighted_jaccard": "wjaccard", "squared_l2": "sql2"}
    return crossed.crossed(rows, asked(rows), crossed.Sparse(), 6).withColumnsRenamed(short)


@query(f"""WITH {E} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_sum(v), 6) + 0.0 AS total,
round(v[4] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS unit4, round(v[64], 6) + 0.0 AS last, 0.0::double AS beyond,
round(list_sum(v[11:20]), 6) + 0.0 AS window_sum, 20 AS window_size, round(v[11], 6) + 0.0 AS back11, 8 AS n_chunks, round(list_sum(v[17:24]), 6) + 0.0 AS chunk2, round(list_sum(v), 6) + 0.0 AS round_trip FROM e""")
def vector_functions(spark, sf_dir):
    """Norms, normalisation, element access, windows, chunks, dense to sparse and back."""
    v = F.col("vec")
    window = F.concat(vec.truncate(v, 10, 10), vec.zeros(10))
    return embeddings(spark, sf_dir).select(
        "id", six(vec.norm(v)).alias("norm"), six(vec.horizontal_sum(v)).alias("total"), six(vec.element(vec.normalize(v), 3)).alias("unit4"),
        six(vec.element(v, 63)).alias("last"), vec.element(v, 64).alias("beyond"), six(vec.horizontal_sum(window)).alias("window_sum"), F.size(window).alias("window_size"),
        six(vec.element(vec.untruncate(vec.truncate(v, 10, 10), 64, 10), 10)).alias("back11"), F.size(vec.chunks(v, 8)).alias("n_chunks"),
        six(vec.horizontal_sum(vec.chunk(v, 2, 8))).alias("chunk2"), six(vec.horizontal_sum(vec.to_dense(vec.to_sparse(v)))).alias("round_trip"),
    )


def _filtered(name: str, predicate, where: str):
    def run(spark, sf_dir):
        rows = embeddings(spark, sf_dir)
        return found(knn.nearest(rows, asked(rows), K, where=predicate(F.col("id"), F.col("label"))))

    run.__name__ = f"knn_{name}"
    query(knn_sql(DIST["squared_l2"], where))(run)


_filtered("range", lambda i, _: filters.in_range(i, 100, 400), "id >= 100 AND id < 400")
_filtered("and_or_not", lambda i, l: filters.all_of(filters.none_of(l == 3), filters.any_of(l < 5, filters.in_range(i, 0, 50))), "label <> 3 AND (label < 5 OR id < 50)")
_filtered("nothing", lambda i, l: filters.any_of(), "false")


@query(knn_sql(DIST["squared_l2"], "id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_allowlist(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return found(knn.nearest(rows, asked(rows), K, allowed=ids))


@query(knn_sql(DIST["squared_l2"], "id < (SELECT max(id) - 9 FROM e) AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def knn_denylist(spark, sf_dir):
    """Ids beyond the list's capacity, here the last ten, are denied too."""
    rows = embeddings(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return found(knn.nearest(filters.deny(rows, ids, capacity=rows.agg(F.max("id")).first()[0] - 9), asked(rows), K))


@query("WITH c AS (SELECT max(doc_id) - 9 AS c FROM documents) SELECT (SELECT count(DISTINCT doc_id) FROM labels, c WHERE quality = 1 AND doc_id < c) AS allowed, (SELECT any_value(c) FROM c) - (SELECT count(DISTINCT doc_id) FROM labels, c WHERE toxic = 1 AND doc_id < c) AS not_denied")
def list_sizes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    capacity = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] - 9
    return filters.count_allowed(labels.where("quality = 1"), capacity).withColumnRenamed("n", "allowed").join(filters.count_not_denied(labels.where("toxic = 1"), capacity).withColumnRenamed("n", "not_denied"))


@query(knn_sql(DIST["squared_l2"], "label IN (1, 4, 77)"))
def knn_tokens(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    ids = filters.with_any_token(rows.select("id", F.col("label").alias("token")), [1, 4, 77])
    return found(knn.nearest(rows, asked(rows), K, allowed=ids))


def _candidates(spark, sf_dir, k: int = 50) -> tuple[DataFrame, DataFrame]:
    rows = embeddings(spark, sf_dir)
    return rows, knn.nearest(rows, asked(rows), k).join(rows, "id")


@query(f"""WITH {E}, {Q}, s AS (SELECT qid, id, label, {DIST['squared_l2']} AS d FROM q, e),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM s) WHERE n <= 50),
l AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY d, id) AS m FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM l WHERE m <= 2)
SELECT qid, id, round(d, 6) + 0.0 AS dist, rank::int AS rank FROM r WHERE rank <= {K}""")
def crowding(spark, sf_dir):
    """At most two results of a label."""
    return found(diversify.crowding(_candidates(spark, sf_dir)[1], K, 2, "label"))


_NEAREST = f"{E}, {Q}, s AS (SELECT qid, id, label, v, {DIST['squared_l2']} AS d FROM q, e), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM s QUALIFY n <= 50)"


@query(f"""WITH RECURSIVE {_NEAREST}, g AS (SELECT qid, 0::bigint AS n, []::bigint[] AS ls, []::bigint[] AS ids, []::double[] AS ds FROM q
UNION ALL SELECT qid, n, CASE WHEN ok THEN list_append(ls, label) ELSE ls END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(ds, d) ELSE ds END FROM (
SELECT g.qid, c.n, ls, ids, ds, c.label, c.id, c.d, len(ids) < {K} AND len(list_filter(ls, lambda x: x = c.label)) < 3 AND len(list_filter(ids, lambda x: x % 2 = c.id % 2)) < 6 AS ok FROM g JOIN c ON c.qid = g.qid AND c.n = g.n + 1)),
f AS (SELECT * FROM g QUALIFY n = max(n) OVER (PARTITION BY qid))
SELECT qid, ids[i] AS id, round(ds[i], 6) + 0.0 AS dist, i::int AS rank FROM f, range(1, {K + 1}) AS r(i) WHERE i <= len(ids)""")
def crowding_many(spark, sf_dir):
    """Limits on label and on parity together, in rank order."""
    c = _candidates(spark, sf_dir)[1].withColumn("parity", F.col("id") % 2)
    return found(diversify.crowding_many(c, K, {"label": 3, "parity": 6}))


@query(f"""WITH RECURSIVE {_NEAREST}, sim AS (SELECT a.qid, a.n AS a, b.n AS b, list_cosine_similarity(a.v, b.v) AS c FROM c AS a JOIN c AS b ON a.qid = b.qid),
g AS (SELECT qid, n, d, 1 AS step, 1::bigint AS last, '-infinity'::double AS near, CASE WHEN n = 1 THEN 1 END AS pos FROM c
UNION ALL SELECT qid, n, d, step + 1, best, near2, CASE WHEN pos IS NOT NULL THEN pos WHEN n = best THEN step + 1 END FROM (
SELECT *, first_value(n) OVER (PARTITION BY qid ORDER BY CASE WHEN pos IS NULL THEN 0 ELSE 1 END, round(0.5 * -d - 0.5 * near2, 12) DESC, n) AS best FROM (
SELECT g.*, greatest(near, sim.c) AS near2 FROM g JOIN sim ON sim.qid = g.qid AND sim.a = g.n AND sim.b = g.last)) WHERE step < {K})
SELECT g.qid, c.id, round(c.d, 6) + 0.0 AS dist, pos::int AS rank FROM g JOIN c ON c.qid = g.qid AND c.n = g.n WHERE step = {K} AND pos IS NOT NULL""")
def mmr(spark, sf_dir):
    """Maximal marginal relevance, in the order of choice."""
    return found(diversify.mmr(_candidates(spark, sf_dir)[1], K, 0.5))


@query(f"""WITH {E}, {Q}, s AS (SELECT qid, id, {DIST['squared_l2']} AS d FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s)
SELECT qid, list(id ORDER BY rank) AS ids, arg_min(id, rank) AS top FROM r WHERE rank <= {K} GROUP BY qid""")
def result_lists(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return knn.results(knn.nearest(rows, asked(rows), K)).select("qid", "ids", "top")


@query(f"WITH {E}, x AS (SELECT unnest(v) AS x FROM e) SELECT count(*) AS n, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std FROM x")
def quant_stats(spark, sf_dir):
    s = statistics.element_stats(embeddings(spark, sf_dir))
    return s.select("n", *[six(c).alias(c) for c in ("lowest", "highest", "mean", "std")])


_P = "p AS (SELECT min(x) AS lo, (max(x) - min(x)) / 255 AS sc FROM (SELECT unnest(v) AS x FROM e))"
_CODES = f"{_P}, c AS (SELECT id, v, lo, sc, list_transform(v, lambda x: floor((x - lo) / sc + 0.5)) AS codes FROM e, p)"


def _int8(rows: DataFrame):
    return quantize.calibrate(statistics.element_stats(rows).first().asDict())


@query(f"WITH {E}, {_CODES} SELECT id, list_transform(codes, lambda x: x::int) AS codes FROM c")
def int8_codes(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return rows.select("id", quantize.quantize(F.col("vec"), _int8(rows)).cast("array<int>").alias("codes"))


@query(f"WITH {E}, {_CODES} SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - (codes[i] * sc + lo)))), 6) AS error, list_max(list_transform(range(1, 65), lambda i: abs(v[i] - (codes[i] * sc + lo)))) <= sc AS bounded FROM c")
def int8_error(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    p = _int8(rows)
    back = quantize.dequantize(quantize.quantize(F.col("vec"), p), p)
    gap = F.zip_with("vec", back, lambda x, y: F.abs(x - y))
    return rows.select("id", six(vec.fold(gap)).alias("error"), (F.array_max(gap) <= p.scale).alias("bounded"))


@query(f"""WITH {E}, {_CODES}, k AS (SELECT id, list_transform(codes, lambda x: x * sc + lo) AS v FROM c), q AS (SELECT id AS qid, v AS w FROM e WHERE id % {EVERY} = 0),
s AS (SELECT qid, id, {DIST['squared_l2']} AS d FROM q, k), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s)
SELECT qid, id, round(d, 6) + 0.0 AS dist, rank::int AS rank FROM r WHERE rank <= {K}""")
def int8_knn(spark, sf_dir):
    """Float queries against 8-bit codes, decoded with their offset."""
    rows = embeddings(spark, sf_dir)
    p = _int8(rows)
    coded = rows.select("id", quantize.dequantize(quantize.quantize(F.col("vec"), p), p).alias("vec"))
    return found(knn.nearest(coded, asked(rows), K))


@query(f"WITH {E} SELECT id, list_transform(v, lambda x: greatest(-8, least(7, floor(x * 20 + 0.5)))::int) AS back, 32 AS n_bytes FROM e")
def int4_round_trip(spark, sf_dir):
    codes = F.transform("vec", lambda x: F.greatest(F.lit(-8), F.least(F.lit(7), F.floor(x * 20 + 0.5))).cast("int"))
    packed = quantize.pack_int4(codes)
    return embeddings(spark, sf_dir).select("id", quantize.unpack_int4(packed, DIM).alias("back"), F.octet_length(packed).alias("n_bytes"))


_CENT = "cl AS (SELECT label AS p, i, avg(v[i]) AS x FROM e, range(1, 65) AS r(i) GROUP BY label, i), ce AS (SELECT p, list(x ORDER BY i) AS c FROM cl GROUP BY p)"


def _label_centers(rows: DataFrame) -> kmeans.Clusters:
    """Means by label, labels in order; as many as there are labels."""
    means = statistics.group_means(rows, "label").orderBy("label").collect()
    return kmeans.Clusters(np.array([m["mean"] for m in means]), 0.0, 0)


@query(f"WITH {E}, {_CENT} SELECT p AS label, (SELECT count(*) FROM e WHERE label = p) AS n, list_transform(c, lambda x: round(x, 6) + 0.0) AS mean FROM ce")
def group_means(spark, sf_dir):
    """The update step of k-means: mean vectors by group."""
    return statistics.group_means(embeddings(spark, sf_dir), "label").select("label", "n", F.transform("mean", six).alias("mean"))


_NEAR = f"a AS (SELECT id, v, p, c, {over('({a} - {b}) * ({a} - {b})', 'v', 'c')} AS d FROM e, ce), o AS (SELECT id, v, p, c, d, row_number() OVER (PARTITION BY id ORDER BY d, p) AS n FROM a)"


@query(f"WITH {E}, {_CENT}, {_NEAR} SELECT id, (dense_rank() OVER (ORDER BY p) - 1)::int AS partition_id, round(d, 6) AS dist FROM o WHERE n = 1")
def assign_clusters(spark, sf_dir):
    """The assignment step of k-means: nearest center and distance."""
    rows = embeddings(spark, sf_dir)
    return kmeans.assign(rows, _label_centers(rows).centers).select("id", F.col("cluster").alias("partition_id"), six("cluster_dist").alias("dist"))


_IVF = f"""WITH {E}, {_CENT}, {_NEAR}, m AS (SELECT id, v, p FROM o WHERE n = 1),
t AS (SELECT id AS qid, v AS w, p FROM o WHERE n <= {PROBES} AND id % {EVERY} = 0)"""


@query(f"{_IVF}, s AS (SELECT qid, id, {DIST['squared_l2']} AS d FROM t JOIN m ON m.p = t.p), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s) SELECT qid, id, round(d, 6) + 0.0 AS dist, rank::int AS rank FROM r WHERE rank <= {K}")
def ivf_knn(spark, sf_dir):
    """Search of the eight nearest of the labels' partitions."""
    rows = embeddings(spark, sf_dir)
    c = _label_centers(rows)
    return found(partitioned.search(partitioned.tokenize(rows, c), c.table(spark), asked(rows), K, PROBES))


@query(f"{_IVF}, n AS (SELECT p, count(*) AS size FROM m GROUP BY p), z AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM ce) SELECT t.qid, z.i::int AS partition_id, size FROM t JOIN z ON z.p = t.p LEFT JOIN n ON n.p = t.p")
def route_queries(spark, sf_dir):
    """The partitions a query probes, with their sizes."""
    rows = embeddings(spark, sf_dir)
    c = _label_centers(rows)
    sizes = partitioned.sizes(partitioned.tokenize(rows, c))
    return partitioned.route(asked(rows), c.table(spark), PROBES, sizes).select("qid", "partition_id", "size")


@query(f"""{_IVF}, s AS (SELECT qid, id, {DIST['squared_l2']} AS d FROM t JOIN m ON m.p = t.p), f AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM s) WHERE n <= {K}),
q AS (SELECT id AS qid, v AS w FROM e WHERE id % {EVERY} = 0), g AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {DIST['squared_l2']}, id) AS n FROM q, e) WHERE n <= {K})
SELECT round(count(*) / ({K}.0 * (SELECT count(*) FROM q)), 6) AS recall FROM f JOIN g ON f.qid = g.qid AND f.id = g.id""")
def recall_at_10(spark, sf_dir):
    """Recall of that search against the exact one."""
    rows = embeddings(spark, sf_dir)
    c = _label_centers(rows)
    got = partitioned.search(partitioned.tokenize(rows, c), c.table(spark), asked(rows), K, PROBES)
    return statistics.recall(got, knn.nearest(rows, asked(rows), K), K).select(six("recall").alias("recall"))


#: a code is one byte
CODES = 256
_BOOK = f"bk AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS code, v[s * {WIDTH} + 1:s * {WIDTH} + {WIDTH}] AS c FROM e, range(0, {SUB}) AS t(s) WHERE id % {EVERY} = 0 QUALIFY code < {CODES})"
_SUBDIST = over("({a} - {b}) * ({a} - {b})", "x", "c")
_PQ = f"""{_BOOK}, sl AS (SELECT id, s, v[s * {WIDTH} + 1:s * {WIDTH} + {WIDTH}] AS x FROM e, range(0, {SUB}) AS t(s)),
d AS (SELECT id, sl.s, code, {_SUBDIST} AS d FROM sl JOIN bk ON bk.s = sl.s), pc AS (SELECT id, s, code FROM (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY d, code) AS n FROM d) WHERE n = 1)"""
_ADC = f"ad AS (SELECT d.id AS qid, pc.id, sum(d.d) AS d FROM d JOIN pc ON pc.s = d.s AND pc.code = d.code WHERE d.id % {EVERY} = 0 GROUP BY 1, 2)"


def _book(rows: DataFrame) -> pq.Codebook:
    """The first query vectors' slices as centroids, one for each code."""
    own = asked(rows).orderBy("id").limit(CODES).collect()
    m = np.array([r["vec"] for r in own])
    return pq.Codebook(tuple(m[:, s * WIDTH : (s + 1) * WIDTH] for s in range(SUB)))


@query(f"WITH {E}, {_PQ} SELECT id, list(code::int ORDER BY s) AS codes FROM pc GROUP BY id")
def pq_codes(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return pq.encode(rows, _book(rows)).select("id", F.col("codes").cast("array<int>").alias("codes"))


@query(f"WITH {E}, {_PQ} SELECT id AS qid, s::int AS s, code::int AS code, round(d, 6) AS d FROM d WHERE id % {EVERY} = 0")
def pq_tables(spark, sf_dir):
    """Lookup tables of all queries, in long form."""
    rows = embeddings(spark, sf_dir)
    wide = pq.with_tables(asked(rows), _book(rows)).select(F.col("id").alias("qid"), F.posexplode("lut").alias("s", "t"))
    return wide.select("qid", "s", F.posexplode("t").alias("code", "d")).withColumn("d", six("d"))


@query(f"WITH {E}, {_PQ}, {_ADC}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM ad) SELECT qid, id, round(d, 6) AS dist, rank::int AS rank FROM r WHERE rank <= {K}")
def adc_knn(spark, sf_dir):
    """Search of product-quantized codes by lookup tables."""
    rows = embeddings(spark, sf_dir)
    book = _book(rows)
    return found(partitioned.search_codes(pq.encode(rows, book).select("id", "codes"), book, asked(rows), K))


@query(f"""WITH {E}, {_PQ}, {_ADC}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS n FROM ad), {Q},
x AS (SELECT r.qid, r.id, {DIST['squared_l2']} AS d FROM r JOIN q ON q.qid = r.qid JOIN e ON e.id = r.id WHERE n <= 30), y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM x)
SELECT qid, id, round(d, 6) + 0.0 AS dist, rank::int AS rank FROM y WHERE rank <= {K}""")
def adc_rerank(spark, sf_dir):
    """Thirty candidates by codes, ten results by exact distance."""
    rows = embeddings(spark, sf_dir)
    book = _book(rows)
    got = partitioned.search_codes(pq.encode(rows, book).select("id", "codes"), book, asked(rows), 30)
    return found(knn.rerank(got, rows, asked(rows), K))


@query(f"WITH {E}, {_PQ}, {_ADC} SELECT qid, id, round(d, 6) AS dist FROM ad")
def adc_expressions(spark, sf_dir):
    """The same distances of all pairs; ``pq.adc`` is their expression on a table of pairs."""
    rows = embeddings(spark, sf_dir)
    book = _book(rows)
    return crossed.crossed(pq.encode(rows, book), asked(rows), pq.Lookup(book), 6)


_PQ4 = _PQ.replace(f"< {CODES}", "< 16")


@query(f"WITH {E}, {_PQ4}, {_ADC} SELECT qid, id, round(d, 6) AS packed, 4 AS n_bytes FROM ad")
def adc_packed(spark, sf_dir):
    """Distances from packed 4-bit codes of at most sixteen centroids a subspace."""
    rows = embeddings(spark, sf_dir)
    book = pq.Codebook(tuple(c[:16] for c in _book(rows).parts))
    coded = pq.encode(rows, book).select("id", pq.pack4(F.col("codes")).alias("packed"))
    both = knn.paired(coded, pq.with_tables(asked(rows), book).select(F.col("id").alias("qid"), "lut"))
    return both.select("qid", "id", six(pq.adc_packed(F.col("packed"), F.col("lut"))).alias("packed"), F.octet_length("packed").alias("n_bytes"))


@query()
def hybrid_knn(spark, sf_dir):
    """Partitions, residual codes and exact re-ranking, with fitted models; recall is over 0.9."""
    rows = embeddings(spark, sf_dir)
    built = index.Config().tree(20, 16).hash(16, 64).reorder(300).build(rows)
    return found(built.search(asked(rows), K))


@query()
def kmeans_fit(spark, sf_dir):
    """Centers and sizes of a fitted clustering."""
    rows = embeddings(spark, sf_dir)
    c = kmeans.fit(rows, 10, steps=20)
    return partitioned.sizes(partitioned.tokenize(rows, c)).join(c.table(spark), "partition_id")


@query()
def kmeans_tree(spark, sf_dir):
    """Nodes of a two-level tree."""
    return kmeans.fit_tree(embeddings(spark, sf_dir), children=5, depth=2, min_leaf=20, steps=10).table(spark)


@query()
def mixture(spark, sf_dir):
    """Most likely component of each row under a fitted Gaussian mixture."""
    rows = embeddings(spark, sf_dir)
    return gmm.fit(rows, 5, steps=15).predict(rows).select("id", "component", F.transform("shares", six).alias("shares"))


@query()
def stacked_error(spark, sf_dir):
    """Reconstruction errors of one and of two levels of codes."""
    rows = embeddings(spark, sf_dir)
    two = pq.train_stacked(rows, 2, 8, 16)
    one = pq.Stacked(two.levels[:1])
    errors = pq.map_vectors(rows, lambda x: np.column_stack([one.error(x), two.error(x)]), "errors", DOUBLES)
    return errors.select("id", six(F.element_at("errors", 1)).alias("one"), six(F.element_at("errors", 2)).alias("two"))


@query(f"WITH {E} SELECT (i - 1)::int AS i, round(avg(v[i]), 6) + 0.0 AS mean FROM e, range(1, 65) AS r(i) GROUP BY i")
def column_mean(spark, sf_dir):
    n, mean, _ = statistics.moments(embeddings(spark, sf_dir))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(mean)], "i int, mean double").withColumn("mean", six("mean"))


@query(f"WITH {E} SELECT (a.i - 1)::int AS i, (b.i - 1)::int AS j, round(sum(v[a.i] * v[b.i]), 6) + 0.0 AS g FROM e, range(1, 65) AS a(i), range(1, 65) AS b(i) WHERE a.i <= b.i GROUP BY 1, 2")
def gramian(spark, sf_dir):
    return statistics.gramian(embeddings(spark, sf_dir)).where("i >= 0").select("i", "j", six("g").alias("g"))


@query(f"WITH {E} SELECT (a.i - 1)::int AS i, (b.i - 1)::int AS j, round(covar_samp(v[a.i], v[b.i]), 6) + 0.0 AS c FROM e, range(1, 65) AS a(i), range(1, 65) AS b(i) GROUP BY 1, 2")
def covariance(spark, sf_dir):
    c = statistics.covariance(embeddings(spark, sf_dir))
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))], "i int, j int, c double").withColumn("c", six("c"))


@query(f"WITH {E} SELECT round(sum(x), 6) AS variance FROM (SELECT var_samp(v[i]) AS x FROM e, range(1, 65) AS r(i) GROUP BY i)")
def pca_variance(spark, sf_dir):
    """The variances of all components add up to those of the elements."""
    p = projections.pca(embeddings(spark, sf_dir), DIM)
    return spark.createDataFrame([(float(p.variance.sum()),)], "variance double").withColumn("variance", six("variance"))


@query(f"WITH {E} SELECT id, round(list_inner_product(v, v), 6) AS before, round(list_inner_product(v, v), 6) AS rotated, round(list_inner_product(v, v), 6) AS pq_rotated FROM e")
def rotations(spark, sf_dir):
    """Rotations keep lengths: random orthogonal, and the one for product quantization."""
    rows = embeddings(spark, sf_dir)
    turned = projections.opq(rows, SUB)(projections.random_orthogonal(DIM, DIM)(rows, "a"), "b")
    return turned.select("id", six(vec.squared_norm(F.col("vec"))).alias("before"), six(vec.squared_norm(F.col("a"))).alias("rotated"), six(vec.squared_norm(F.col("b"))).alias("pq_rotated"))


def _matrix_sql(m) -> str:
    """Columns of a projection as lists in SQL."""
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::double" for x in c) + "]" for c in m.T.tolist()) + "]"


_GAUSSIAN, _THIN, _TURN = projections.gaussian(DIM, 16), projections.sparse(DIM, 16), projections.random_orthogonal(DIM, 16)
_TIMES = ", ".join(f"list_transform({_matrix_sql(p.weights)}, lambda c: round(list_inner_product(v, c), 6) + 0.0) AS {n}" for n, p in (("gaussian", _GAUSSIAN), ("thin", _THIN), ("turned", _TURN)))


@query(f"WITH {E} SELECT id, {_TIMES} FROM e")
def random_projections(spark, sf_dir):
    """Gaussian, sparse and orthogonal projections to 16 elements."""
    out = _TURN(_THIN(_GAUSSIAN(embeddings(spark, sf_dir), "a"), "b"), "c")
    return out.select("id", F.transform("a", six).alias("gaussian"), F.transform("b", six).alias("thin"), F.transform("c", six).alias("turned"))


_LOG = "SELECT event_id AS seq, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'remove' ELSE 'update' END AS op, user_id AS id, value FROM events"


def _log(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    return events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == first, "remove").otherwise("update").alias("op"), F.col("user_id").alias("id"), F.array(F.col("value").cast("float")).alias("vec"), "value")


@query(f"WITH l AS ({_LOG}) SELECT id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM l) WHERE n = 1 AND op <> 'remove'")
def mutation_latest(spark, sf_dir):
    """What lives after a log: each id's last row, unless it removes."""
    return mutations.latest(_log(spark, sf_dir)).where("op <> 'remove'").select("id", "seq", "value")


@query(f"""WITH l AS ({_LOG}), b AS (SELECT -1 AS seq, 'add' AS op, vec_id AS id, NULL AS value FROM embeddings UNION ALL SELECT * FROM l)
SELECT count(*) AS size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM b) WHERE n = 1 AND op <> 'remove'""")
def mutation_apply(spark, sf_dir):
    """Size of a base table after a log."""
    return mutations.apply(embeddings(spark, sf_dir).select("id", F.col("vec").cast("array<float>").alias("vec")), _log(spark, sf_dir)).agg(F.count(F.lit(1)).alias("size"))


@query(f"""WITH l AS ({_LOG}), b AS (SELECT -1 AS seq, 'add' AS op, vec_id AS id FROM embeddings UNION ALL SELECT seq, op, id FROM l)
SELECT id, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM b) WHERE n = 1 AND op <> 'add'""")
def mutation_unknown(spark, sf_dir):
    """Log rows that change an id which nothing has added."""
    return mutations.unknown(embeddings(spark, sf_dir).select("id", F.col("vec").cast("array<float>").alias("vec")), _log(spark, sf_dir)).select("id", "seq")


@query(r"""WITH t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), b AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
nt AS (SELECT id, count(*) AS n FROM t GROUP BY id), nb AS (SELECT qid, count(*) AS n FROM b GROUP BY qid), c AS (SELECT qid, id, count(*) AS c FROM t JOIN b ON t.w = b.w GROUP BY 1, 2),
s AS (SELECT c.qid, c.id, 1 - c / (nt.n + nb.n - c)::double AS d FROM c JOIN nt ON nt.id = c.id JOIN nb ON nb.qid = c.qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s)
SELECT qid, id, round(d, 6) AS dist, rank::int AS rank FROM r WHERE rank <= 10""")
def token_jaccard(spark, sf_dir):
    """The documents whose words are nearest to each test item's, by Jaccard distance over an inverted list."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words(F.col("text")).alias("ws"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words(F.col("text")).alias("ws"))
    return found(sets.nearest(docs, items, K))


@query("""WITH x AS (SELECT event_id AS id, event_id AS x, user_id AS y FROM events)
SELECT id, bit_count(x)::int AS ones, bit_count(xor(x, y))::int AS hamming, CASE WHEN x = 0 THEN NULL ELSE (bit_count(xor(x, x - 1)) - 1)::int END AS lowest, CASE WHEN x = 0 THEN NULL ELSE length(bin(x)) - 1 END::int AS highest,
(x & greatest(x - 1, 0)) AS cleared, (x & -x) AS isolated, bit_count(x) = 1 AS power, CASE WHEN x <= 1 THEN 1 ELSE (1::bigint << length(bin(x - 1))::int) END AS next_power, x AS morton_x, y AS morton_y, x AS unpacked FROM x""")
def bit_functions(spark, sf_dir):
    x, y = F.col("event_id"), F.col("user_id")
    back = bits.deinterleave(bits.interleave(x, y))
    flags = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: bits.bit(x, i) == 1)
    value = F.aggregate(F.transform("flags", lambda b, i: F.when(b, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return table(spark, sf_dir, "events").withColumn("flags", bits.unpack_bits(bits.pack_bits(flags), 32)).select(
        x.alias("id"), bits.popcount(x).alias("ones"), bits.hamming(x, y).alias("hamming"), bits.lowest_set_bit(x).alias("lowest"), bits.highest_set_bit(x).alias("highest"), bits.clear_lowest_bit(x).alias("cleared"),
        bits.isolate_lowest_bit(x).alias("isolated"), bits.is_power_of_2(x).alias("power"), bits.next_power_of_2(x).alias("next_power"), back["x"].alias("morton_x"), back["y"].alias("morton_y"), value.cast("long").alias("unpacked"),
    )


@query()
def random_sample(spark, sf_dir):
    """A hundred rows by seeded hash, the same under any partitioning."""
    return sampling.sample(embeddings(spark, sf_dir).select("id", "label"), 100)
