import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillan import catalog, catalog_models  # noqa: F401  registers its queries
from quillan.errors import FailedPrecondition, InvalidArgument
from quillan.operators import crossed, knn, statistics
from quillan.plans import gmm, index, kmeans, partitioned, pq, projections
from quillan.sources import datasets


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "vec": [list(map(float, r)) for r in x]})).repartition(3)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (10, 10), (0, 10))])
    return x, frame(spark, x)


@pytest.fixture(scope="module")
def waves(spark):
    x = np.sin(np.outer(np.arange(500), np.arange(1, 33)) / 100)
    return x, frame(spark, x)


def test_kmeans_finds_blobs(blobs):
    x, df = blobs
    c = kmeans.fit(df, 3, seed=1)
    assert sorted(map(tuple, np.round(c.centers).tolist())) == [(0, 0), (0, 10), (10, 10)]
    assert c.inertia == pytest.approx(kmeans.nearest_center(x, c.centers)[1].sum())
    assert kmeans.assign(df, c.centers).groupBy("cluster").count().agg(F.min("count")).first()[0] == 60
    best = kmeans.fit(df, 3, seed=1, restarts=3)
    assert best.inertia <= c.inertia + 1e-9


def test_kmeans_limits(spark, blobs):
    assert len(kmeans.fit(frame(spark, np.eye(2)), 5).centers) == 2
    with pytest.raises(InvalidArgument):
        kmeans.fit(blobs[1].limit(0), 2)


def test_tree(spark, blobs):
    x, df = blobs
    tree = kmeans.fit_tree(df, children=3, depth=2, min_leaf=5, steps=10)
    nodes = tree.table(spark).collect()
    placed = tree.place(df).groupBy("partition_id").count().collect()
    assert sum(r["count"] for r in placed) == 180 and {r["partition_id"] for r in placed} <= set(range(len(tree.leaves)))
    assert nodes[0]["size"] == 180 and sum(n["is_leaf"] for n in nodes) == nodes[0]["num_leaves"] == len(tree.leaves) > 3
    sizes = {n["node_id"]: n["size"] for n in nodes}
    assert {r["partition_id"]: r["count"] for r in placed} == {i: sizes[leaf] for i, leaf in enumerate(tree.leaves)}
    assert [n["node_id"] for n in kmeans.fit_tree(df, children=200).table(spark).collect()] == [0]
    d = ((tree.centers() - np.array([10.0, 10])) ** 2).sum(1)
    assert tree.nearest_leaves(np.array([10.0, 10]), 2)[0][0] == d.argmin()


def test_routing_and_partitioned_search(spark, blobs):
    x, df = blobs
    c = kmeans.fit(df, 3, seed=1)
    rows = partitioned.tokenize(df, c)
    routes = partitioned.route(df.where("id < 5"), c.table(spark), 2, partitioned.sizes(rows)).collect()
    assert len(routes) == 10 and all(r["size"] == 60 for r in routes)
    every = partitioned.search(rows, c.table(spark), df.where("id < 5"), 7, 3).orderBy("qid", "rank").collect()
    exact = knn.nearest(df, df.where("id < 5"), 7).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in every] == [(r["qid"], r["id"]) for r in exact]
    few = partitioned.search(rows, c.table(spark), df.where("id = 0"), 100, 1, where=F.col("id") < 100)
    assert few.count() == 60


def test_product_quantization(spark, waves):
    x, df = waves
    book = pq.train(df, 8, 16, seed=1)
    coded = pq.decode(pq.encode(df, book), book).collect()
    far = np.mean([np.sum((np.array(r["vec"]) - np.array(r["decoded"])) ** 2) for r in coded])
    assert far < 0.2 * np.mean((x**2).sum(1)) and all(len(r["codes"]) == 8 for r in coded)
    again = pq.Codebook.of(book.table(spark))
    assert all(np.allclose(a, b) for a, b in zip(again.parts, book.parts))
    with pytest.raises(InvalidArgument):
        pq.train(df, 5)
    with pytest.raises(InvalidArgument):
        pq.train(df, 8, 300)
    codes = pq.encode(df, book).select("codes")
    packed = codes.select("codes", pq.unpack4(pq.pack4(F.col("codes")), 8).alias("back")).collect()
    assert all(r["codes"] == r["back"] for r in packed)


def test_stacked_levels_lower_the_error(waves):
    x, df = waves
    two = pq.train_stacked(df, 2, 4, 8)
    one = pq.Stacked(two.levels[:1])
    assert two.error(x).mean() < one.error(x).mean()
    assert np.allclose(two.decode(two.encode(x)).shape, x.shape)
    assert pq.train_additive(df, 3, 8).encode(x).shape == (500, 3)


@pytest.mark.parametrize("config", [index.Config(), index.Config().tree(10, 3), index.Config().hash(8, 16), index.Config().tree(10, 3).hash(8, 16).reorder(60), index.Config().tree(10, 10).reorder(50)])
def test_indexes(spark, waves, tmp_path, config):
    _, df = waves
    built = config.build(df)
    q = df.where("id % 50 = 0")
    got = built.search(q, 10)
    rows = got.collect()
    assert all(r["rank"] <= 10 for r in rows) and len(rows) == 100
    truth = knn.nearest(df, q, 10)
    floor = {"brute_force": 1.0, "partitioned": 0.6, "hashed": 0.3, "tree_hash": 0.6}[config.kind]
    assert statistics.recall(got, truth, 10).first()[0] >= floor
    built.save(str(tmp_path / "index"))
    loaded = index.Index.load(spark, str(tmp_path / "index"))
    same = lambda d: sorted((r["qid"], r["rank"], r["id"]) for r in d.collect())
    assert same(loaded.search(q, 10)) == same(got)
    only = spark.createDataFrame([(i,) for i in range(100)], "id long")
    assert {r["id"] for r in built.search(q, 5, allowed=only).collect()} <= set(range(100))


def test_index_errors(waves):
    with pytest.raises(InvalidArgument):
        index.Config().build(waves[1].limit(0))
    with pytest.raises(FailedPrecondition):
        index.Config().build(waves[1]).centroids()


def test_pca(spark):
    rng = np.random.default_rng(3)
    x = rng.random((100, 1)) @ np.array([[1.0, 2, 3, 4]]) + rng.random((100, 1)) @ np.array([[0.0, 1, 0, -1]]) + 5
    df = frame(spark, x)
    p = projections.pca(df, 2)
    back = p.inverse(p(df)).collect()
    assert all(np.allclose(r["vec"], r["restored"]) for r in back)
    assert np.allclose(sorted(p.variance)[::-1], np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])
    with pytest.raises(InvalidArgument):
        projections.pca(df, 5)


def test_projections(spark, waves):
    x, df = waves
    turn = projections.random_orthogonal(32, 32, 123)
    assert np.allclose(turn.weights.T @ turn.weights, np.eye(32))
    assert all(np.allclose(r["vec"], r["restored"]) for r in turn.inverse(turn(df)).limit(5).collect())
    rot = projections.opq(df, 4).weights
    assert np.allclose(rot.T @ rot, np.eye(32))
    g = rot.T @ (x.T @ x) @ rot
    assert np.allclose(g[:8, :8], np.diag(np.diag(g[:8, :8])), atol=1e-6 * g.max())
    s = projections.sparse(100, 20).weights
    assert set(np.round(np.unique(np.abs(s)), 9)) == {0, round(np.sqrt(1 / (0.1 * 20)), 9)}
    with pytest.raises(InvalidArgument):
        projections.gaussian(4, 2).inverse(df)
    both = projections.chunked([projections.identity(2), projections.random_orthogonal(3, 2)])
    assert both.weights.shape == (5, 4) and both.invertible
    assert projections.identity(32)(df).where("projected = vec").count() == 500


def test_single_floats_come_back_as_they_were(spark, waves):
    x, turn = waves[0].astype(np.float32), projections.random_orthogonal(32, 32, 123)
    assert all(np.array_equal(x[r["id"]], r["restored"]) for r in turn.inverse(turn(frame(spark, x)), single=True).collect())


@pytest.mark.parametrize("name", ["chunked", "opq", "pca", "random_orthogonal"])
def test_round_trips_keep_values_halfway_between_roundings(spark, tmp_path, name):
    x = (2 * np.random.default_rng(8).integers(-20, 20, (120, 64)) + 1) / 128
    rows = pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": [0] * len(x)})
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES[f"{name}_round_trip"](spark, str(tmp_path)).collect()
    assert len(got) == 120 and all(np.array_equal(crossed.rounded(x[r["id"]], 6), r["restored"]) for r in got)


@pytest.mark.parametrize("kind", gmm.KINDS)
def test_mixture(spark, blobs, kind):
    x, df = blobs
    m = gmm.fit(df, 3, kind, seed=4)
    got = m.predict(df).select("id", "component", "shares").collect()
    by = {r["id"]: r["component"] for r in got}
    assert len({by[0], by[60], by[120]}) == 3 and m.weights.sum() == pytest.approx(1)
    assert all(sum(r["shares"]) == pytest.approx(1) for r in got)
    assert m.log_likelihood == pytest.approx(m.share(x)[1].sum(), rel=1e-3)
    assert np.allclose(np.sort(m.sample(4000).mean(0)), np.sort(x.mean(0)), atol=0.5)
    with pytest.raises(InvalidArgument):
        gmm.fit(df.limit(1), 3)


def test_sources(spark, tmp_path):
    df = datasets.from_flat(spark, [1.0, 2, 3, 4], 2)
    assert [r["vec"] for r in df.orderBy("id").collect()] == [[1, 2], [3, 4]]
    for bad in (lambda: datasets.from_flat(spark, [1.0, 2, 3], 2), lambda: datasets.from_rows(spark, [[1.0], [1.0, 2.0]])):
        with pytest.raises(InvalidArgument):
            bad()
    many = datasets.append(df, spark.range(1000).repartition(7).select(F.array(F.col("id").cast("float"), F.lit(0.0)).alias("vec")))
    assert sorted(r["id"] for r in many.collect()) == list(range(1002))
    named = datasets.append_named(df.withColumn("docid", F.lit("a")), spark.createDataFrame([("a", [7.0, 8.0]), ("b", [9.0, 9.0])], "docid string, vec array<double>").coalesce(1))
    assert [(r["docid"], r["id"]) for r in datasets.id_map(named).orderBy("docid").collect()] == [("a", 2), ("b", 3)]
    more = datasets.append(df, datasets.from_rows(spark, [[5.0, 6]]))
    assert {r["id"]: r["vec"] for r in more.collect()}[2] == [5, 6]
    sparse = spark.createDataFrame([(1, 9, [3, 1, 2], [3.0, 0.0, 2.0])], datasets.SPARSE)
    assert datasets.sparse_rows(sparse).first()[:] == (1, 9, [2, 3], [2.0, 3.0])
    names = datasets.id_map(spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "docid string, id long"))
    assert {r["docid"]: r["id"] for r in names.collect()} == {"a": 4, "b": 2}
    body = {"train": [[0.0, 0], [1.0, 1], [2.0, 2]], "test": [[0.1, 0.1], [2.0, 2]], "neighbors": [[0, 1, 2], [2, 1, 0]]}
    (tmp_path / "b.json").write_text(json.dumps(body))
    train, test, truth = datasets.benchmark_json(spark, str(tmp_path / "b.json"), 2, test_rows=1)
    assert train.count() == 3 and test.count() == 1 and [(r["qid"], r["rank"], r["id"]) for r in truth.orderBy("rank").collect()] == [(0, 1, 0), (0, 2, 1)]
    a, b = datasets.synthetic(spark, 20, 4), datasets.synthetic(spark, 20, 4).repartition(3)
    assert a.exceptAll(b).count() == 0 and a.where("exists(vec, x -> x < 0 or x >= 1)").count() == 0
    with pytest.raises(Exception):
        datasets.checked(df, 3).collect()
