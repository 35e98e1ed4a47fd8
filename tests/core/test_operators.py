import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.operators import diversify, filters, knn, sampling, statistics

VEC = "id long, vec array<float>"
UNIT = [(0, [0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 1.0, 1.0])]


@pytest.fixture(scope="module")
def unit(spark):
    return spark.createDataFrame(UNIT, VEC)


def test_one_query(unit):
    assert knn.nearest_one(unit, [0, 0, 0], 1).collect()[0][:] == (0, 0.0)
    assert [r["id"] for r in knn.nearest_one(unit, [0, 0, 0], 9).collect()] == [0, 1, 2, 3, 4]
    assert knn.nearest_one(unit, [0, 0, 0], 0).count() == 0


def test_radius_includes_its_border(spark, unit):
    q = spark.createDataFrame([(7, [0.0, 0.0, 0.0])], VEC)
    assert sorted(r["id"] for r in knn.within(unit, q, 1.0).collect()) == [0, 1, 2, 3]
    assert [r["id"] for r in knn.within(unit, q, 1.5, most=2).orderBy("dist", "id").collect()] == [0, 1]


@pytest.mark.parametrize("measure", ["l1", "l2", "squared_l2", "dot", "cosine", "hamming", "limited_inner_product"])
def test_batch_matches_a_plain_version(spark, measure, monkeypatch):
    from quillan.functions.distance import pairs

    rng = np.random.default_rng(2)
    x = np.round(rng.random((300, 6)), 1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    monkeypatch.setattr(knn, "STEP", 64)
    monkeypatch.setattr(knn, "MAX_QUERY_BYTES", 400)
    got = sorted((r["qid"], r["rank"], r["id"]) for r in knn.nearest(df, df.where("id < 20"), 5, measure).collect())
    want = []
    for q in range(20):
        d = pairs(measure, np.repeat(x[q : q + 1], 300, 0), x)
        want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(d))[:5])]
    assert got == sorted(want)


def test_invalid_and_empty(spark, unit):
    q = spark.createDataFrame([(1, [0.0, 0.0])], VEC)
    with pytest.raises(InvalidArgument):
        knn.nearest(unit, q)
    assert knn.nearest(unit.limit(0), q).count() == 0
    assert knn.nearest(unit, q.limit(0)).count() == 0
    assert knn.nearest(unit, unit, 0).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [1.0, 2.0, 3.0]), (2, [1.0, None, 3.0])], VEC)
    assert knn.nearest(odd, unit).count() == 0


def test_rerank_and_results(spark, unit):
    c = spark.createDataFrame([(0, 4), (0, 1), (0, 99)], "qid long, id long")
    out = knn.results(knn.rerank(c, unit, unit, 5)).first()
    assert out["ids"] == [1, 4] and out["top"] == 1 and out["dists"] == [1.0, 3.0]


def test_filters(spark, unit):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = lambda df: sorted(r["id"] for r in df.collect())
    assert got(filters.allow(unit, ids(1, 3, 3, 9), capacity=3)) == [1]
    assert got(filters.deny(unit, ids(0, 2), capacity=4)) == [1, 3]
    assert filters.count_allowed(ids(1, 3, 5, 7, 7), 10).first()[0] == 4 and filters.count_not_denied(ids(0, 2, 4), 10).first()[0] == 7
    i = F.col("id")
    assert got(unit.where(filters.all_of())) == [0, 1, 2, 3, 4] and got(unit.where(filters.any_of())) == []
    assert got(unit.where(filters.all_of(filters.in_range(i, 1, 4), filters.none_of(i == 2)))) == [1, 3]
    tokens = spark.createDataFrame([(0, 100), (0, 200), (1, 100), (1, 300), (2, 200), (2, 300)], "id long, token long")
    assert got(filters.with_any_token(tokens, [100, 5])) == [0, 1] and got(filters.with_any_token(tokens, [200, 300])) == [0, 1, 2]


@pytest.fixture(scope="module")
def crowd(spark):
    rows = [(1, i, 0.1 * (i + 1), c, i % 2, [1.0, float(i)]) for i, c in enumerate([0, None, 0, 1, 1, 2])]
    return spark.createDataFrame(rows, "qid long, id long, dist double, crowd int, parity int, vec array<double>")


def test_crowding(crowd):
    got = diversify.crowding(crowd, 10, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 3, 4, 5] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert diversify.crowding(crowd, 4, enabled=False).count() == 4
    full = {r["crowd"]: r["full"] for r in diversify.crowds_full(crowd, 3).collect()}
    assert full == {0: True, 1: False, 2: False}


def test_crowding_in_two_dimensions(crowd):
    got = [r["id"] for r in diversify.crowding_many(crowd, 10, {"crowd": 2, "parity": 2}).orderBy("rank").collect()]
    assert got == [0, 1, 3, 4]


def test_mmr_keeps_the_nearest_and_spreads(crowd):
    rows = crowd.toPandas()
    got = [r["id"] for r in diversify.mmr(crowd, 3, 0.5).orderBy("rank").collect()]
    v = np.stack(rows["vec"])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen = [0]
    while len(chosen) < 3:
        score = {i: -0.5 * rows["dist"][i] - 0.5 * max(v[i] @ v[j] for j in chosen) for i in range(6) if i not in chosen}
        chosen.append(max(score, key=lambda i: (score[i], -i)))
    assert got == chosen
    assert [r["id"] for r in diversify.mmr(crowd, 3, 5.0).orderBy("rank").collect()] == [0, 1, 2]


def test_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 5))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "vec": [list(map(float, r)) for r in x], "g": [i % 3 for i in range(200)]})).repartition(4)
    n, mean, gram = statistics.moments(df)
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(gram, x.T @ x)
    assert np.allclose(statistics.covariance(df), np.cov(x.T))
    s = statistics.element_stats(df).first()
    assert s["n"] == 1000 and s["std"] == pytest.approx(x.std(ddof=1))
    means = {r["g"]: r["mean"] for r in statistics.group_means(df, "g").collect()}
    assert all(np.allclose(means[g], x[np.arange(200) % 3 == g].mean(0)) for g in range(3))
    assert statistics.moments(df.limit(0))[0] == 0


def test_recall(spark):
    schema = "qid long, id long, rank int"
    truth = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 9, 2)], schema)
    found = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 9, 3)], schema)
    assert statistics.recall(found, truth, 2).first()[0] == 0.5
    assert statistics.recall(found, truth.limit(0), 2).first()[0] == 0.0


def test_samples(spark):
    df = spark.range(1000)
    a = sorted(r["id"] for r in sampling.sample(df.repartition(7), 20, 3).collect())
    assert a == sorted(r["id"] for r in sampling.sample(df, 20, 3).collect()) and len(set(a)) == 20
    assert sampling.sample(df, 5000).count() == 1000
    assert sampling.sample_with_replacement(spark.range(3), 50).count() == 50
    assert sampling.sample_with_replacement(spark.range(0), 50).count() == 0
