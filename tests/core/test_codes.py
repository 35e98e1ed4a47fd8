import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillan import catalog
from quillan.errors import InvalidArgument
from quillan.functions import quantize
from quillan.functions.distance import matrix
from quillan.operators import codes, knn, sampling, sets, statistics
from quillan.operators.numbering import numbered
from quillan.plans import gmm, index, kmeans, partitioned

SF = "/root/testdata/sf0.1"


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "vec": [list(map(float, r)) for r in x]})).repartition(3)


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(4).normal(size=(300, 12))
    return x, frame(spark, x)


@pytest.mark.parametrize("measure", ["squared_l2", "l2", "dot", "cosine", "l1"])
def test_scalar_codes(cloud, measure):
    x, df = cloud
    p = quantize.calibrate(statistics.element_stats(df).first().asDict())
    payload = codes.ScalarCodes(p)
    coded = df.select("id", quantize.quantize(F.col("vec"), p).alias("codes"))
    q = df.where("id < 4")
    got = codes.nearest(coded, q, payload, 6, measure).orderBy("qid", "rank").collect()
    decoded = df.select("id", quantize.dequantize(quantize.quantize(F.col("vec"), p), p).alias("vec"))
    want = knn.nearest(decoded, q, 6, measure).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in got] == [(r["qid"], r["id"]) for r in want]
    assert np.allclose([r["dist"] for r in got], [r["dist"] for r in want])
    c = np.random.default_rng(1).integers(0, 256, (7, 12)).astype(float)
    assert np.allclose(payload.matrix(knn.Measure(measure), x[:5], c), matrix(measure, x[:5], payload.values(c)))
    radius = want[3]["dist"]
    assert codes.within(coded, df.where("id = 0"), payload, radius, measure).count() == knn.within(decoded, df.where("id = 0"), radius, measure).count() >= 4


def test_memory(cloud):
    _, df = cloud
    p = quantize.ScalarParams(-4.0, 4.0)
    coded = df.select("id", quantize.quantize(F.col("vec"), p).alias("codes"))
    assert tuple(codes.memory(coded, codes.ScalarCodes(p)).first()) == (300, 300 * 16, 300 * 48, 4.0)
    assert tuple(codes.memory(coded, codes.Bf16Codes(), norms=False).first()) == (300, 300 * 24, 300 * 48, 2.0)
    assert codes.memory(coded.limit(0), codes.ScalarCodes(p)).first()["ratio"] == 0.0
    with pytest.raises(InvalidArgument):
        codes.memory(coded, knn.Payload())


def test_bounds_do_not_change_results(cloud, monkeypatch):
    x, df = cloud
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    q = df.where("id % 7 = 0")
    nearest, radius = rows(knn.nearest(df, q, 5)), rows(knn.within(df, q, 9.0))
    c = kmeans.Clusters(x[:6], 0.0, 0)
    own = partitioned.tokenize(df, c)
    routed = rows(partitioned.search(own, c.table(df.sparkSession), q, 5, 3))
    ids = df.where("id % 2 = 0").select("id")
    allowed = rows(knn.nearest(df, q, 5, allowed=ids))
    again = rows(knn.rerank(knn.nearest(df, q, 9, "l1"), df, q, 4, each=9))
    for name, value in (("CELLS", 50), ("MAX_QUERIES", 10), ("MAX_CANDIDATES", 3)):
        monkeypatch.setattr(knn, name, value)
        if hasattr(partitioned, name):
            monkeypatch.setattr(partitioned, name, value)
    assert rows(knn.nearest(df, q, 5)) == nearest and rows(knn.within(df, q, 9.0)) == radius
    assert rows(partitioned.search(own, c.table(df.sparkSession), q, 5, 3)) == routed
    assert rows(knn.nearest(df, q, 5, allowed=ids)) == allowed
    assert rows(knn.rerank(knn.nearest(df, q, 9, "l1"), df, q, 4, each=9)) == again


def test_rerank_and_lists_leave_the_base_where_it_is(cloud):
    _, df = cloud
    q = df.where("id < 3")
    plan = knn.rerank(df.where("id < 30").select(F.lit(1).cast("long").alias("qid"), "id"), df, q, 4, each=30)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_paired(cloud):
    _, df = cloud
    q = df.where("id < 5").select(F.col("id").alias("qid"), F.struct("vec").alias("w"))
    for at_once in (4096, 2):
        got = knn.paired(df, q, at_once)
        assert got.columns == ["qid", "w", "id", "vec"] and got.distinct().count() == 1500


def test_predicates_on_indexes(spark, cloud):
    x, df = cloud
    rows = df.withColumn("color", F.col("id") % 3)
    for config in (index.Config(), index.Config().tree(4, 4), index.Config().tree(4, 4).hash(4, 16).reorder(300)):
        got = config.build(rows, keep=("color",)).search(df.where("id < 5"), 6, where=(F.col("color") == 1) & (F.col("id") < 200))
        want = knn.nearest(rows.where("color = 1 and id < 200"), df.where("id < 5"), 6)
        same = lambda d: sorted((r["qid"], r["rank"], r["id"]) for r in d.collect())
        assert same(got) == same(want)


def test_registered_searches_reach_recall(spark):
    rows = catalog.embeddings(spark, SF)
    truth = knn.nearest(rows, catalog.asked(rows), 10).cache()
    for name in ("ivf_knn", "hybrid_knn"):
        assert statistics.recall(catalog.QUERIES[name](spark, SF), truth, 10).first()[0] >= 0.9, name


def test_sets_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, [f"w{k}" for k in rng.choice(30, rng.integers(0, 9), replace=False)]) for i in range(80)] + [(None, ["w1"]), (90, None)]
    asked = [(i, [f"w{k}" for k in rng.choice(35, rng.integers(0, 9), replace=False)]) for i in range(12)]
    want = []
    for q, a in asked:
        near = sorted((1 - len(set(a) & set(b)) / len(set(a) | set(b)), i) for i, b in data if i is not None and b and set(a) & set(b))
        want += [(q, i, round(d, 9), n + 1) for n, (d, i) in enumerate(near[:5])]
    df, q = spark.createDataFrame(data, "id long, ws array<string>").repartition(3), spark.createDataFrame(asked, "qid long, ws array<string>")
    for cells in (4_000_000, 20):
        monkeypatch.setattr(sets, "CELLS", cells)
        assert sorted((r["qid"], r["id"], round(r["dist"], 9), r["rank"]) for r in sets.nearest(df, q, 5).collect()) == sorted(want)
    assert sets.nearest(df, q.limit(0), 5).count() == 0


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).repartition(7)
    got = numbered(df, "n", 5).collect()
    assert sorted(r["n"] for r in got) == list(range(5, 1005)) and {r["id"] for r in got} == set(range(1000))
    assert sampling.sample_with_replacement(df, 50).count() == 50


def test_trees_from_shared_passes(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal((10 * a, 10 * b), 0.2, (40, 2)) for a in range(3) for b in range(3)])
    df = frame(spark, x)
    tree = kmeans.fit_tree(df, children=3, depth=2, min_leaf=5, steps=20)
    placed = {r["id"]: r["partition_id"] for r in tree.place(df).collect()}
    sizes = np.bincount(list(placed.values()), minlength=len(tree.leaves))
    assert [tree.nodes[n].size for n in tree.leaves] == sizes.tolist() and sum(sizes) == 360
    assert max(n.depth for n in tree.nodes) == 2
    for node in tree.nodes:
        if node.children:
            assert node.size == sum(tree.nodes[c].size for c in node.children)


def test_given_starts(spark, cloud):
    x, df = cloud
    one = kmeans.fit(df, 3, steps=1, tol=0.0, start=x[:3])
    at = ((x[:, None] - x[None, :3]) ** 2).sum(2).argmin(1)
    assert np.allclose(one.centers, [x[at == k].mean(0) for k in range(3)])
    m = gmm.Mixture("full", np.full(2, 0.5), x[:2], np.stack([np.eye(12)] * 2))
    r, ll = m.share(x)
    after = gmm.step(df, m)
    assert np.allclose(after.weights, r.mean(0)) and np.allclose(after.means, (r.T @ x) / r.sum(0)[:, None]) and np.isclose(after.log_likelihood, ll.sum())
