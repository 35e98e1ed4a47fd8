"""All pairs by kernels, against the column expressions."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillan import catalog, catalog_models  # noqa: F401  registers its queries
from quillan.functions import distance
from quillan.operators import crossed, knn
from quillan.plans import pq

SF = "/root/testdata/sf0.001"


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "vec": [list(map(float, r)) for r in x]})).repartition(3)


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(5).normal(size=(90, 12))
    return x, frame(spark, x)


def outputs(df):
    """Columns that the last Python step of a plan hands out."""
    return next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line).split("[", 1)[1]


def table(df, *keys):
    return df.toPandas().sort_values(list(keys or ("qid", "id"))).reset_index(drop=True)


def test_rounded():
    x = np.array([0.0078125, -0.0078125, -1e-9, 1.5e-6, np.inf, -np.inf, 1e305, 3.0])
    assert crossed.rounded(x, 6).tolist() == [0.007813, -0.007813, 0.0, 2e-6, np.inf, -np.inf, 1e305, 3.0]
    assert not np.signbit(crossed.rounded(np.array([-0.0, -1e-9]), 6)).any() and np.isnan(crossed.rounded(np.array([np.nan]), 6))[0]


def test_adc_expressions_hand_out_no_tables(spark):
    df = catalog.QUERIES["adc_expressions"](spark, SF)
    assert df.columns == ["qid", "id", "dist"] and "lut" not in outputs(df)


@pytest.mark.parametrize("piece, spread, at_once", [(4096, 64, 4096), (7, 1, 4)])
def test_lookups(cloud, monkeypatch, piece, spread, at_once):
    x, df = cloud
    monkeypatch.setattr(crossed, "SPREAD", spread)
    monkeypatch.setattr(crossed, "PIECE", piece)
    book = pq.Codebook(tuple(x[:20, s * 4 : s * 4 + 4] for s in range(3)))
    coded, q = pq.encode(df, book).select("id", "codes"), df.where("id % 9 = 0")
    got = table(crossed.crossed(coded, q, pq.Lookup(book), at_once=at_once))
    both = knn.paired(coded, pq.with_tables(q, book).select(F.col("id").alias("qid"), "lut"))
    want = table(both.select("qid", "id", pq.adc(F.col("codes"), F.col("lut")).alias("dist")))
    assert got.equals(want) and len(got) == 900


def test_lookups_of_missing_vectors(spark):
    book = pq.Codebook((np.array([[0.0], [1.0]]), np.array([[0.0], [2.0]])))
    base = spark.createDataFrame([(1, [0, 1]), (2, None)], "id long, codes array<smallint>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [None, 1.0])], "id long, vec array<double>")
    got = {(r["qid"], r["id"]): r["dist"] for r in crossed.crossed(base, q, pq.Lookup(book)).collect()}
    assert got == {(a, b): 4.0 if (a, b) == (1, 1) else None for a in (1, 2, 3) for b in (1, 2)}


def sparse(spark, rows):
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id long, s struct<dim: bigint, indices: array<bigint>, vals: array<double>>")


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_sparse_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(crossed.Sparse, "cells", cells)
    rng = np.random.default_rng(6)
    rows = [(10**9, sorted(map(int, rng.choice([0, 3, 5, 7, 10**8, 10**8 + 1], n, replace=False))), [float(v) for v in rng.choice([-1.5, 0.0, 0.3, 2.0], n)]) for n in rng.integers(0, 6, 40)]
    df = sparse(spark, rows)
    q = df.where("id % 5 = 0")
    got = table(crossed.crossed(df, q, crossed.Sparse()))
    both = knn.paired(df.withColumnRenamed("s", "b"), q.select(F.col("id").alias("qid"), F.col("s").alias("a")))
    a, b = F.col("a"), F.col("b")
    d = lambda m: distance.sparse_distance(m, a, b).alias(m)
    want = table(both.select("qid", "id", d("jaccard"), d("dice"), distance.overlap_coefficient(a["indices"], b["indices"]).alias("overlap"), d("non_zero_intersect"), distance.weighted_jaccard(a, b).alias("weighted_jaccard"), *[d(m) for m in ("l1", "squared_l2", "dot", "cosine")]))
    assert list(got.columns) == list(want.columns) and len(got) == 320 and np.allclose(got, want, atol=1e-12)


def test_sparse_rows_that_are_missing_or_wrong(spark):
    whole = (9, [1, 4], [1.0, 2.0])
    df = sparse(spark, [whole, None, (9, None, None), (9, [1, 2], [None, 1.0]), (9, [], [])])
    got = {(r["qid"], r["id"]): r["l1"] for r in crossed.crossed(df, df, crossed.Sparse()).collect()}
    assert got == {(a, b): None if {a, b} & {1, 2, 3} else 0.0 if a == b else 3.0 for a in range(5) for b in range(5)}
    for bad in ((9, [1, 1], [1.0, 2.0]), (9, [1, 2], [1.0])):
        for base, q in (([whole], [bad]), ([bad], [whole])):
            with pytest.raises(Exception, match="one value for each"):
                crossed.crossed(sparse(spark, base), sparse(spark, q), crossed.Sparse()).collect()


def test_sparse_measures_hand_out_no_vectors(spark):
    df = catalog.QUERIES["sparse_measures"](spark, SF)
    assert df.columns == ["qid", "id", "jaccard", "dice", "overlap", "nzi", "wjaccard", "l1", "sql2", "dot", "cosine"] and "a#" not in outputs(df)


def test_adc_int8_hands_out_no_tables(spark):
    df = catalog.QUERIES["adc_int8"](spark, SF)
    assert df.columns == ["qid", "id", "raw", "dist"] and "lut8" not in outputs(df)


def test_lookups_of_8_bits(spark, cloud):
    x, df = cloud
    book = pq.Codebook(tuple(x[:20, s * 4 : s * 4 + 4] for s in range(3)))
    coded, q = pq.encode(df, book).select("id", "codes"), df.where("id % 9 = 0")
    got = table(crossed.crossed(coded, q, pq.Lookup8(book)))
    both = knn.paired(coded, pq.with_tables(q, book).select(F.col("id").alias("qid"), pq.to_int8(F.col("lut")).alias("lut8")))
    want = table(both.select("qid", "id", pq.adc_int8_raw(F.col("codes"), F.col("lut8")).alias("raw"), pq.adc_int8(F.col("codes"), F.col("lut8")).alias("dist")))
    assert got.equals(want) and len(got) == 900
    alike = pq.Codebook(tuple(np.zeros((n, 4)) for n in (2, 1, 2)))
    q = frame(spark, np.array([[0.0] * 12])).unionByName(spark.createDataFrame([(1, None), (2, [np.inf] * 12)], "id long, vec array<double>"))
    got = crossed.crossed(spark.createDataFrame([(5, [1, 0, 1]), (6, None)], "id long, codes array<smallint>"), q, pq.Lookup8(alike))
    assert {r[:] for r in got.collect()} == {(0, 5, 0, 0.0), (0, 6, None, None), (1, 5, None, None), (1, 6, None, None), (2, 5, 0, np.inf), (2, 6, None, None)}


def test_measures_hand_out_no_vectors(spark):
    df = catalog.QUERIES["measures"](spark, SF)
    assert df.columns == ["qid", "id", "l1", "l2", "sql2", "dot", "cosine", "hamming", "nzi", "dice"] and "vec" not in outputs(df)


@pytest.mark.parametrize("piece", [4096, 1])
def test_dense_pairs(cloud, monkeypatch, piece):
    monkeypatch.setattr(crossed, "PIECE", piece)
    x, _ = cloud
    x = np.where(np.abs(x) < 0.3, 0.0, np.round(x, 1) * 0.2)
    x[3] = 0.0
    df = frame(cloud[1].sparkSession, x)
    names = [m.value for m in distance.Measure]
    got = table(crossed.crossed(df, df.where("id % 9 = 3"), crossed.Dense(*names)))
    both = knn.paired(df, df.where("id % 9 = 3").select(F.col("id").alias("qid"), F.col("vec").alias("w")))
    want = table(both.select("qid", "id", *[distance.distance(m, F.col("w"), F.col("vec"), True).alias(m) for m in names]))
    exact = [m for m in names if m != "cosine"]
    assert got[exact].equals(want[exact]) and np.allclose(got["cosine"], want["cosine"], atol=1e-15) and len(got) == 900


def test_dense_pairs_of_odd_vectors(spark):
    kind = "id long, vec array<double>"
    base = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [float("nan"), 2.0]), (5, [])], kind)
    got = {(r["qid"], r["id"]): (r["l1"], r["hamming"]) for r in crossed.crossed(base, base, crossed.Dense("l1", "hamming")).collect()}
    null = (None, None)
    assert len(got) == 36 and got[0, 0] == got[2, 2] == got[5, 5] == (0.0, 0.0) and got[0, 2] == got[2, 0] == got[5, 0] == got[3, 3] == got[1, 1] == got[0, 1] == got[0, 3] == null
    assert np.isnan(got[0, 4][0]) and got[0, 4][1] == 1.0 and got[4, 4][1] == 0.0


def test_settled():
    x = np.array([0.25, 1e-9, -1e-9, 0.1499, np.nan, np.inf, 1e308])
    with np.errstate(all="ignore"):
        whole, sure = crossed.settled(x, 1, 0.001)
    assert sure.tolist() == [False, True, True, False, False, False, False] and whole[1:4].tolist() == [0.0, 0.0, 0.1] and not np.signbit(whole[1:3]).any()


def scored(scorer, run, queries, rows, digits):
    """Fields by query and row, None where they are null."""
    exact = [name in scorer.exact for name in (f.split()[0] for f in scorer.fields.split(", "))]
    column, out = pa.array(rows, pa.list_(pa.float64())), {}
    with np.errstate(all="ignore"):
        for own, values, bad in run(scorer, scorer.ask(pa.array(queries, pa.list_(pa.float64()))), column, digits, exact):
            pairs = [(i, j) for i in own for j in range(len(rows))]
            out |= dict(zip(pairs, zip(*[pa.array(v, mask=bad).to_pylist() for v in values]), strict=True))
    return out


def unit(n, dim=16):
    x = np.random.default_rng(7).normal(size=(n, dim)).astype(np.float32).astype(float)
    return x / np.sqrt((x * x).sum(1))[:, None]


ODD = [None, [], [1.0], [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [0.0] * 16, [-0.0] * 16, [1e-170] * 16, [1e170] * 16, [0.0078125] * 16]
CLOUDS = {
    "unit": unit(300),
    "long": unit(100) * 1e7,
    "short": unit(100) * 1e-7,
    "halves": np.random.default_rng(8).integers(-3, 4, (200, 16)) * 2.0**-7,
    "copies": np.repeat(unit(5), 40, axis=0),
    "near": unit(1) + 1e-9 * unit(100),
}


@pytest.mark.parametrize("cloud", CLOUDS)
@pytest.mark.parametrize("digits", [2, 6, 14])
def test_rounded_pairs_are_those_of_sums_in_order(cloud, digits):
    rows = [*CLOUDS[cloud].tolist(), *ODD]
    scorer = crossed.Dense(*distance.Measure)
    queries = rows[:: len(rows) // 20] + ODD
    got, want = (scored(scorer, run, queries, rows, digits) for run in (crossed.Dense.scored, crossed.Scorer.scored))
    assert got.keys() == want.keys() and len(got) == len(queries) * len(rows) and str(sorted(got.items())) == str(sorted(want.items()))


def test_measures_sum_few_pairs_in_order(monkeypatch):
    rows, summed, one = unit(2000).tolist(), [], crossed.Dense._one
    monkeypatch.setattr(crossed.Dense, "_one", lambda self, q, x, *more: summed.append(x.shape[1]) or one(self, q, x, *more))
    scorer = crossed.Dense("l1", "l2", "squared_l2", "dot", "cosine", "hamming", "non_zero_intersect", "dice")
    assert len(scored(scorer, type(scorer).scored, rows[::50], rows, 6)) == 80_000 and 40 <= sum(summed) < 80


def test_dense_columns_by_name(spark):
    df = frame(spark, np.array([[0.25, 1.0], [0.25, 0.0]]))
    got = crossed.crossed(df, df.where("id = 0"), crossed.Dense("squared_l2", "hamming", names={"squared_l2": "a", "hamming": "b"}), 1)
    assert got.columns == ["qid", "id", "a", "b"] and {r[:] for r in got.collect()} == {(0, 0, 0.0, 0.0), (0, 1, 1.0, 1.0)}
