"""Literals of functions, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillan.errors import InvalidArgument
from quillan.functions import bits, distance, quantize
from quillan.functions import vectors as vec

PAIRS = [([1, 2, 3], [4, 5, 6]), ([0, 0], [3, 4]), ([1, 0], [0, 1]), ([1, 0, 1, 0], [1, 1, 0, 0]), ([0, 0], [1, 1]), ([], [])]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(PAIRS)], "i int, a array<double>, b array<double>").cache()


def values(pairs, column):
    return [r["x"] for r in pairs.select("i", column.alias("x")).orderBy("i").collect()]


def test_dense_measures(pairs):
    d = lambda m: values(pairs, distance.distance(m, F.col("a"), F.col("b")))
    assert d("l1")[0] == 9 and d("dot")[0] == -32 and d("general_inner_product")[0] == -32
    assert d("l2")[1] == 5 and d("squared_l2")[1] == 25
    assert d("cosine")[2] == 1 and d("cosine")[4] == 1
    assert d("hamming")[3] == 2 and d("non_zero_intersect")[3] == -1
    assert d("limited_inner_product")[0] == float("inf") and d("limited_inner_product")[2] == 0
    assert d("l2")[5] == 0


def test_numpy_twins_agree(pairs):
    rows = pairs.where("i < 5").collect()
    for m in distance.Measure:
        want = [r["x"] for r in pairs.where("i < 5").select("i", distance.distance(m, F.col("a"), F.col("b"), True).alias("x")).orderBy("i").collect()]
        for r, w in zip(rows, want):
            a, b = np.array([r["a"]]), np.array([r["b"]])
            assert distance.pairs(m, a, b)[0] == pytest.approx(w)
            assert distance.matrix(m, a, b)[0, 0] == pytest.approx(w)


def test_set_measures_need_sparse():
    with pytest.raises(InvalidArgument):
        distance.distance("jaccard", F.lit(1), F.lit(1))


def test_sparse_measures(spark):
    s = "struct<dim:long,indices:array<long>,vals:array<double>>"
    df = spark.createDataFrame([((10, [0, 1, 2], [1.0, 2.0, 0.0]), (10, [1, 2, 3], [3.0, 4.0, 1.0])), ((4, [], []), (4, [], []))], f"a {s}, b {s}")
    d = lambda m: [r[0] for r in df.select(distance.sparse_distance(m, F.col("a"), F.col("b"))).collect()]
    assert d("jaccard") == [0.5, 0.0] and d("dice") == [pytest.approx(1 / 3), 0.0]
    assert d("l1") == [7.0, 0.0] and d("squared_l2") == [19.0, 0.0] and d("dot") == [-6.0, 0.0]
    assert d("cosine")[1] == 1.0 and d("non_zero_intersect") == [-1.0, 0.0]
    w = [r[0] for r in df.select(distance.weighted_jaccard(F.col("a"), F.col("b"))).collect()]
    assert w == [pytest.approx(1 - 2 / 9), 0.0]
    assert [r[0] for r in df.select(distance.overlap_coefficient(F.col("a.indices"), F.col("b.indices"))).collect()] == [pytest.approx(2 / 3), 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    v = F.col("v")
    assert one(vec.norm(v)) == [5, 0] and one(vec.normalize(v)) == [[0.6, 0.8, 0], [0, 0, 0]]
    assert one(vec.element(v, 1)) == [4, 0] and one(vec.element(v, 9)) == [0, 0]
    assert one(vec.with_element(v, 2, 7))[0] == [3, 4, 7] and one(vec.with_element(v, 5, 7))[0] == [3, 4, 0]
    assert one(vec.truncate(v, 4, 1))[0] == [4, 0, 0, 0] and one(vec.untruncate(vec.truncate(v, 1, 1), 3, 1))[0] == [0, 4, 0]
    assert one(vec.chunks(v, 2))[0] == [[3], [4], [0]] and one(vec.join_chunks(vec.chunks(v, 2)))[0] == [3, 4, 0]
    assert one(vec.chunks(v, 9))[0] == [[3], [4], [0]]
    assert one(vec.to_sparse(v))[0].asDict() == {"dim": 3, "indices": [0, 1], "vals": [3, 4]}
    assert one(vec.to_dense(vec.to_sparse(v))) == [[3, 4, 0], [0, 0, 0]]
    assert one(vec.sparse_element(vec.to_sparse(v), 1)) == [4, 0]
    assert one(vec.combine(v, v, -1))[0] == [0, 0, 0]


def test_bits(spark):
    df = spark.createDataFrame([(0,), (1,), (6,), (1 << 40,), (-1,)], "x long")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    x = F.col("x")
    assert one(bits.popcount(x)) == [0, 1, 2, 1, 64]
    assert one(bits.lowest_set_bit(x)) == [None, 0, 1, 40, 0] and one(bits.highest_set_bit(x)) == [None, 0, 2, 40, 63]
    assert one(bits.clear_lowest_bit(x))[:4] == [0, 0, 4, 0] and one(bits.isolate_lowest_bit(x))[:4] == [0, 1, 2, 1 << 40]
    assert one(bits.is_power_of_2(x)) == [False, True, False, True, False] and one(bits.next_power_of_2(x))[:4] == [1, 1, 8, 1 << 40]
    assert one(bits.select_bit(x, 2)) == [None, None, 2, None, 1]
    words = spark.createDataFrame([([5, 1],)], "w array<long>")
    assert words.select(bits.bitmap_ids(F.col("w"))).first()[0] == [0, 2, 64]
    assert words.select(bits.prefix_popcount(F.col("w"))).first()[0] == [0, 2, 3]
    b = spark.createDataFrame([(bytearray([3, 255]), bytearray([1, 0]))], "a binary, b binary")
    assert b.select(bits.popcount_bytes(F.col("a")), bits.hamming_bytes(F.col("a"), F.col("b"))).first()[:] == (10, 9)
    z = spark.createDataFrame([(5, 9)], "x long, y long").select(bits.interleave(F.col("x"), F.col("y")).alias("z")).select("z", bits.deinterleave(F.col("z")).alias("p")).first()
    assert z["z"] == 0b10010011 and tuple(z["p"]) == (5, 9)
    f = spark.createDataFrame([([True, False, True],)], "f array<boolean>")
    assert f.select(bits.unpack_bits(bits.pack_bits(F.col("f")), 3)).first()[0] == [True, False, True]


def test_int4_round_trip(spark):
    codes = [-7, 3, 0, 7, -8]
    df = spark.createDataFrame([(codes,)], "c array<int>")
    assert df.select(quantize.unpack_int4(quantize.pack_int4(F.col("c")), 5)).first()[0] == codes


def test_scalar_quantizer(spark):
    p = quantize.calibrate({"lowest": -1.0, "highest": 9.0, "mean": 2.0, "std": 1.0})
    assert quantize.calibrate({"lowest": -3.0, "highest": 2.0}, symmetric=True).low == -3.0
    assert quantize.calibrate({"lowest": -3.0, "highest": 2.0, "mean": 0.0, "std": 0.5}, sigmas=3).low == -1.5
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 42.0],)], "v array<double>")
    back = df.select(quantize.dequantize(quantize.quantize(F.col("v"), p), p)).first()[0]
    assert np.allclose(back, [1, 2, 3, 9], atol=p.scale / 2)
    with pytest.raises(InvalidArgument):
        quantize.calibrate({}, bits=9)


def test_float_formats():
    x = np.array([0, 1, -1, 0.5, 2, 100, -0.1, 1.96875, 1e9])
    for kind, tolerance in (("e4m3", 0.0625), ("e5m2", 0.125)):
        values = quantize.fp8_values(kind)[quantize.fp8_codes(x, kind)]
        assert np.all(np.abs(values[:8] - x[:8]) <= tolerance * np.abs(x[:8]))
        assert values[8] == quantize.FP8[kind][4]
        codes = np.arange(0, quantize.FP8[kind][3] + 1)
        codes = codes[(codes == 0) | (codes >> quantize.FP8[kind][1] > 0)]
        assert (quantize.fp8_codes(quantize.fp8_values(kind)[codes], kind) == codes).all()
    b = quantize.bf16_values(quantize.bf16_codes(np.array([1.0, 3.14159, -2.5e-8])))
    assert np.allclose(b, [1.0, 3.14159, -2.5e-8], rtol=2**-8)
