"""Queries over number formats and stored codes; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillan.catalog import _CODES, DIST, EVERY, K, E, Q, _int8, asked, embeddings, found, knn_sql, over, query, six, table
from quillan.functions import bits, quantize
from quillan.operators import codes, knn

#: Value x in SQL as the formats round it: an exponent, then a mantissa of so many bits.
_EXP = "CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) END"
BF16 = f"(round_even(x / pow(2, {_EXP} - 7), 0) * pow(2, {_EXP} - 7))"
F16 = f"(round_even(x / pow(2, greatest({_EXP}, -14) - 10), 0) * pow(2, greatest({_EXP}, -14) - 10))"


def _fp8(bits_: int, bias: int, most: str) -> str:
    man = f"(1 + floor((abs(x) / pow(2, {_EXP}) - 1) * {2**bits_} + 0.5) / {2.0**bits_})"
    return f"CASE WHEN x = 0 OR {_EXP} + CASE WHEN {man} = 2 THEN 1 ELSE 0 END + {bias} < 1 THEN 0.0 ELSE sign(x) * least({most}, {man} * pow(2, {_EXP})) END"


E4M3, E5M2 = _fp8(3, 7, "448.0"), _fp8(2, 15, "65536.0")


def _as(expr: str) -> str:
    """The table e with each element put through a format; elements are single floats first."""
    return f"e AS (SELECT vec_id AS id, list_transform(embedding::double[], lambda x: {expr}) AS v, label FROM embeddings), q AS (SELECT vec_id AS qid, embedding::double[] AS w FROM embeddings WHERE vec_id % {EVERY} = 0)"


def _nine(v):
    return F.transform(v, lambda x: F.round(x, 9) + 0.0)


def _list(expr: str) -> str:
    return f"list_transform(v, lambda x: round({expr}, 9) + 0.0)"


@query(f"WITH {E} SELECT id, {_list(BF16)} AS bf16, {_list(F16)} AS f16 FROM e")
def half_floats(spark, sf_dir):
    """Elements after a round trip through the two 16-bit formats."""
    v = F.col("vec")
    return embeddings(spark, sf_dir).select("id", _nine(quantize.from_bf16(quantize.to_bf16(v))).alias("bf16"), _nine(quantize.through_f16(v)).alias("f16"))


@query(f"WITH {E}, m AS (SELECT 448 / max(list_max(list_transform(v, lambda x: abs(x)))) AS s FROM e) SELECT id, list_transform(list_transform(v, lambda x: x * s), lambda x: round({E4M3} / s, 9) + 0.0) AS e4m3, {_list(E5M2)} AS e5m2 FROM e, m")
def eight_bit_floats(spark, sf_dir):
    """Elements after a round trip through the two 8-bit formats, the first with a calibrated scale."""
    rows, v = embeddings(spark, sf_dir), F.col("vec")
    scale = quantize.fp8_scale(rows.select(F.max(F.array_max(F.transform(v, lambda x: F.abs(x))))).first()[0])
    a, b = quantize.from_fp8(quantize.to_fp8("e4m3", scale)(v), "e4m3", scale), quantize.from_fp8(quantize.to_fp8("e5m2")(v), "e5m2")
    return rows.select("id", _nine(a).alias("e4m3"), _nine(b).alias("e5m2"))


def _coded(rows, column):
    return rows.select("id", column.alias("codes"))


def _over_codes(name: str, expr: str, code, payload, measure: str):
    def run(spark, sf_dir):
        rows = embeddings(spark, sf_dir)
        return found(codes.nearest(_coded(rows, code(F.col("vec"))), asked(rows), payload, K, measure))

    run.__name__ = f"{name}_{measure}"
    sql = knn_sql(DIST[measure], source=_as(expr)).replace(f", {Q}", "", 1)
    query(sql)(run)


for _measure in ("squared_l2", "dot"):
    _over_codes("bf16_knn", BF16, quantize.to_bf16, codes.Bf16Codes(), _measure)
    _over_codes("fp8_knn", E4M3, quantize.to_fp8("e4m3"), codes.Fp8Codes("e4m3"), _measure)

_DECODED = f"{_CODES}, k AS (SELECT id, list_transform(codes, lambda x: x * sc + lo) AS v FROM c), {Q}"


def _scalar(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    p = _int8(rows)
    return rows, _coded(rows, quantize.quantize(F.col("vec"), p)), codes.ScalarCodes(p)


def _scalar_knn(measure: str):
    def run(spark, sf_dir):
        rows, coded, payload = _scalar(spark, sf_dir)
        return found(codes.nearest(coded, asked(rows), payload, K, measure))

    run.__name__ = f"int8_codes_knn_{measure}"
    query(f"""WITH {E}, {_DECODED}, s AS (SELECT qid, id, {DIST[measure]} AS d FROM q, k), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s)
SELECT qid, id, round(d, 6) + 0.0 AS dist, rank::int AS rank FROM r WHERE rank <= {K}""")(run)


for _measure in ("squared_l2", "dot", "cosine"):
    _scalar_knn(_measure)


@query(f"WITH {E}, {_DECODED} SELECT qid, id, round({DIST['squared_l2']}, 6) + 0.0 AS dist FROM q, k WHERE {DIST['squared_l2']} <= 1.2")
def int8_radius(spark, sf_dir):
    """All coded rows within a distance."""
    rows, coded, payload = _scalar(spark, sf_dir)
    return codes.within(coded, asked(rows), payload, 1.2).select("qid", "id", six("dist").alias("dist"))


@query(f"WITH {E} SELECT count(*) AS n, count(*) * (64 + 4) AS bytes, count(*) * 64 * 4 AS float_bytes, 4.0::double AS ratio FROM e")
def int8_memory(spark, sf_dir):
    """Size of the codes with their lengths, and the ratio to single floats."""
    _, coded, payload = _scalar(spark, sf_dir)
    return codes.memory(coded, payload)


def _bits(x: str) -> str:
    return f"list_filter(range(0, 62), lambda i: (({x} >> i::int) & 1) = 1)"


@query(f"""WITH x AS (SELECT event_id AS id, event_id AS x, user_id AS y FROM events), b AS (SELECT *, {_bits('x')} AS bx, {_bits('y')} AS b_y FROM x)
SELECT id, list_transform(bx, lambda i: i::int) AS positions, coalesce(bx[2], -1)::int AS second, bit_count(x)::int AS byte_ones, bit_count(xor(x, y))::int AS byte_hamming,
[0, bit_count(x)::int, (bit_count(x) + bit_count(y))::int] AS prefix, list_concat(bx, list_transform(b_y, lambda i: i + 64)) AS ids,
(coalesce(list_sum(list_transform(bx, lambda i: pow(4, i))), 0) + 2 * coalesce(list_sum(list_transform(b_y, lambda i: pow(4, i))), 0))::bigint AS morton FROM b""")
def bit_sets(spark, sf_dir):
    """Bits of numbers, of their bytes and of bitmaps; Morton codes."""
    x, y = F.col("event_id"), F.col("user_id")
    as_bytes = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    words = F.array(x.cast("long"), y.cast("long"))
    return table(spark, sf_dir, "events").select(
        x.alias("id"), bits.bit_list(x).alias("positions"), F.coalesce(bits.select_bit(x, 2), F.lit(-1)).alias("second"), bits.popcount_bytes(as_bytes(x)).alias("byte_ones"), bits.hamming_bytes(as_bytes(x), as_bytes(y)).alias("byte_hamming"),
        bits.prefix_popcount(words).alias("prefix"), F.transform(bits.bitmap_ids(words), lambda i: i.cast("long")).alias("ids"), bits.interleave(x, y).alias("morton"),
    )


@query(f"WITH {E}, {Q} SELECT qid, id, round({over('({a} - {b}) * ({a} - {b})')}, 6) + 0.0 AS dist FROM q, e WHERE id % 7 = 0 AND {over('({a} - {b}) * ({a} - {b})')} <= 1.5")
def radius_where(spark, sf_dir):
    """A radius with a predicate on the scanned table."""
    rows = embeddings(spark, sf_dir)
    return knn.within(rows, asked(rows), 1.5, where=F.col("id") % 7 == 0).select("qid", "id", six("dist").alias("dist"))
