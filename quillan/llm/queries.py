"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, language_id, near_dedup, packing, pii, sharding, substring_dedup, topk, url_filter
from .common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), everywhere=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat_format.read_back(chat_format.format_windows(turns.unionByName(probe)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_by_bytes(docs, dims=["n_chars", "lang", "source"]).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.train(docs.where(~held_out()))
    return language_id.identify(docs, profiles, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_pii": op2_pii, "op3_decontamination": op3_decontamination, "op4_chat_format": op4_chat_format, "op5_url_filter": op5_url_filter, "op6_sharding": op6_sharding, "op7_language_id": op7_language_id, "op8_packing": op8_packing, "op9_near_dedup": op9_near_dedup, "op10_topk": op10_topk}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS g
  FROM docs, unnest(range(1, len(ws) - 18)) AS t(s)
), later AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, s + i AS p FROM later, range(20) AS r(i)
), words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs
), kept AS (
  SELECT words.doc_id, words.w, words.p, gone.p IS NOT NULL AS removed
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed,
    coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT removed), '') AS k
  FROM kept GROUP BY doc_id
)
SELECT docs.doc_id, len(ws)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN sums ON sums.doc_id = docs.doc_id
""",
    "op4_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), o AS (
  SELECT *, ceil(strlen(x) / 4)::bigint + 4 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS ord,
    12 + length(replace(replace(replace(r, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + 1
      + length(replace(replace(x, '&', '&amp;'), '<|', '&lt;|')) + 11 AS chars
  FROM t
), s AS (
  SELECT conv_id AS sc, min(ord) AS s_ord, arg_min(tok, ord) AS s_tok, arg_min(chars, ord) AS s_chars FROM o WHERE r = 'system' GROUP BY conv_id
), p AS (
  SELECT o.*, s_ord, s_chars, greatest(1, 1024 - coalesce(s_tok, 0)) AS room,
    coalesce(sum(tok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, coalesce(lag(tok) OVER w, 0) AS prev
  FROM o LEFT JOIN s ON sc IS NOT DISTINCT FROM o.conv_id
  WINDOW w AS (PARTITION BY o.conv_id ORDER BY ord)
), c AS (
  SELECT *, least(512, room // 2) AS allowed, CASE WHEN prev + tok <= room THEN lo - prev ELSE lo END AS back FROM p
), w AS (
  SELECT *, (lo + tok - 1) // (room - allowed) AS span, back < (lo + tok - 1) // (room - allowed) * (room - allowed) - allowed AS lone FROM c
), b AS (
  SELECT conv_id, span, CASE WHEN lone THEN ord END AS part, min(ord) AS first, any_value(s_ord) AS s_ord, any_value(s_chars) AS s_chars,
    greatest(max(lo + tok - room), least(min(lo - allowed), min(back))) AS floor_at, sum(chars) AS own, coalesce(bool_or(ord = s_ord), false) AS has_sys
  FROM w GROUP BY ALL
), ctx AS (
  SELECT b.conv_id, b.first, sum(t.chars) AS chars, min(t.ord) AS least_ord
  FROM b JOIN w AS t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.ord < b.first AND t.lo >= floor_at AND t.ord IS DISTINCT FROM t.s_ord GROUP BY ALL
), windows AS (
  SELECT b.conv_id, own + coalesce(ctx.chars, 0) + CASE WHEN s_ord < coalesce(least_ord, b.first) AND NOT has_sys THEN s_chars ELSE 0 END AS chars
  FROM b LEFT JOIN ctx ON ctx.conv_id IS NOT DISTINCT FROM b.conv_id AND ctx.first = b.first
), f AS (
  SELECT conv_id, sum(chars)::bigint AS formatted_chars FROM windows GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY ord)) AS turns_sha256,
    coalesce(string_agg(x, '' ORDER BY ord) FILTER (WHERE r = 'assistant'), '') AS loss
  FROM o GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
""",
    "op5_url_filter": f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages
), u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), rules(h, p, v) AS (VALUES {_RULES_SQL}),
hits AS (
  SELECT host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY host, path ORDER BY length(h) + length(p) DESC, length(h) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN hits ON hits.n = 1 AND hits.host = u.host AND hits.path = u.path
""",
    "op9_near_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s + 4], ' ')) AS g
  FROM docs, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(s) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh AS a JOIN sh AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.doc_id, v FROM reach JOIN links ON u = to_id
), comp AS (
  SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id
)
SELECT comp.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, comp.doc_id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id
""",
    "op10_topk": """
WITH c AS (
  SELECT vec_id, list_transform(embedding::double[], lambda x: floor(1024 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::double[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::int AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
""",
}
