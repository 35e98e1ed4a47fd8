from pyspark.sql import functions as F

from quillan.llm import language_id

SCHEMA = "doc_id long, text string, lang string, score string"
EN = "the cat sat on the mat and the dog was there with them in the house "
DE = "der hund und die katze sind nicht in dem haus und das ist auch gut so "


def test_rank_distance_matches_a_plain_version():
    import numpy as np

    text = "Abab, cab!"
    row, gram, n = language_id.gram_counts(np.frombuffer(text.encode("utf-32-le"), "<u4"), np.zeros(len(text), np.uint32))
    stream = "abab cab "
    want = {}
    for k in (1, 2, 3):
        for i in range(len(stream) - k + 1):
            g = stream[i : i + k]
            if g != " ":
                want[g] = want.get(g, 0) + 1
    assert sorted(n) == sorted(want.values())


def test_learns_and_handles_odd_rows(spark):
    rows = [(i, EN * (1 + i % 3), "en", "x") for i in range(20)] + [(20 + i, DE * (1 + i % 3), "de", None) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    profiles = language_id.train(docs)
    odd = [(100, None, "en", None), (101, "", None, None), (102, "12 34 !!", None, None), (103, EN * 3000, None, None), (104, "und das haus", None, None), (None, "the house", "en", None), (104, "und das haus", None, None)]
    got = language_id.identify(spark.createDataFrame(odd, SCHEMA).repartition(2), profiles)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    pred = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert pred == {100: "und", 101: "und", 102: "und", 103: "en", 104: "de", None: "en"}
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == 7
    assert got.where((F.col("lang_pred") == "und") & (F.col("score") != 0)).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert language_id.train(docs) == {} and language_id.train(docs.limit(0)) == {}
    assert [r["lang_pred"] for r in language_id.identify(docs, {}).collect()] == ["und"]
    assert language_id.identify(docs.limit(0), {}).count() == 0


def test_held_out_accuracy(spark):
    from quillan.llm.queries import op7_language_id

    got = op7_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, n = got.join(docs, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert n > 200 and right / n > 0.98


def test_a_column_named_like_the_helper(spark):
    df = spark.createDataFrame([(1, "eins zwei drei", "x")], "doc_id long, text string, __text string")
    assert language_id.identify(df, {}).first().asDict() == {"doc_id": 1, "text": "eins zwei drei", "__text": "x", "lang_pred": "und", "score": 0.0}
