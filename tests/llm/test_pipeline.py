import random
import re

import corpus_pipeline
from quillan.llm import pii
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_decontaminate import plain_score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(9)
    stems = {"en": "the of and ing tion er with".split(), "de": "der und die ung schaft ein nicht".split()}
    word = lambda l: "".join(rnd.choice(stems[l]) for _ in range(3)) + rnd.choice("abcdefgh")
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append([i, [word(lang) for _ in range(rnd.randrange(30, 120))], lang])
    bench = [[word("en") for _ in range(20)] for _ in range(5)]
    for i in range(0, 120, 17):
        rows[i][1][10:10] = bench[i % 5]
    for i in range(0, 120, 11):
        rows[i][1].append("a.b@mail.org")
    for k in range(20):
        copy = list(rows[k * 5][1])
        copy[3] = word("en")
        rows.append([200 + k, copy, rows[k * 5][2]])
    docs = [(i, " ".join(w), l, "s", 0) for i, w, l in rows]
    return docs + [(900, "1234 5678 !!", "en", "s", 0), (901, None, None, None, None), (902, "", "en", "s", 0)], [" ".join(b) for b in bench]


def brute(docs, bench):
    kept = {i: t for i, t, *_ in docs if t and re.search("[a-z]", t)}
    classes = near([(i, t) for i, t in kept.items()], corpus_pipeline.stages.NEAR_PERCENT)
    kept = {i: t for i, t in kept.items() if classes[i][1] == i}
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    kept = {i: t for i, t in kept.items() if all(plain_score(words(b), words(t)) < len(words(b)) for b in bench)}
    masked = {i: pii.mask(t, pii.base_spans(t)) for i, t in kept.items()}
    return {i: -(-len(t.encode()) // 4) for i, t in masked.items()}


def test_run_matches_brute_force(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == brute(docs, bench)


def test_stages_keep_columns(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(*r, "more") for r in docs], SCHEMA + ", score string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
    assert df.count() > 50
