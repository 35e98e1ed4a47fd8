import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillan.llm import pii

SCHEMA = "doc_id long, text string, spans string"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if k == 1:
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif k == 2:
                double = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
                ok = 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0
            elif k == 3:
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "@", ".", "x", "_", "-", " ", "é", "+1 (234) 555-0000", "1.2.3.4", "256", "4111 1111 1111 1111", "5", "+", "(", "\n", "a@b", "4432507379035540"]), max_size=14).map("".join))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def docs(spark):
    rows = [(i, f"note {i} mail jo@x.org about Zeppelin{'' if i % 2 else ','} plan{i} the end", None) for i in range(8)]
    rows += [(20 + i, "copy ann@y.org with Heliotrope in it", None) for i in range(30)]
    rows += [(60 + i, f"the plain note of number{i} about mail is at an end", None) for i in range(900)]
    rows += [(1000, None, None), (1001, "", None), (None, "call +1 (234) 555-0000 zeppelin", None), (0, rows[0][1], None), (1003, "Zeppelin alone", None), (1004, "é " * 50000 + "q@w.de 1.2.3.4", None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_rows_and_disclosing_terms(spark):
    rows, df = docs(spark)
    got = pii.find(df).collect()
    want = sorted((i is not None, i or 0, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute(t)).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["base_sha256"]) for r in got) == want
    terms = {r["doc_id"]: r["spans"] for r in got if r["n_term"]}
    assert set(terms) == set(range(8))
    for i in range(8):
        at = rows[i][1].index("Zeppelin")
        assert f"term:{at}:{at + 8}" in terms[i]
    assert sorted(map(str, pii.find(df, broadcast_rows=0).collect())) == sorted(map(str, got))


def test_disclosing_term_in_a_document_with_many_copies(spark):
    rows = [(i, f"note {i} mail jo@x.org about Zeppelin plan{i} the end", None) for i in range(10)]
    rows += [(100 + i, rows[0][1], None) for i in range(1000)] + [(2000 + i, f"the plain note of number{i} is at an end", None) for i in range(900)]
    got = pii.find(spark.createDataFrame(rows, SCHEMA).repartition(4)).where("doc_id < 2000")
    at = rows[0][1].index("Zeppelin")
    assert got.where(f"spans like '%term:{at}:{at + 8}%'").count() == 1010


def test_disclosing_terms_in_every_text(spark, tmp_path):
    from quillan.llm import queries, stages

    rows, df = docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_pii(spark, str(tmp_path))
    named = {r["doc_id"]: r["spans"] for r in got.collect() if "term:" in r["spans"]}
    assert named[1003] == "term:0:8" and set(named) == {*range(8), None, 1003}
    assert sorted(map(str, pii.find(df, everywhere=True, broadcast_rows=0).collect())) == sorted(map(str, got.collect()))
    texts = {r["doc_id"]: r["text"] for r in stages.personal_data(spark, df, str(tmp_path)).collect()}
    assert texts[1003] == "[TERM] alone" and texts[None] == "call [PHONE] [TERM]"


def test_redact_keeps_columns_and_removes_values(spark):
    _, df = docs(spark)
    for limit in (1 << 20, 0):
        out = pii.redact(df, broadcast_rows=limit)
        assert out.columns == df.columns and out.count() == df.count()
        texts = {r["doc_id"]: r["text"] for r in out.collect()}
        assert texts[1] == "note 1 mail [EMAIL] about [TERM] plan1 the end"
        assert texts[1003] == "Zeppelin alone" and texts[1000] is None
        assert texts[1004].endswith("é [EMAIL] [IP]")


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0


def brute_terms(texts, reach=8, support=5, share=0.5, bits=6.0):
    """Disclosing terms of distinct texts, from lists and sets."""

    def words(text):
        spans = brute(text)
        out = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        return spans, out, [w for w in out if len(w[0]) >= 3 and not any(w[1] < e and w[2] > s for _, s, e in spans)]

    texts = set(texts)
    contexts, near, named, held = {}, {}, {}, {}
    for text in texts - {None}:
        spans, every, free = words(text)
        for t in {w[0] for w in every}:
            held.setdefault(t, set()).add(text)
        for k, s, e in spans:
            name = (k, re.sub("[^0-9]", "", text[s:e]) if k >= 2 else text[s:e].lower())
            named.setdefault(name, set()).add(text)
            around = frozenset([w[0] for w in free if w[2] <= s][-reach:] + [w[0] for w in free if w[1] >= e][:reach])
            for t in around:
                contexts.setdefault((name, t), set()).add(around)
                near.setdefault((name, t), set()).add(text)
    out = set()
    for (name, t), own in contexts.items():
        n, df = len(near[name, t]), len(held[t])
        if len(own) >= support and n >= share * df and math.log2(n * len(texts) / (len(named[name]) * df)) >= bits:
            out.add(t)
    return out, words


def test_term_spans_equal_a_plain_count(spark):
    rnd = random.Random(2)
    people = [("ann@y.org", "Heliotrope"), ("+1 (234) 555-0000", "zeppelin é"), ("10.0.0.9", "Quartz-box"), ("bo@z.net", "the")]
    rows = []
    for i in range(4500):
        text = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 30, 60]))] + ["the"] * (i % 2)
        if i % 45 == 0:
            for who, term in rnd.sample(people, rnd.choice([1, 1, 2])):
                text.insert(rnd.randrange(len(text)), rnd.choice([f"{term} {who}", f"{who} w1 {term},", who.upper() if "@" in who else who, f"{term} {who} {who}"]))
        if i % 300 == 7:
            text.append(rnd.choice(people)[1])
        rows.append((i, " ".join(text), None))
    rows += [(5000 + i, rows[0][1], None) for i in range(500)] + [(6000, None, None), (6001, "", None), (6002, "Zeppelin" * 3, None)]
    terms, words = brute_terms([t for _, t, _ in rows])
    assert {"heliotrope", "zeppelin", "quartz", "box"} <= terms and "the" not in terms | {"w1"}
    want = {}
    for i, t, _ in rows:
        spans, _, free = words(t or "")
        want[i] = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans + [(4, s, e) for w, s, e in free if w in terms])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for limit in (1 << 20, 0):
        assert {r["doc_id"]: r["spans"] for r in pii.find(df, everywhere=True, broadcast_rows=limit).collect()} == want


def test_many_mentions_in_one_text(spark):
    text = " ".join(f"a{i} u{i % 9}@x.org" for i in range(40000))
    (got,) = pii.find(spark.createDataFrame([(1, text, None)], SCHEMA)).collect()
    assert got["n_email"] == 40000


def test_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(i, f"mail jo@x.org of Zeppelin plan{i}", i, i, i) for i in range(8)], "__k int, text string, __terms int, __pairs int, t int")
    for limit in (1 << 20, 0):
        for everywhere in (True, False):
            out = pii.redact(df, everywhere=everywhere, broadcast_rows=limit, bits=0.0)
            assert out.columns == df.columns and [tuple(r)[::2] for r in out.orderBy("t").collect()] == [(i, i, i) for i in range(8)]
