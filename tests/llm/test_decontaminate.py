import random
import re

import numpy as np
import pyarrow as pa

from quillan.llm import decontaminate

DOCS = "doc_id long, text string, item_id long"
ITEMS = "item_id long, text string, score int"


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_a_plain_version():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 9, 40)
    passages = rng.integers(1, 5, (40, 12)).astype(np.uint64)
    items = rng.integers(1, 5, (40, 8)).astype(np.uint64)
    got, end = decontaminate.align(passages, items, lengths)
    assert [int(x) for x in got] == [plain_score(list(a[:n]), list(b)) for a, n, b in zip(items, lengths, passages)]
    assert ((0 <= end) & (end <= 12)).all()


def case():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(24)] for _ in range(12)]
    docs = []
    for i in range(300):
        text = [word() for _ in range(120)]
        leak = None
        if i % 5 == 0:
            leak = i // 5 % 12
            copy = [w for w in items[leak]]
            for _ in range(i % 4):
                copy[rnd.randrange(24)] = word()
            if i % 3 == 0:
                del copy[rnd.randrange(24)]
            copy = [w.upper() + "," if i % 2 else w for w in copy]
            at = rnd.randrange(120)
            text[at:at] = copy
        docs.append((i, " ".join(text), leak))
    return docs, items


def test_finds_edited_copies_and_leaves_clean_documents(spark):
    rows, items = case()
    bench = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(items)] + [(50, None, 0), (51, "", 0), (52, "zz yy", 0)], ITEMS)
    extra = [(900, None, None), (901, "", None), (902, "zz yy", None), (None, rows[0][1], None), (0, rows[0][1], None)]
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows] + extra, DOCS).repartition(3)
    got = decontaminate.matches(docs, bench)
    want = sorted([(i, k) for i, _, k in rows if k is not None] + [(902, 52), (-1, rows[0][2]), (0, rows[0][2])])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got.collect()) == want
    blocks = decontaminate.matches(docs, bench, block_bytes=300)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({(d, k) for d, k in want}) - 1


def test_hot_leak_keeps_its_seeds(spark):
    rows, items = case()
    many = [(1000 + i, f"start{i} " + " ".join(items[3]) + f" end{i}", None) for i in range(400)]
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + many, DOCS)
    bench = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(items)], ITEMS)
    got = {r["doc_id"] for r in decontaminate.matches(docs, bench).where("item_id = 3").collect()}
    assert got >= {i for i, _, _ in many}


def test_edited_copy_in_several_hundred_documents(spark):
    """The copy keeps under half of the item's seeds, each in 400 documents."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    item, other = ([word() for _ in range(38)] for _ in range(2))
    copies = [[word() if k % 6 == 5 else w for k, w in enumerate(item)], other[:20]]
    rows = [(i, f"start{i} " + " ".join(copies[i % 2]) + f" end{i}", None) for i in range(800)] + [(900 + i, " ".join(item[:9]) + f" stock{i}", None) for i in range(400)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(0, " ".join(item), 0), (1, " ".join(other), 0)], ITEMS)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()) == [(i, i % 2) for i in range(800)]
    assert decontaminate.clean(docs, bench).count() == 400


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e", 1)], DOCS), spark.createDataFrame([(1, "a b c d e", 1)], ITEMS)
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 1
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.clean(docs, bench).count() == 0


def plain_matches(docs, items, threshold=0.5, seed=4):
    """(doc_id, item_id, score) by aligning every document that shares a seed with the item, as a whole."""
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, text in docs:
        w = words(text)
        for i, other in items:
            v = words(other)
            n = min(seed, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if v and any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                score = plain_score(v, w) / (2 * len(v))
                if score >= threshold:
                    out.append((d, i, round(score, 9)))
    return sorted(out, key=str)


def test_matches_equal_aligning_everything(spark, monkeypatch):
    """Nulls, repeated rows and ids, items without words or shorter than a seed, copies with edits around the threshold."""
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice(["a", "b", "é"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([2, 4, 15, 40])))) for k in range(10)] + [(20, None), (21, "..."), (3, "one two three four five"), (None, "six seven eight nine ten")]
    docs = [(0, None), (1, ""), (None, "SIX, seven eight nine ten"), (2, "zz " * 30), (3, items[0][1] + "!")]
    for k in range(90):
        copy = rnd.choice(items[:10])[1].split()
        for _ in range(rnd.randrange(len(copy))):
            copy[rnd.randrange(len(copy))] = word()
        docs.append((10 + k // 2, " ".join([word() for _ in range(20)] + copy + [word() for _ in range(20)])))
    docs += docs[-3:]
    want = plain_matches(docs, items)
    a, b = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    shares = lambda got: sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in got.collect()), key=str)
    assert len(want) > 30 and shares(decontaminate.matches(a, b)) == want
    index = decontaminate.Index(pa.array([i for i, _ in items[:13]]), pa.array([t for _, t in items[:13]]), 4)
    first = [decontaminate.find(w, index, index.sets(), 0.5) for _, _, w in decontaminate.slices(pa.array([t for _, t in docs]), lower=True, punct=True)]
    monkeypatch.setattr(decontaminate, "CELLS", 100)
    monkeypatch.setattr(decontaminate, "HITS", 3)
    small = [decontaminate.find(w, index, index.sets(), 0.5) for _, _, w in decontaminate.slices(pa.array([t for _, t in docs]), lower=True, punct=True)]
    assert all(np.array_equal(x, y) for one, two in zip(first, small) for x, y in zip(one[:3], two[:3]))


def test_very_long_text_and_item(spark):
    rnd = random.Random(12)
    word = lambda: "w" + str(rnd.randrange(50000))
    item = [word() for _ in range(1500)]
    text = [word() for _ in range(60000)] + item[:900] + [word() for _ in range(100000)]
    docs, bench = spark.createDataFrame([(1, " ".join(text), 0)], DOCS), spark.createDataFrame([(5, " ".join(item), 0)], ITEMS)
    (got,) = decontaminate.matches(docs, bench).collect()
    assert got["item_id"] == 5 and 0.6 <= got["score"] < 0.61 and got["word_end"] == 60900
