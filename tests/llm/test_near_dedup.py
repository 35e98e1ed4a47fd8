import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillan.llm import near_dedup

SCHEMA = "doc_id long, text string, component_id string, label int"


def brute(rows, percent=85):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return {i: (len(s), find(i)) for i, s in sets}


def cases(seed):
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randrange(3000))
    rows, n = [], 0
    for group in range(25):
        base = [word() for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = word()
            rows.append((n, (" " if rnd.random() < 0.5 else "\n").join(t)))
            n += 1
    hot = [word() for _ in range(120)]
    for _ in range(150):
        t = list(hot)
        t[rnd.randrange(120)] = word()
        rows.append((n, " ".join(t).upper() if n % 2 else " ".join(t)))
        n += 1
    stock = [word() for _ in range(80)]
    for k in range(80):
        own = [word() for _ in range(40)]
        rows.append((n, " ".join(stock + own)))
        n += 1
        if k % 20 == 0:
            own[-1] = "changed"
            rows.append((n, " ".join(stock + own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, hot[0] + " " + hot[1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = cases(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(df).collect()}
    assert got == brute(rows)


def test_pairs_in_a_family_just_below_the_limit(spark, monkeypatch):
    """Members resemble each other at 0.849, single pairs at 0.8503; the blocks of a region are compared with each other too."""
    rnd = random.Random(5)
    word = lambda: "w" + str(rnd.randrange(10**9))
    stock, rows = [word() for _ in range(1003)], []
    for pair in range(100):
        both = [word()]
        rows += [(pair + 100 * k, " ".join(stock + both + [word() for _ in range(88)])) for k in range(2)]
    want = {i: (1088, i % 100) for i, _ in rows}
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(4)
    for block in (near_dedup.BLOCK, 40):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(df).collect()} == want


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, "x y z"), (3, "a b c d e f g"), (4, "x y z")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    got = near_dedup.classes(df)
    assert sorted(((r["doc_id"] or 0), r["component_id"]) for r in got.collect() if r["doc_id"]) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1)]
    assert got.where("doc_id is null and component_id is null").count() == 1


def test_components_of_a_long_path(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(299)], "u long, v long")
    got = near_dedup.components(edges)
    assert got.count() == 299 and got.agg(F.max("label")).first()[0] == 0


def test_empty(spark):
    assert near_dedup.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_inside_a_crowded_template(spark, monkeypatch):
    """Rows of one template with 4 changed words, hardly any of them linked, and 40 rows with 2, linked with each other."""
    rnd = random.Random(8)
    base = ["t" + str(k) for k in range(300)]
    rows = []
    for i in range(1200):
        t = list(base)
        for k in rnd.sample(range(300), 2 if i % 30 == 0 else 4):
            t[k] = "x" + str(rnd.randrange(10**9))
        rows.append((i, " ".join(t)))
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(4)
    for block in (near_dedup.BLOCK, 100):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(df).collect()} == want


@pytest.mark.parametrize("cell_bytes", [near_dedup.CELL_BYTES, 0])
def test_links_by_bits(monkeypatch, cell_bytes):
    monkeypatch.setattr(near_dedup, "CELL_BYTES", cell_bytes)
    rnd = random.Random(4)
    stock = [rnd.randrange(2**64) for _ in range(150)]
    sets = [frozenset(rnd.sample(stock, rnd.randrange(100, 150)) + [rnd.randrange(2**64) for _ in range(rnd.randrange(4))]) for _ in range(60)] + [frozenset([1])]
    packed = pa.array([np.array(sorted(x), "<u8").tobytes() for x in sets], pa.binary())
    p, q = np.triu_indices(61, 1)
    want = [100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in zip(p, q)]
    assert near_dedup._Linked(packed, 80)(p, q).tolist() == want and 0 < sum(want) < len(want)
