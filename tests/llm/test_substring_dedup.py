import random

import pytest

from quillan.llm import substring_dedup

SCHEMA = "doc_id long, text string, anchors string, d int"


def brute(rows, window):
    key = lambda r: (r[0] is None, r[0] or 0)
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=key):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            g = tuple(words[s : s + window])
            if g in seen:
                gone[s : s + window] = [True] * window
            seen.add(g)
        out[i] = (len(words), sum(gone), b" ".join(w for w, x in zip(words, gone) if not x).decode())
    return out


def cases(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("the of and cat dog über Ça x1 y2 z3".split()) + str(rnd.randrange(9))
    shared = [[word() for _ in range(rnd.randrange(15, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += [word() for _ in range(rnd.randrange(30))]
            p = list(rnd.choice(shared))
            if rnd.random() < 0.5:
                p = p[rnd.randrange(8) :]
            if rnd.random() < 0.3:
                p[len(p) // 2] = word()
            parts += p
        rows.append((i * 3 % 61, rnd.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(100 + i, rows[5][1]) for i in range(40)] + [(200, "a " * 300), (201, "b a " * 200), (202, None), (203, ""), (204, "a " * 20), (-5, " ".join(shared[0]))]
    return [(i, t, "x", 1) for i, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = cases(seed)
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute(rows, 20)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


@pytest.mark.parametrize("seed", [1, 5])
def test_sources_of_repeats(spark, seed):
    """Words at the source coordinates are the same, lie earlier, and the repeats cover what is removed."""
    rows = cases(seed)
    words = {i: (t or "").split() for i, t, *_ in rows}
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    for r in got:
        gone = set()
        for x in r["repeats"]:
            assert (x["source"], x["source_start"]) < (r["doc_id"], x["start"])
            own, n = words[r["doc_id"]][x["start"] : x["end"]], x["end"] - x["start"]
            assert n >= 20 and own == words[x["source"]][x["source_start"] : x["source_start"] + n]
            gone |= set(range(x["start"], x["end"]))
        assert gone == {k for s in r["spans"] for k in range(s["start"], s["end"])}


def test_a_long_repeat_is_one_run(spark):
    """Only a path at an end of the run may have another source with the same words."""
    rnd = random.Random(9)
    word = lambda: "w" + str(rnd.randrange(10**6))
    passage = [word() for _ in range(5000)]
    texts = [[word() for _ in range(30)] + passage + [word() for _ in range(200_000)], passage[:2000], [word() for _ in range(7)] + passage + passage[100:400] + ["end"]]
    rows = [(i + 1, " ".join(t), "x", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert [tuple(x) for x in got[2]["repeats"]] == [(0, 2000, 1, 30)]
    runs = [tuple(x) for x in got[3]["repeats"]]
    (long,) = [x for x in runs if x[1] - x[0] > 4900]
    assert len(runs) <= 6 and long[2] == 1 and long[3] - 30 == long[0] - 7 and (runs[0][0], max(x[1] for x in runs)) == (7, 5307)
    assert got[1]["n_removed"] == 0 and got[1]["n_words"] == 205_030 and got[3]["n_removed"] == 5300


def test_other_window(spark):
    rows = cases(3)
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), window=8, anchor=3).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute(rows, 8)


def test_repeated_and_null_ids(spark):
    rows = [r for r in cases(4)[:20]]
    extra = [(rows[3][0], rows[3][1], "x", 1), (None, rows[4][1], "x", 1)]
    got = substring_dedup.dedup(spark.createDataFrame(rows + extra, SCHEMA).repartition(3)).collect()
    want = brute(rows + [extra[1]], 20)
    assert len(got) == 22
    assert all((r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]] for r in got)


def test_empty(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
