import math
import tracemalloc

import numpy as np
import pytest

from quillan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, queries, k):
    ok = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in [r for r in ok if queries(r[0])]:
        s = []
        for i, y in ok:
            n = min(len(x), len(y))
            if i != q:
                s.append((-int(x[:n] @ y[:n]), i))
        out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [65536, 7])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "STEP", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12) * rng.choice([0.1, 1, 5])], 0) for i in range(400)]
    rows += [(400 + i, rows[i][1], 0) for i in range(30)]
    rows += [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")], 0), (1003, [float("inf")], 0), (1004, [], 0), (1010, [2.0, 3.0], 0), (None, [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=10, first_block=50, query_bytes=96 * block, lead=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0, 10)


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_memory_and_early_stop_with_many_queries():
    rng = np.random.default_rng(6)
    q = np.floor(rng.normal(size=(65536, 64)) * 100)
    c = np.floor(rng.normal(size=(512, 64)) * 100)
    c = c[np.argsort(-(c**2).sum(1))]
    block = topk._Block(np.arange(len(q)), q, np.eye(64), 16, 10)
    have, step = block.nothing(), block.step()
    tracemalloc.start()
    for at in range(0, len(c), step):
        have = block.best([have, block.scan(10**6 + np.arange(at, min(len(c), at + step)), c[at : at + step])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    some = rng.choice(len(q), 20, replace=False)
    for i in some:
        want = sorted((-int(x @ q[i]), 10**6 + n) for n, x in enumerate(c))[:10]
        assert sorted(zip((-have[2][have[0] == i]).astype(int).tolist(), have[1][have[0] == i].tolist())) == want
    assert block.scan(np.array([0]), np.zeros((1, 64))) is None
