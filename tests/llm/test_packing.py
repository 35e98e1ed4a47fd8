import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillan.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_blocks_hold_their_pieces(sizes):
    bins, used, final = packing.pack_block(np.array(sizes, dtype=np.int64), (16, 32, 64), 2)
    load = np.bincount(bins, weights=sizes, minlength=len(used)) if sizes else []
    assert list(load) == list(used)
    assert all(c == min(x for x in (16, 32, 64) if x >= u) for u, c in zip(used, final))


def test_joint_choice_beats_or_matches_each_single_length():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 300)
    cost = lambda lengths: (lambda r: r[2].sum() + 4 * len(r[2]))(packing.pack_block(sizes, lengths, 4))
    assert cost((16, 32, 64)) <= cost((64,))


def optimal(sizes, lengths, overhead):
    """Least cost over all ways to put the pieces together."""
    best = [10**9]

    def place(k, bins, cost=0):
        if k == len(sizes):
            best[0] = min(best[0], sum(min(c for c in lengths if c >= b) + overhead for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= max(lengths):
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        place(k + 1, bins + [sizes[k]])

    place(0, [])
    return best[0]


def test_cost_is_near_the_least_possible():
    rnd = random.Random(3)
    lengths, ratio = (16, 32, 64), []
    for _ in range(150):
        sizes = [rnd.randrange(1, 65) for _ in range(rnd.randrange(1, 8))]
        _, _, final = packing.pack_block(np.array(sizes), lengths, 4)
        ratio.append((final.sum() + 4 * len(final)) / optimal(sizes, lengths, 4))
        assert 1 <= ratio[-1] <= 1.5
    assert sum(ratio) / len(ratio) < 1.05


def test_bins_do_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(i % 700, "x" * (4 * (i * 7 % 300)), None) for i in range(900)], "doc_id long, text string, bin_id string")
    one, many = (sorted(map(str, packing.pack(df.repartition(n), lengths=(64, 256), block=120).collect())) for n in (1, 9))
    assert one == many


def test_rows(spark):
    schema = "doc_id long, text string, bin_id string"
    rows = [(i, "x" * (4 * (i % 50)), None) for i in range(500)] + [(600, "y" * 4 * 1000, None), (601, None, None), (None, "z", None), (5, "x" * 20, None)]
    got = packing.pack(spark.createDataFrame(rows, schema).repartition(3), lengths=(32, 64, 128), block=100).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + -(-len(t or "") // 4)
    assert total == want
    bins = {}
    for r in got:
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins.setdefault(r["bin_id"], []).append(r)
    for items in bins.values():
        items.sort(key=lambda r: r["slot"])
        at = 0
        for k, r in enumerate(items):
            assert (r["slot"], r["offset"]) == (k, at)
            at += r["n_tokens"]
        assert at == items[0]["bin_used"] <= items[0]["bin_length"]
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
