import random
import zlib
from collections import Counter, defaultdict

from quillan.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size int"


def check(rows, got, shards, slack):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, _, _ in rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(load.values()) / shards
    assert set(load) <= set(range(shards)) and max(load.values()) <= mean + slack
    return load


def test_balance_with_hot_group(spark):
    rows = [(i, "é" * (i % 90) + str(i), None, None) for i in range(3000)] + [(5000 + i, "copy " * 30, None, None) for i in range(1200)] + [(7000 + i, f"few {i % 50}", None, None) for i in range(400)]
    rows += [(9000, None, None, None), (9001, None, None, None), (9002, "", None, None), (None, "x", None, None), (9001, None, None, None)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), 16).collect()
    load = check(rows, got, 16, 600)
    assert min(load.values()) > 0.9 * sum(load.values()) / 16
    text = {i: t for i, t, _, _ in rows}
    homes = defaultdict(set)
    for r in got:
        if 7000 <= (r["doc_id"] or 0) < 7400:
            homes[text[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())


def test_odd_numbers_of_shards_and_dims(spark):
    rows = [(i, "w" * 20, None, i % 7) for i in range(700)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 5, dims=["size"]).collect()
    check(rows, got, 5, 21 * 8)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a", None, None)], SCHEMA)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df, 1).collect()] == [(0, 0)]


def brute_tree(units, dims, shards, heavy):
    """Leaves of (unit, w, h, dims...) rows by plain recursion."""
    whole = {d: (max(u[d] for u in units) - min(u[d] for u in units)) or 1 for d in dims}
    out = {}

    def split(own, first, end):
        if end - first == 1 or not own:
            out.update({u["unit"]: first for u in own})
            return
        mid = (first + end) // 2
        share = (mid - first) / (end - first)
        axis = max(dims, key=lambda d: (max(u[d] for u in own) - min(u[d] for u in own)) / whole[d])
        own = sorted(own, key=lambda u: (u[axis], u["h"]))
        big, small = [u for u in own if u["unit"] in heavy], [u for u in own if u["unit"] not in heavy]
        sums = [0]
        for u in big:
            sums.append(sums[-1] + u["w"])
        n = min(range(len(sums)), key=lambda k: abs(sums[k] - sums[-1] * share))
        total = sum(u["w"] for u in small)
        goal = min(total, max(0, (total + sums[-1]) * share - sums[n]))
        below, m = 0, 0
        for u in small:
            if abs(below + u["w"] - goal) > abs(below - goal):
                break
            below, m = below + u["w"], m + 1
        split(big[:n] + small[:m], first, mid)
        split(big[n:] + small[m:], mid, end)

    split(units, 0, shards)
    return out


def test_tree_against_plain_recursion(spark):
    rnd = random.Random(4)
    rows = [(k, float(rnd.randrange(5, 60)), float(rnd.randrange(10**12)), float(rnd.choice([3, 3, rnd.randrange(100)])), float(rnd.randrange(1000))) for k in range(500)]
    rows += [(1000 + k, float(rnd.randrange(200, 900)), float(rnd.randrange(10**12)), float(rnd.randrange(100)), float(rnd.randrange(1000))) for k in range(9)]
    df = spark.createDataFrame(rows, "unit long, w double, h double, a double, b double").repartition(3)
    units = [r.asDict() for r in df.collect()]
    for shards in (4, 7):
        placed, heavy = sharding.kd_tree(df.where("unit < 1000"), ["a", "b"], shards, df.where("unit >= 1000").collect(), bins=8, fine=10**9)
        got = {r["unit"]: r["node"] for r in placed.collect()} | heavy
        assert got == brute_tree(units, ["a", "b"], shards, set(heavy))


def test_groups_stay_whole_up_to_half_a_shard(spark):
    rows = [(i, f"{i} " + "w" * (i % 50), "abcdef"[i % 6], i) for i in range(4000)]
    rows += [(10000 + 1000 * g + k, f"group {g}", "ab", 0) for g in range(8) for k in range(40 * g + 1)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), 16, dims=["size", "shard"]).collect()
    load = check(rows, got, 16, 150)
    assert min(load.values()) > 0.98 * sum(load.values()) / 16
    homes = defaultdict(set)
    for r in got:
        if r["doc_id"] >= 10000:
            homes[r["doc_id"] // 1000].add(r["shard"])
    assert len(homes) == 8 and all(len(v) == 1 for v in homes.values())


def test_target_bytes_decide_the_number_of_shards(spark):
    rows = [(i, "w" * 99, "x", i) for i in range(1000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), None, dims=["size"], target_bytes=9000).collect()
    assert {r["shard"] for r in got} == set(range(12))
    check(rows, got, 12, 100)
