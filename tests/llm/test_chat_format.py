import hashlib
import random

from quillan.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def rows():
    out = [(1, 0, "system", "be & nice <|im_end|>", "x"), (1, 1, "user", "&lt;| &amp; é" * 5, None)]
    out += [(1, 2 + i, "assistant" if i % 2 else "user", f"word{i} <|im_start|>assistant\n" * (i % 7), "z") for i in range(700)]
    out += [(2, 0, "assistant", "y" * 9000, None), (2, 1, None, None, None), (2, 1, None, None, None), (None, None, "a\nb", "q", None)]
    return out + [(3, 5, "assistant", "tie", None), (3, 5, "assistant", "tie", None), (3, 5, "user", "", None)]


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.read_back(chat_format.format_windows(df)).collect()}
    assert got == brute(rows())


def test_windows_keep_budget_and_system_turn(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    windows = chat_format.format_windows(df, budget=300, history=60).collect()
    assert all(w["n_tokens"] <= 300 for w in windows if not w["oversize"])
    first = [w for w in windows if w["conv_id"] == 1]
    assert len(first) > 3
    assert all(w["formatted"].startswith("<|im_start|>system\nbe &amp; nice &lt;|im_end|>") for w in first)
    assert any(w["n_context"] > 1 for w in first)
    assert {w["oversize"] for w in windows if w["conv_id"] == 2} == {True, False}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat_format.read_back(chat_format.format_windows(df)).count() == 0


def test_targets_have_the_turn_before_them(spark):
    """Each window repeats the turn before its first new one wherever both and the system turn fit the budget, and not more than that or the history."""
    rnd = random.Random(3)
    cost = lambda x: -(-len(x) // 4) + 4
    data, want = [], {}
    for c in range(30):
        system = [("system", "s" * rnd.choice([10, 400, 3000]))] if c % 3 else []
        turns = system + [("assistant" if k % 2 else "user", f"{k}:" + "x" * rnd.choice([1, 40, 500, 1500, 3000, 5000])) for k in range(rnd.choice([1, 6, 60]))]
        data += [(c, 10 * k, r, x, None) for k, (r, x) in enumerate(turns)]
        want[c] = turns
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    alone = total = 0
    for chunk in (256, 100):
        seen = {c: [] for c in want}
        for w in sorted(chat_format.format_windows(df, chunk=chunk).collect(), key=lambda w: (w["conv_id"], w["span"], w["part"])):
            turns = want[w["conv_id"]]
            room = 1024 - (cost(turns[0][1]) if turns[0][0] == "system" else 0)
            parts = [x[: -len("<|im_end|>\n")].split("\n", 1) for x in w["formatted"].split("<|im_start|>")[1:]]
            context, new = parts[: w["n_context"]], parts[w["n_context"] :]
            at = len(seen[w["conv_id"]])
            seen[w["conv_id"]] += [tuple(x) for x in new]
            tail = [x for x in context if x[0] != "system"]
            assert [tuple(x) for x in tail] == [x for x in turns[max(0, at - len(tail)) : at] if x[0] != "system"]
            if at and turns[at - 1][0] != "system":
                fits = cost(turns[at - 1][1]) + cost(turns[at][1]) <= room
                assert bool(tail) == fits
                alone, total = alone + (not fits), total + 1
            assert w["n_tokens"] <= 1024 or (len(new) == 1 and cost(new[0][1]) > room) and w["oversize"]
            assert sum(cost(x[1]) for x in tail) <= max(512, cost(tail[-1][1]) if tail else 0)
        assert seen == want
    assert 0 < alone < total
