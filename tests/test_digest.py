"""The digest's choice against a plain version that goes unit by unit, over random sessions."""

import math
import random

import numpy as np

from loomlake.operators import digest as D


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def mean(xs, weights=None):
    weights = weights or [1] * len(xs)
    return [sum(w * x[d] for w, x in zip(weights, xs, strict=True)) / sum(weights) for d in range(len(xs[0]))]


def length(x):
    return math.sqrt(dot(x, x))


def direction(x):
    return [a / length(x) for a in x] if length(x) > 1e-7 else None


def plain_pivots(turn, v, mass, most):
    """(turn before, distance), turn by turn; ``v`` has None where a unit has no vector."""
    turns = []
    for t in range(max(turn) + 1):
        own = [i for i in range(len(v)) if turn[i] == t and v[i] is not None]
        turns.append(direction(mean([v[i] for i in own], [mass[i] for i in own])) if own else None)
    bounds = []
    for at in range(len(turns) - 1):
        left, right = ([x for x in s if x is not None] for s in (turns[max(0, at - 1) : at + 1], turns[at + 1 : at + 3]))
        left, right = (direction(mean(s)) if s else None for s in (left, right))
        if left and right:
            bounds.append((max(0, 1 - dot(left, right)), at))
    chosen = []
    for far, at in sorted(bounds, key=lambda x: (-x[0], x[1])):
        if len(chosen) < most and all(abs(at - c) > 2 for c, _ in chosen):
            chosen.append((at, far))
    return chosen


def plain(kind, role, turn, v, mass, quality, chars, units, budget):
    n = len(v)
    there = [i for i in range(n) if v[i] is not None]
    centre = mean([v[i] for i in there], [mass[i] for i in there]) if there else None
    pool, strength = [], {}
    texts = [i for i in range(n) if kind[i] == "text"]
    if texts:
        pool.append(next((i for i in texts if role[i] == "user"), texts[0]))
    pool += [i for i in texts if role[i] == "assistant"][-1:]
    near = [i for i in texts if v[i] is not None]
    if near and centre and length(centre) > 1e-7:
        pool.append(max(near, key=lambda i: (round(quality[i] * max(0, dot(v[i], centre)) / length(centre), 12), -i)))
    must = list(dict.fromkeys(pool))
    ways = []
    for _ in range(min(6, max(1, max(units - len(must), 0) // 2)) if there else 0):
        rest = {}
        for i in there:
            r = [a - c for a, c in zip(v[i], centre, strict=True)]
            for w in ways:
                p = dot(r, w)
                r = [a - p * b for a, b in zip(r, w, strict=True)]
            rest[i] = r
        best = max(there, key=lambda i: (round(quality[i] * length(rest[i]), 12), -i))
        if quality[best] * length(rest[best]) <= 1e-7 or direction(rest[best]) is None:
            break
        ways.append(direction(rest[best]))
        for sign in (1, -1):
            reach = {i: quality[i] * max(0, sign * dot([a - c for a, c in zip(v[i], centre, strict=True)], ways[-1])) for i in there}
            k = max(there, key=lambda i: (round(reach[i], 12), -i))
            if reach[k] > 0:
                pool.append(k)
    for at, far in plain_pivots(turn, v, mass, min(6, max(1, units // 2))):
        for i in ([i for i in texts if turn[i] <= at][-1:], [i for i in texts if turn[i] > at][:1]):
            for k in i:
                pool.append(k)
                strength[k] = max(strength.get(k, 0), far)
    pool, out = list(dict.fromkeys(pool)), list(must)
    cap = max(budget // units, D.LEAST_SHOWN)
    cost = [min(c, min(cap, D.RESULT_SHOWN) if k == "tool_result" else cap) + D.FRAME for k, c in zip(kind, chars, strict=True)]
    covers = lambda o, j: max(0, dot(v[o], v[j])) if v[o] is not None and v[j] is not None else 0
    while len(out) < units:
        best = None
        for i in pool:
            if i in out or v[i] is None or sum(cost[j] for j in out) + cost[i] > budget:
                continue
            gain = sum(mass[j] * max(0, covers(i, j) - max([covers(o, j) for o in out], default=0)) for j in range(n))
            gain += 0.5 * sum(mass) / units * strength.get(i, 0) / max(strength.values()) if strength and max(strength.values()) else 0
            if best is None or gain / math.sqrt(1 + cost[i] / 4000) > best[0] + 1e-12:
                best = (gain / math.sqrt(1 + cost[i] / 4000), gain, i)
        if best is None or best[1] < 0.25 * sum(mass) / units:
            break
        out.append(best[2])
    return out


def session(r, n, size=5):
    v = np.array([[r.gauss(0, 1) for _ in range(size)] for _ in range(n)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    has = np.array([r.random() < 0.85 for _ in range(n)])
    turn = np.cumsum([0] + [int(r.random() < 0.6) for _ in range(n - 1)])
    return turn, v * has[:, None], has, [x if h else None for x, h in zip(v.tolist(), has, strict=True)]


def test_choice_matches_the_plain_version():
    """Several units a turn, units without vectors, mass apart from quality."""
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 24)
        turn, v, has, some = session(r, n)
        kind = [r.choice(["text", "text", "tool_use", "tool_result"]) for _ in range(n)]
        role = [r.choice(["user", "assistant"]) for _ in range(n)]
        mass, quality, chars = [r.uniform(0.1, 1) for _ in range(n)], [r.uniform(0.05, 1) for _ in range(n)], [r.randint(1, 6000) for _ in range(n)]
        units, budget = r.randint(1, 12), r.choice([1000, 4000, 12000])
        got = D.chosen_units(np.array(kind), np.array(role), turn, v, has, np.array(mass), np.array(quality), np.array(chars), units, budget)
        assert got == plain(kind, role, turn.tolist(), some, mass, quality, chars, units, budget)


COLUMNS = "session_id string, seq long, turn_uuid string, unit_id long, role string, block_type string, text_hash string, vector array<double>, mass double, quality double, chars long"


def frame(spark, sessions):
    rows = []
    for name, (turn, v, has, _) in sessions.items():
        rows += [(name, int(turn[i]), f"t{turn[i]}", len(rows) + i, "user", "text", f"h{len(rows) + i}", [float(x) for x in v[i]] if has[i] else None, 0.5 + i % 2, 1.0, 100) for i in range(len(v))]
    return spark.createDataFrame(rows, COLUMNS)


def test_transitions_match_the_plain_version(spark):
    r = random.Random(5)
    sessions = {f"s{k}": session(r, k) for k in range(1, 30)}
    a, b = [1.0, 0, 0, 0, 0], [0, 1.0, 0, 0, 0]
    for name, v in (("first", [a, b, b, b, b]), ("two", [a, b]), ("three", [a, a, b]), ("one", [a])):
        sessions[name] = (np.arange(len(v)), np.array(v), np.ones(len(v), bool), v)
    df = frame(spark, sessions)
    got = {}
    for x in D.transitions(df).collect():
        got.setdefault(x["session_id"], {})[x["seq"]] = x["distance"]
    for name, (turn, _, _, some) in sessions.items():
        want = dict(plain_pivots(turn.tolist(), some, [0.5 + i % 2 for i in range(len(some))], 6))
        assert got.get(name, {}).keys() == want.keys() and all(abs(got[name][k] - want[k]) < 1e-9 for k in want), name
    assert abs(got["first"][0] - 1) < 1e-9 and "one" not in got and list(got["two"]) == [0]
    assert D.transitions(df.limit(0)).collect() == []


def test_units_that_say_the_same_share_their_mass(spark):
    rows = [("s", i, f"t{i}", i, "user", kind, text, v, 0.0, 1.0, 10) for i, (kind, text, v) in enumerate([
        ("text", "a", [1.0, 0.0]), ("text", "a", [0.0, 1.0]), ("text", "b", [0.999, 0.01]), ("text", "c", None), ("tool_use", "c", None), ("text", "d", [-1.0, 0.0]), ("tool_result", "e", [-0.5, 0.0])])]
    rows += [("other", 0, "t0", 7, "user", "text", "a", [1.0, 0.0], 0.0, 1.0, 10)]
    df = spark.createDataFrame(rows, COLUMNS).drop("mass")
    want = {0: 1 / 3, 1: 1 / 3, 2: 1 / 3, 3: 1 / 2, 4: 0.35 / 2, 5: 1 / 2, 6: 0.2 / 2, 7: 1.0}
    for exact in (3_000, 1):  # all pairs, or window and bands
        got = {r["unit_id"]: r["mass"] for r in D.with_mass(df, exact=exact).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_session_is_digested_whole(spark):
    rows = [("a", i // 2, f"t{i // 2}", i, "user" if i // 2 % 2 else "assistant", "text", f"h{i}", [float(i % 5), 1.0, float(i % 3)], 0.5, 300) for i in range(60)]
    rows += [("b", 0, None, 100, "user", "text", "x", [1.0, 0.0, 0.0], 1.0, 10), ("c", 0, "t", 101, "user", "text", "y", None, 1.0, 10)]
    df = spark.createDataFrame(rows, COLUMNS.replace("mass double, ", ""))
    got = D.digest(df, 6).collect()
    assert {x["session_id"] for x in got} == {"a", "b", "c"} and sum(x["session_id"] == "a" for x in got) <= 6
    assert {(x["session_id"], x["unit_id"]) for x in got} >= {("a", 2), ("a", 57), ("b", 100), ("c", 101)}
    assert D.digest(df.filter("seq < 0")).count() == 0


def test_what_is_shown(spark):
    from pyspark.sql import functions as F

    rows = [("text", "x" * 500), ("tool_result", "y" * 5000), ("text", "z" * 5000), ("text", "é" * 240)]
    shown = [r[0] for r in spark.createDataFrame(rows, "k string, t string").select(D.display(F.col("t"), F.col("k"), 1, 3_000)).collect()]
    assert [len(s) for s in shown] == [500, D.RESULT_SHOWN, 3_000, 240]
    kept = 2_000 - len(D.SHORTENED)
    assert shown[1] == "y" * (kept * 7 // 10) + D.SHORTENED + "y" * (kept - kept * 7 // 10)
