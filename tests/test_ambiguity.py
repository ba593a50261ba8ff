"""Digests that tell which column differs; the gate of the second, lexical pass."""

import re

from pyspark.sql import functions as F

from loomlake.operators import aggregating as A
from loomlake.operators import ambiguity as M


def test_digests_tell_values_and_kinds_apart(spark):
    digest = lambda data, schema: {r["name"]: r["digest"] for r in A.table_digests(spark.createDataFrame(data, schema), ["v"], ["k"]).collect()}["v"]
    values = [([(1, None)], "k int, v string"), ([(1, "")], "k int, v string"), ([(1, "1")], "k int, v string"), ([(1, 1)], "k int, v int"), ([(1, True)], "k int, v boolean"), ([(1, 1.0)], "k int, v double"), ([(1, bytearray(b"1"))], "k int, v binary"), ([(2, "1")], "k int, v string"), ([], "k int, v string")]
    assert len({digest(*v) for v in values}) == len(values)
    assert digest([(1, 1)], "k int, v int") == digest([(1, 1)], "k long, v long")  # one kind, whatever its width


def test_digests_frame_and_forget_order(spark):
    two = lambda *rows: spark.createDataFrame(list(rows), "k int, a string, b string")
    whole = lambda df: {r["name"]: (r["n"], r["digest"]) for r in A.table_digests(df, ["k", "a", "b"], ["k"]).collect()}
    assert whole(two((1, "ab", "c")))["*"] != whole(two((1, "a", "bc")))["*"]
    assert whole(two((1, "x", "y"), (2, "u", "v"))) == whole(two((2, "u", "v"), (1, "x", "y")).repartition(3))
    left = two((1, "x", "y"), (2, "u", "v"))
    names = lambda right: sorted(r["name"] for r in A.differing(left, right, ["k", "a", "b"], ["k"]).collect())
    assert names(left) == [] and names(two((1, "x", "y"), (2, "u", None))) == ["*", "b"]
    assert names(two((1, "u", "y"), (2, "x", "v"))) == ["*", "a"]  # the same values under other keys
    assert names(two((1, "x", "y"))) == ["*", "a", "b", "k"]


def plain(queries, hits):
    out = {}
    for q, raw in queries:
        own = sorted((h for h in hits if h[0] == q and h[1] <= M.HITS), key=lambda h: h[1])
        dense = re.sub(r"\s", "", raw or "")
        cjk = re.findall("[㐀-䶿一-鿿豈-﫿]", dense)
        ok = bool(raw) and re.search("[一-鿿]", raw) and len(cjk) / max(len(dense), 1) >= M.SHARE and len(raw) <= M.QUERY_CHARS and not re.search(M.IDENTIFIER, raw)
        groups = [h[2] for h in own if h[2] is not None]
        if not ok or not any(groups.count(g) >= 2 for g in groups):
            out[q] = False
            continue
        known, times = set(), {}
        for h in own:
            mine = set()
            for name in re.findall(M.IDENTIFIER, (h[3] or "")[: M.TEXT_CHARS]):
                name = name.lower()
                parts = [p for p in re.split("[_-]", name) if p]
                bad = not 3 <= len(name) <= 48 or any(p in M.SECRET_PARTS for p in parts) or parts[0] in M.SECRET_BEGINNINGS or any(len(p) > 24 for p in parts)
                if bad or (name not in known and len(known) >= M.CANDIDATES):
                    continue
                known.add(name)
                mine.add(name)
            for name in mine:
                times[name] = times.get(name, 0) + 1
        out[q] = any(n >= 2 for n in times.values())
    return out


def test_the_gate_matches_a_plain_version(spark):
    many = " ".join(f"fill_{k}" for k in range(40))
    queries = [(1, "检索方法"), (2, "plain"), (3, "检索 conf_1"), (4, "检索" * 90), (5, "检索"), (6, "检索"), (7, "检索"), (8, None), (9, "检索"), (10, "a b c d e f 检"), (11, "检索")]
    hits = [(q, r, "g", f"Use conf_{r % 2}, ok") for q in (1, 2, 3, 4, 10) for r in range(1, 8)]
    hits += [(5, r, f"g{r}", "conf_1") for r in range(1, 5)] + [(6, 1, "g", "conf_1"), (6, 2, "g", "conf_2"), (6, 7, "g", "conf_1")]
    hits += [(7, 1, "g", "api-key sk-abc12 x_password_y"), (7, 2, "g", "API-KEY sk-abc12 x_password_y"), (8, 1, "g", "a_b1"), (9, 1, "g", many + " late_one"), (9, 2, "g", "late_one"), (11, 1, None, "Foo_Bar"), (11, 2, None, "foo_bar"), (11, 3, "g", None), (11, 4, "g", "x")]
    got = M.ambiguous(spark.createDataFrame(queries, "query_id long, raw string"), spark.createDataFrame(hits, "query_id long, rank int, source_group string, text string"))
    want = plain(queries, hits)
    assert {r["query_id"]: r["ambiguous"] for r in got.collect()} == want
    assert want[1] and want[11] and not any(want[q] for q in (2, 3, 4, 5, 6, 7, 8, 9, 10))


def test_groups_of_hits(spark):
    df = spark.createDataFrame([(" a ", "b", "c"), ("", "b", "c"), (None, " ", "c"), (None, None, "")], "s string, p string, f string")
    assert [r[0] for r in df.select(M.source_group(F.col("s"), F.col("p"), F.col("f"))).collect()] == ["session_id:a", "parent_session_id:b", "source_path:c", None]


def test_fingerprints_follow_everything_but_the_order(spark):
    rows = [("a", 1, "x", [0.5, 1.0]), ("a", 2, "y", None), ("b", 3, "x", [])]
    df = lambda rs: spark.createDataFrame(rs, "g string, k int, t string, v array<float>")
    prints = lambda rs: {r["g"]: r["fingerprint"] for r in A.fingerprints(df(rs), "g", ["k", "t"], "v").collect()}
    base = prints(rows)
    assert prints(rows[::-1]) == base and len(set(base.values())) == 2
    for changed in (("a", 1, "x", [0.5, 1.00001]), ("a", 1, "z", [0.5, 1.0]), ("a", 4, "x", [0.5, 1.0]), ("a", 1, "x", None), ("a", 1, "x", [1.0, 0.5])):
        now = prints([changed, *rows[1:]])
        assert now["a"] != base["a"] and now["b"] == base["b"]
    assert prints([*rows, rows[0]])["a"] != base["a"] and prints([rows[0], ("a", 2, "y", []), rows[2]])["a"] != base["a"]
