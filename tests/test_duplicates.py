"""Near-duplicates by window and bands against all pairs."""

import numpy as np
import pytest

from loomlake.operators import duplicates as D


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def roots(keys, similar):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in similar:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def frame(spark, groups, x):
    return spark.createDataFrame([(int(g), i, [float(c) for c in v]) for i, (g, v) in enumerate(zip(groups, x, strict=True))], "g int, k long, v array<double>")


@pytest.mark.parametrize("bound, block", [(48, 1024), (2, 8), (10_000, 1024)])
def test_hubs_lose_no_link(spark, bound, block):
    """A bucket of half of all rows: joined, or in blocks of any size, the classes are the same."""
    r = np.random.default_rng(1)
    x = unit(r.normal(size=(240, 16)))
    x[:120] = unit(x[0] + 0.05 * r.normal(size=(120, 16)) / 4)
    groups = r.integers(0, 2, 240)
    groups[:120] = 0
    df = frame(spark, groups, x)
    pairs = [tuple(p) for p in D.links(df, "g", "k", ["k"], "v", bound=bound, block=block).collect()]
    cosine = x @ x.T
    want = roots(range(240), [(a, b) for a in range(240) for b in range(a) if groups[a] == groups[b] and cosine[a, b] >= D.NEAR])
    assert roots(range(240), pairs) == want and len(set(want.values())) < 130
    if bound == 2:
        assert len(pairs) < 120 * 119 / 2  # a hub's pairs are not rows


def test_recall_of_all_pairs(spark):
    """Of the pairs of 0.97 or more of the rows divisible by 100, at least nine in ten hang together, and hardly any
    other rows do."""
    r = np.random.default_rng(2)
    n = 2000
    x = unit(r.normal(size=(n, 64)))
    for i in range(0, n, 100):
        for j in (i + 37, i + 61):
            x[j] = unit((x[i] + r.normal(size=64) * r.uniform(0.005, 0.03))[None])[0]
    groups = np.zeros(n, int)
    got = {c["k"]: c["root"] for c in D.classes(frame(spark, groups, x), "g", "k", ["k"], "v").collect()}
    cosine = x[::100] @ x.T
    asked = [(i * 100, j) for i in range(n // 100) for j in range(n) if j != i * 100 and cosine[i, j] >= D.NEAR]
    assert len(asked) > 20
    assert sum(got[a] == got[b] for a, b in asked) >= 0.9 * len(asked)
    assert len(got) == n and all(got[k] == k or max(abs(x[k] @ x[o]) for o in range(n) if o != k and got[o] == got[k]) >= D.NEAR for k in range(n))


def test_the_window_finds_what_bands_miss(spark, monkeypatch):
    x = unit(np.random.default_rng(3).normal(size=(40, 8)))
    x[17], x[39] = x[1], x[1]
    monkeypatch.setattr(D, "band_keys", lambda v: __import__("pyspark.sql.functions", fromlist=["f"]).array().cast("array<int>"))
    assert [tuple(p) for p in D.links(frame(spark, [0] * 40, x), "g", "k", ["k"], "v").collect()] == [(1, 17)]  # 16 places apart, not 22


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (1, 3, [1.0, 0.0]), (0, 4, [-1.0, 0.0]), (0, 5, None), (None, 6, [1.0, 0.0]), (0, 7, [0.0, 0.0]), (0, 8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>")
    got = {c["k"]: (c["root"], c["size"]) for c in D.classes(df, "g", "k", ["k"], "v").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 7: (7, 1), 8: (8, 1)}
    assert D.classes(df.limit(0), "g", "k", ["k"], "v").collect() == []


def test_planes_are_fixed():
    assert D.planes(3)[:4].astype(int).tolist() == [[(1 if int(D._mixed(np.array([(p * 0x9E3779B97F4A7C15 + d + 0x6A09E667F3BCC909) % 2**64], np.uint64))[0]) & 1 else -1) for d in range(3)] for p in range(4)]
    assert D.planes(64).shape == (80, 64) and abs(D.planes(64).mean()) < 0.05


def test_links_are_no_pairs_and_no_row_functions(spark):
    """Small buckets give links too, and no cosine is folded number by number for each pair."""
    x = unit(np.random.default_rng(4).normal(size=(40, 16)))
    x[5:40] = unit(x[5] + 0.001 * x[5:40])
    found = D.links(frame(spark, [0] * 40, x), "g", "k", ["k"], "v", window=1)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = [tuple(p) for p in found.collect()]
    assert len(pairs) < 2 * 35 and len(set(roots(range(40), pairs).values())) == 6
