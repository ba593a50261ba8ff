import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from loomlake.llm import runs as R


def plain_runs(w, least=6, exponent=4):
    """Every period, every stretch that keeps it, those with a smaller period left out."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            seg = w[i : j + p]
            if len(seg) >= max(least, math.ceil(exponent * p)) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                out.append((i, len(seg), p))
            i = j
    return sorted(out)


def plain_document(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = plain_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))


def samples(r, n):
    for _ in range(n):
        k = r.choice([1, 2, 2, 3])
        w = [r.randrange(k) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            w = w[: len(w) // 3] + [r.randrange(k) for _ in range(r.randint(1, 5))] * r.randint(2, 7) + w[len(w) // 3 :]
        yield w


def test_lyndon_arrays_and_agreements():
    for w in samples(random.Random(2), 800):
        after, same = R.lyndon([*w, -1])
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert after[i] == j
            if j < len(w):
                k = same[i]
                assert w[i : i + k] == w[j : j + k] and (j + k == len(w) or w[i + k] != w[j + k])


def test_runs_match_brute_force(monkeypatch):
    for listed in (R.LISTED, 5):  # lists, and arrays as for very long texts
        monkeypatch.setattr(R, "LISTED", listed)
        for w in samples(random.Random(3), 800):
            for least, exponent in ((6, 4), (2, 2), (4, 2.5)):
                assert R.runs(np.array(w, np.int64), least, exponent) == plain_runs(w, least, exponent)


class Counted(list):
    seen = 0

    def __getitem__(self, i):
        Counted.seen += 1
        return list.__getitem__(self, i)


def test_symbols_are_read_a_bounded_number_of_times():
    r = random.Random(4)
    fib, nxt = [0], [0, 1]
    while len(nxt) < 20_000:
        fib, nxt = nxt, nxt + fib
    block = [r.randrange(50) for _ in range(1_000)]
    for w in ([0] * 20_000, list(range(20_000)), list(range(20_000, 0, -1)), nxt, block * 20, [r.randrange(2) for _ in range(20_000)], ([0] * 99 + [1]) * 200, ([1] * 99 + [0]) * 200):
        Counted.seen = 0
        R.lyndon(Counted([*w, -1]))
        assert Counted.seen <= 12 * len(w)


def test_documents(spark):
    r = random.Random(5)
    texts = ["", None, " \t\n", "a", "a a a a a", "a a a a a a", "b " * 9 + "a", "\x0b\x0cx y " * 4, "é ñ " * 6, "a b c " * 200 + "x", "x" * 100_000 + " x" * 7]
    texts += [" ".join(map(str, w)) + r.choice(["", "\n", "  z"]) for w in samples(r, 60)]
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts)] + [(None, "a " * 6, "clash", 2.5), (3, "a", "clash", 0.0), (3, "a", "clash", 0.0)]
    got = R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, length double")).collect()
    want = [(i, *plain_document(t)) for i, t, _, _ in rows]
    key = repr
    assert sorted(((g["doc_id"], [tuple(x) for x in g["runs"]], g["collapsed"]) for g in got), key=key) == sorted(want, key=key)
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_end_where_texts_do():
    lists, kept = R._found(pa.array(["a a a", "a a a", None, "a"]), 6, 4)
    assert lists.to_pylist() == [[]] * 4 and kept.to_pylist() == ["a a a", "a a a", "", "a"]


def test_the_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    from loomlake.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in Q.op11_periodic_runs(spark, sf).collect()}
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(table)
    for row in table:
        found, kept = plain_document(planted(row["doc_id"], row["text"]))
        g = got[row["doc_id"]]
        best = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else (None, None, None)
        assert (g["n_runs"], g["start"], g["length"], g["period"]) == (len(found), *best)
        assert g["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert g["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert g["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(g["n_runs"] > 0 for g in got.values()) > 5


def test_planted_runs_of_odd_rows(spark):
    rows = [(i, t) for i in range(60) for t in ("", None, " ", "a b", "a b c d e f g h i j k l m n o p")] + [(None, "a b c")]
    got = R.planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, t if i is None else planted(i, t)) for i, t in rows), key=repr)
