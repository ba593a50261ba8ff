import random

import numpy as np
import pytest

from loomlake.llm.induced_sort import repeated_starts, suffix_order, symbols
from loomlake.llm.substring_dedup import SubstringDedup, brute_force, digests, substring_dedup

SCHEMA = "doc_id long, text string, block string"


def test_suffix_order_matches_sorting():
    r = random.Random(1)
    for trial in range(120):
        segments = [bytes(r.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 6))]
        if trial % 5 == 0:
            segments.append(b"a" * r.randint(1, 80))
        t, _, _ = symbols(segments)
        order = suffix_order(t, 1000, in_memory=50 if trial % 3 else 1 << 20)  # the small one goes to disk
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_repeated_starts_match_counting():
    r = random.Random(2)
    for trial in range(60):
        segments = [bytes(r.choice(b"ab" if trial % 2 else b"abcd") for _ in range(r.randint(1, 90))) for _ in range(r.randint(1, 6))]
        copies = np.array([r.choice([1, 1, 2]) for _ in segments])
        n = r.choice([8, 9, 16, 20])
        seen = {}
        for s, c in zip(segments, copies, strict=True):
            for i in range(len(s) - n + 1):
                seen[s[i : i + n]] = seen.get(s[i : i + n], 0) + c
        want = {(k, i) for k, s in enumerate(segments) for i in range(len(s) - n + 1) if seen[s[i : i + n]] > 1}
        seg, at = repeated_starts(segments, copies, n)
        assert set(zip(seg.tolist(), at.tolist(), strict=True)) == want


def corpus():
    r = random.Random(4)
    words = ["la", "ción", "étre", "the", "of", "zu", "ß", "日本", "x", "👍"]
    make = lambda n: " ".join("".join(r.choices(words, k=r.randint(1, 5))) for _ in range(n))
    passage, line = make(60), make(12)
    texts = [make(r.choice([0, 1, 20, 80, 300])) for _ in range(40)]
    texts += [make(30) + passage + make(30) for _ in range(5)] + [passage] * 3 + [texts[5], texts[7], texts[7]]
    texts += ["ab " * 300, "a" * 500, "a" * 199, "a" * 200, "hello world, " * 40, "", None, None, " ", line * 30]
    texts += [passage[:210], passage[1:200], texts[3][-250:] + "z", "q" + texts[3][-250:]]
    return texts


def test_query_matches_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "clash")]
    run = SubstringDedup(spark.createDataFrame(rows, SCHEMA).repartition(4))
    run.blocks, run.shares, run.shards = 5, 3, 4
    from pyspark.sql import functions as F

    run.docs = run.docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int"))
    got = sorted(map(tuple, digests(run.cleaned()).collect()))
    want = brute_force([(t or "").encode() for _, t, _ in rows], 200)
    assert got == sorted((i, *w) for (i, _, _), w in zip(rows, want, strict=True))


def test_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 4, 7, 8, 9])
def test_short_strings(length):
    for texts in ([b"abcdefgh"], [b"abab", b"ba"], [b"aaaa"], [b"abcdefgh", b"xbcdefghi"]):
        count = {}
        for t in texts:
            for i in range(len(t) - length + 1):
                count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
        want = sorted((k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1)
        seg, at = repeated_starts(texts, np.ones(len(texts), int), length)
        assert sorted(zip(seg.tolist(), at.tolist(), strict=True)) == want
