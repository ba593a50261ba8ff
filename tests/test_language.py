"""The core's own language classifier: held-out accuracy, odd texts, which blocks have a language."""

import os
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from loomlake.operators import language as L

SF = "/root/testdata/sf0.01"


def plain_trigrams(text):
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return [words[i : i + 3] for i in range(len(words) - 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = L.learn(docs.filter(part != 2)).cache()
    got = L.languages(docs.filter(part == 2), ["doc_id"], "text", model).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    told = [r for r in got if r["lang"] is not None]
    assert len(got) > 200 and len(told) >= 0.97 * len(got)
    assert sum(r["lang"] == r["want"] for r in told) >= 0.99 * len(told)
    assert model.count() == model.select("gram").distinct().count() * model.select("lang").distinct().count()


def test_scores_match_a_plain_version(spark):
    docs = [("en", "the cat and the dog"), ("en", "a thing of the past"), ("de", "der Hund und die Katze"), ("de", "ein Ding der Übel"), (None, "x"), ("en", None)]
    model = L.learn(spark.createDataFrame(docs, "lang string, text string"), grams=7)
    counts = {g: Counter(t for lang, x in docs if lang == g and x for t in plain_trigrams(x)) for g in ("en", "de")}
    chosen = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:7]}
    want = {(g, lang): round(1000 * log((c[g] + 1) / (sum(c[x] for x in chosen) + len(chosen)))) for lang, c in counts.items() for g in chosen}
    assert {(r["gram"], r["lang"]): r["score"] for r in model.collect()} == want


def test_odd_texts(spark):
    model = spark.createDataFrame([("the", "en", -1000), ("the", "de", -9000), ("der", "en", -9000), ("der", "de", -1000), ("und", "en", -2000), ("und", "de", -1000)], "gram string, lang string, score long")
    texts = [None, "", "12 34 !!", "zzz", "the", "der", "und", "the der", "the the der"]
    got = {r["i"]: r["lang"] for r in L.languages(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), ["i"], "t", model).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "en", 5: "de", 6: None, 7: None, 8: "en"}
    none = L.learn(spark.createDataFrame([], "lang string, text string"))
    assert none.collect() == [] and L.languages(spark.createDataFrame([(1, "the")], "i long, t string"), ["i"], "t", none).collect()[0]["lang"] is None


def test_which_blocks_have_a_language(spark):
    model = spark.createDataFrame([("the", "en", -1000), ("the", "de", -9000)], "gram string, lang string, score long")
    rows = [("a", "user", "text", 0, "the"), ("b", "user", "text", 1, "the"), ("c", "user", "tool_use", 0, "the"), ("d", "system", "text", 0, "the"), ("e", "user", "text", 0, "<x> the"), ("f", "assistant", "text", 0, "<x> the"), ("g", "user", "text", 0, "```the```"), ("h", None, None, 0, "the")]
    chunks = spark.createDataFrame(rows, "id string, role string, block_type string, split_idx long, text string")
    got = {r["id"]: r["lang"] for r in L.block_languages(chunks, model, F.col("text").startswith("<")).collect()}
    assert got == {"a": "en", "b": None, "c": None, "d": None, "e": None, "f": "en", "g": None, "h": None}
