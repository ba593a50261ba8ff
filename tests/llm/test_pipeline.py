"""The whole pipeline over odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, KEPT string, lang_pred string, n_lines string, n_dropped string, ids string"


def prose(r, lang, n):
    words = {"en": "the of and to in is that for it with as was on are by this be at from or".split(), "de": "der die und das nicht ist mit ein von sie auf für den dem sich auch als noch wie nach".split()}[lang]
    return " ".join(r.choice(words) + r.choice(["", "ing", "en", "er", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    path = str(tmp_path_factory.mktemp("pipeline"))
    item = prose(r, "en", 40)
    rows = [(i, prose(r, ("en", "de")[i % 2], r.choice([20, 60, 200])), ("en", "de")[i % 2]) for i in range(80)]
    near = prose(r, "en", 300)
    rows += [(None, prose(r, "de", 80), "de"), (None, None, None), (5, prose(r, "en", 70), "en"), (90, near, "en"), (91, near + " last", "en"), (None, near, "en"), (92, item + " " + prose(r, "en", 30), "en"), (93, "", "en"), (94, "1234 5678", None)]
    rows += [(95, "\n".join(prose(r, "de", 12) for _ in range(4_000)), "de")]
    full = [(i, t, lang, "s", len(t or ""), "own score", "own kept", "own pred", "own lines", "own dropped", "own ids") for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_return_the_columns_they_got(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema], name
        own = docs.select("score", F.col("KEPT").alias("k"), "lang_pred", "n_lines", "n_dropped", "ids").distinct().collect()
        assert [tuple(r) for r in own] == [("own score", "own kept", "own pred", "own lines", "own dropped", "own ids")], name
    left = docs.select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in left]
    assert 92 not in ids and 93 not in ids and 94 not in ids  # a test item; no letters
    assert sum((r["text"] or "").startswith(docs.filter("doc_id = 90").first()["text"][:200]) for r in left) == 1  # of the near copies
    assert ids.count(5) == 2 and None in ids  # rows under one id, and without one, are rows of their own
    assert len(ids) >= 80


def test_the_whole_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    tokens = {}
    for p in pieces:
        tokens.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"]))
    for (_, total), own in tokens.items():
        assert sum(n for _, n in own) % total == 0
    assert len(pieces) > 80


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
