"""The stored word index against BM25 over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import postings as P
from loomlake.operators import searching as S


def corpus(r, n):
    words = ["the", "of", *[f"w{i}" for i in range(40)], "rare", "É1"]
    weights = [40, 20, *[1 + 40 / (i + 1) for i in range(40)], 0.3, 1]
    return [(i, None if i % 97 == 5 else " ".join(r.choices(words, weights, k=r.choice([0, 3, 20, 80])))) for i in range(n)]


@pytest.mark.parametrize("range_docs, first", [(256, 8), (5, 1), (1, 3)])
def test_search_equals_bm25(spark, tmp_path, range_docs, first):
    rows = spark.createDataFrame(corpus(random.Random(1), 700), "id long, t string").cache()
    path = str(tmp_path / "ix")
    P.write_index(rows, "id", "t", path, range_docs)
    for query, ks in (("the", (10,)), ("the of w0", (1, 1000)), ("rare the", (10,)), ("É1 rare w39", (10,)), ("nowhere", (1,)), ("", (1,)), ("w3 w3", (10,))):
        for k in ks:
            got = [(r["id"], round(r["score"], 7)) for r in P.search(spark, path, "id", "bigint", query, k, first).collect()]
            want = [(r["id"], round(r["score"], 7)) for r in S.bm25(rows.withColumn("t", F.coalesce("t", F.lit(""))), "id", "t", query, k).collect()]
            assert got == want, (query, k)


def test_ranges_below_the_threshold_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(i, "gold gold gold" if i < 3 else "gold " + "sand " * 60) for i in range(600)], "id long, t string")
    path = str(tmp_path / "ix")
    P.write_index(rows, "id", "t", path, 4)
    blocks = spark.read.parquet(f"{path}/blocks").filter("term = 'gold'")
    best = P.search(spark, path, "id", "bigint", "gold", 3)
    assert [r["id"] for r in best.collect()] == [0, 1, 2]
    least = min(r["score"] for r in best.collect())
    idf = least / blocks.agg(F.max("most")).first()[0]
    assert blocks.filter(F.col("most") * idf >= least - 1e-9).count() <= 3 < blocks.count() / 20
    assert blocks.filter(F.col("docs")[0]["impact"] != F.col("most")).count() == 0  # the greatest first


def test_empty_tables_and_an_index_for_each_state(spark, tmp_path):
    none = spark.createDataFrame([], "id long, t string")
    P.write_index(none, "id", "t", str(tmp_path / "none"))
    assert P.search(spark, str(tmp_path / "none"), "id", "bigint", "a", 5).collect() == []
    table = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a b")], "id long, t string").write.parquet(table)
    one = P.of_table(spark, table, "id", "t")
    assert P.of_table(spark, table, "id", "t") == one
    spark.createDataFrame([(2, "a c")], "id long, t string").write.mode("append").parquet(table)
    two = P.of_table(spark, table, "id", "t")
    assert two != one and {r["id"] for r in P.search(spark, two, "id", "bigint", "a", 5).collect()} == {1, 2}


def test_the_flagship_reads_no_text(spark):
    from loomlake.plans import registry

    plan = registry.queries()["k_hybrid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and "text" not in plan and "most:double" in plan


def test_an_index_is_written_with_one_exchange(spark, tmp_path, monkeypatch):
    """Words are counted in their rows; what is exchanged is a row a document and term, once."""
    from pyspark.sql import DataFrameWriter

    plans, put = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), put(self, path, *a, **k))[1])
    rows = spark.createDataFrame([(1, "b a B c b"), (2, None), (3, ""), (4, "b")], "id long, t string")
    got = {(r["term"], r["id"], r["tf"], r["dl"]) for r in S.postings(rows, "id", "t").collect()}
    assert got == {("a", 1, 1, 5), ("b", 1, 3, 5), ("c", 1, 1, 5), ("b", 4, 1, 1)}
    P.write_index(rows, "id", "t", str(tmp_path / "ix"))
    S.write_postings(rows, "id", "t", str(tmp_path / "ps"))
    written = {path: plan.count("Exchange hashpartitioning") for path, plan in plans if path.endswith(("blocks", "postings"))}
    assert sorted(written.values()) == [1, 1]
