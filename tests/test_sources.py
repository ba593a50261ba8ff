"""Vendor transcripts, vectors and gates, from literal rows."""

import json

import numpy as np

from loomlake.operators import searching, vectors
from loomlake.sources import transcripts as X


def lines(spark, tmp_path, name, objects):
    (tmp_path / f"{name}.jsonl").write_text("\n".join(o if isinstance(o, str) else json.dumps(o) for o in objects) + "\n")
    return X.read_lines(spark, str(tmp_path))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_codex(spark, tmp_path):
    df = X.codex(
        lines(
            spark,
            tmp_path,
            "a",
            [
                {"type": "session_meta", "payload": {"id": "S1", "cwd": "/x"}},
                {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}, {"type": "input_text", "text": "you"}]}},
                {"type": "response_item", "payload": {"type": "function_call", "name": "ls", "call_id": "c1", "arguments": "{}"}},
                {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "done"}},
                {"type": "response_item", "payload": {"type": "unknown"}},
                "{broken",
                {"type": "event_msg"},
            ],
        )
    )
    assert rows(df, "session", "content_type", "role", "text") == [("S1", "tool_call", "assistant", "{}"), ("S1", "tool_result", "tool", "done"), ("S1", "user_message", "user", "hi\nyou")]
    assert {r["message_id"] for r in df.collect()} == {None, "c1:call", "c1:out"}


def test_claude(spark, tmp_path):
    df = X.claude(
        lines(
            spark,
            tmp_path,
            "file1",
            [
                {"type": "user", "sessionId": "S2", "uuid": "u1", "message": {"role": "user", "content": "hello"}},
                {"type": "summary", "summary": "short"},
                {"display": "shown", "timestamp": 1767225600000},
                {"type": "other"},
            ],
        )
    )
    assert rows(df, "session", "content_type", "text", "ts") == [("S2", "summary", "short", ""), ("S2", "user_message", "hello", ""), ("S2", "user_message", "shown", "2026-01-01T00:00:00Z")]


def test_pi_and_generic(spark, tmp_path):
    ls = lines(spark, tmp_path, "name", [{"type": "session", "id": "S3"}, {"type": "message", "id": "m", "message": {"role": "toolResult", "content": "out", "toolName": "ls"}}])
    assert rows(X.pi(ls), "session", "role", "content_type", "text", "tool_name") == [("S3", "tool", "tool_result", "out", "ls")]
    (tmp_path / "name.jsonl").write_text(json.dumps({"text": "free", "role": "assistant", "created_at": "x"}) + "\n[]\n")
    assert rows(X.generic(X.read_lines(spark, str(tmp_path))), "session", "role", "text", "ts") == [("name", "assistant", "free", "x")]


def test_stored_vectors_are_used_again(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "k int, body string")
    stored = spark.createDataFrame([(1, "a b", [7.0]), (2, "changed", [8.0])], "k int, body string, vector array<float>")
    got = {r["k"]: r["vector"] for r in vectors.with_reuse(df, stored, "k", "body").collect()}
    assert got[1] == [7.0] and len(got[2]) == vectors.DIM and len(got[3]) == vectors.DIM
    assert np.allclose(got[2], vectors.hash_embedder(["c"])[0])


def test_cells_hold_all_rows(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(60)], "k int, v array<float>")
    centres = vectors.centres_of(df, "v", 5)
    got = vectors.cells(df, "k", "v", centres).collect()
    assert len(got) == 60
    for x in got:
        assert x["cell"] == int(((np.array(x["v"]) - centres) ** 2).sum(1).argmin())


def _recall(spark, rows, queries, **options):
    """Share of the exact nearest ten of each query that the index finds."""
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"k": [k for k, _ in rows], "v": [v.tolist() for _, v in rows]}), "k long, v array<float>")
    index = vectors.ProductIndex.fit(df, "v")
    got = vectors.index_search(vectors.coded(df, "k", "v", index), "k", "v", df.filter(f"k in ({', '.join(map(str, queries))})"), index, **options).collect()
    x, keys = np.stack([v for _, v in rows]), np.array([k for k, _ in rows])
    share = []
    for q in queries:
        d = ((x - x[keys == q][0]) ** 2).sum(1)
        exact = keys[np.lexsort((keys, np.round(d, 9)))][:10].tolist()
        mine = [r["k"] for r in sorted(got, key=lambda r: r["distance"]) if r["query"] == q]
        assert len(mine) == len(set(mine)) == len(exact) and mine[0] == q
        share.append(len(set(mine) & set(exact)) / len(exact))
    return sum(share) / len(share)


def test_index_search_finds_what_is_near(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(1500, 32)).astype(np.float32))]
    assert _recall(spark, rows, range(0, 1500, 100)) >= 0.9
    # parts of rows and of queries give the same as whole cells
    assert _recall(spark, rows, range(0, 1500, 100), part_rows=40, part_queries=4) >= 0.9


def test_index_search_with_every_cell_and_row_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(200, 8)).astype(np.float32))]
    assert _recall(spark, rows, [0, 100], probes=16, refine=20) == 1.0


def test_index_search_of_copies_nulls_and_nothing(spark):
    schema = "k long, v array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 1.0]), (4, [0.0, 1.0])], schema)
    index = vectors.ProductIndex.fit(df, "v", k=2)
    got = vectors.index_search(vectors.coded(df, "k", "v", index), "k", "v", df, index, limit=2)
    assert sorted((r["query"], r["k"], r["distance"]) for r in got.collect()) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 0.0), (4, 1, 2.0), (4, 4, 0.0)]
    none = spark.createDataFrame([], schema)
    index = vectors.ProductIndex.fit(none, "v")
    assert vectors.index_search(vectors.coded(none, "k", "v", index), "k", "v", df, index).collect() == []


def test_the_registered_index_search_against_brute_force(spark):
    from loomlake.plans import registry

    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, keys = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    got = {(r["query"], r["vec_id"]) for r in registry.queries()["k_ivfpq"](spark, sf_dir).collect()}
    asked = keys[keys % 100 == 0]
    exact = {(q, k) for q in asked for k in keys[np.lexsort((keys, np.round(((x - x[keys == q][0]) ** 2).sum(1), 9)))][:10]}
    assert len(got) == len(exact) == 10 * len(asked) and len(got & exact) >= 0.9 * len(exact)


def test_batches_keep_both_bounds(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 50, 1, 1, 1, 1])], "g string, k int, t long")
    got = [r["batch"] for r in searching.greedy_batches(df, "g", "k", "t", 3, 11).orderBy("k").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 4]


def test_entities(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(searching.query_entities(F.lit("see foo_bar/, x9 and plain Foo_Bar")).alias("e"))
    assert df.first()["e"] == ["foo_bar", "x9"]
    has = lambda t: df.select(searching.has_entities(F.lit(t), F.col("e"))).first()[0]
    assert has("X9 or (foo_bar)") and not has("x9 foo_bars") and not has("x9")
