"""Reads of turns by range, fills that must be whole."""

import pytest

from loomlake.operators import joining as J
from loomlake.operators import searching as S

CHUNK = "session_id string, source_identity string, seq long, turn_uuid string, block_idx long, split_idx long, role string, block_type string, text string"


def test_turns_by_range(spark):
    rows = [("s", "doc", k, f"t{k}", 0, 0, "user", "text", f"turn {k}") for k in range(5, 40)] + [("doc2", "s", 1, "x", 0, 0, "user", "text", "other")]
    chunks = spark.createDataFrame(rows, CHUNK)
    seqs = lambda *a, **k: sorted((r["seq"], r["total"]) for r in S.turn_range(chunks, *a, **k).collect())
    assert seqs("s") == [(k, 35) for k in range(5, 25)]  # the session comes before a document of that identity
    assert seqs("doc", first=30) == [(k, 35) for k in range(30, 40)]
    assert seqs("s", first=7, last=8) == [(7, 35), (8, 35)]
    assert seqs("s", last=6) == [(5, 35), (6, 35)] and seqs("nobody") == [] and seqs("s", first=100) == []


def test_fills_fail_where_counts_differ(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None)], "k int, v int")
    fill = lambda *values: sorted(map(tuple, J.filled_exactly(rows, spark.createDataFrame(list(values), "k int, v int"), "k", "v").collect()), key=str)
    assert fill((1, 7), (2, 8)) == [(1, 7), (2, 8), (3, None)]
    for bad in ([(1, 7), (9, 8)], [(1, 7), (1, 8)]):
        with pytest.raises(Exception, match="values, but"):
            fill(*bad)
