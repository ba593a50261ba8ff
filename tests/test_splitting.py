"""Splitting and stitching by built-in functions against the plain versions, and their cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomlake.operators import splitting as S


def prose(r, n):
    return " ".join("w" * r.randint(1, 12) + ("\n" if r.random() < 0.05 else "") for _ in range(n // 8))


def plain_stitch(parts):
    out = parts[0] if parts else ""
    for p in parts[1:]:
        out = S.joined(out, p)
    return out


def test_pieces_and_their_joining(spark):
    r = random.Random(1)
    texts = ["", "  ", "a" * 5000, prose(r, 3000), prose(r, 200_000), "é😀 " * 3000, "x" * 1200, "x" * 1201, "\n" * 2000 + "a" + " " * 1300 + "b", "ab" * 4000, *(prose(r, r.randint(1000, 9000)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.split_text(F.col("t")).alias("p"))
    for row in df.withColumn("whole", S.stitched(F.col("p"))).collect():
        want = S.pieces(texts[row["i"]])
        assert row["p"] == want and row["whole"] == plain_stitch(want)


def test_stitching_of_any_parts(spark):
    r = random.Random(2)
    cases = [["".join(r.choices("ab", k=r.randint(0, 6))) for _ in range(r.randint(0, 300))] for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, p array<string>").select("i", S.stitched(F.col("p")).alias("w")).collect()
    for row in got:
        assert row["w"] == plain_stitch(cases[row["i"]])


def test_no_python_in_the_plans(spark):
    from loomlake.plans import registry

    for name in ("a_stitch", "a_turns", "t_chunks", "t_document_chunks"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


@pytest.mark.parametrize("step", ["split", "stitch"])
def test_cost_grows_with_the_text(spark, step):
    r = random.Random(3)
    took = []
    for n in (1_250_000, 5_000_000):
        df = spark.createDataFrame([(prose(r, n),)], "t string").select(S.split_text(F.col("t")).alias("p") if step == "split" else F.col("t"))
        df = (df if step == "split" else df.select(S.split_text(F.col("t")).alias("p")).cache()).select(F.size("p") if step == "split" else F.char_length(S.stitched(F.col("p"))))
        df.collect()
        t = time.perf_counter()
        df.collect()
        took.append(time.perf_counter() - t)
    assert took[1] < 8 * took[0] + 1 and took[1] < 15


def test_turns_of_blocks_in_order(spark):
    body = prose(random.Random(4), 6000).strip()
    rows = [("s", 1, "t1", k, "user", "text", None, f"{k} {body}") for k in range(12)] + [("s", 2, "t2", 0, "assistant", "tool_use", "x", "y")]
    blocks = spark.createDataFrame(rows, "session_id string, seq long, turn_uuid string, block_idx long, role string, block_type string, tool_name string, text string")
    got = {t["seq"]: t for t in S.turns_of(S.chunks(blocks).orderBy(F.rand(1))).collect()}
    assert [b["text"] for b in got[1]["blocks"]] == [f"{k} {body}" for k in range(12)] and got[1]["role"] == "user"
    assert [(b["block_type"], b["text"]) for b in got[2]["blocks"]] == [("tool_use", "[tool_use x] y")]
