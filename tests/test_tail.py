"""The tail of growing files against a full reading of the same files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomlake.sources import tail as X


def on_disk(folder):
    out = []
    for top, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".jsonl"):
                with open(os.path.join(top, n), "rb") as f:
                    at = 0
                    for line in f:
                        if line.endswith(b"\n") and line.strip(b"\r\n"):
                            out.append((os.path.relpath(os.path.join(top, n), folder), at, line.rstrip(b"\r\n").decode()))
                        at += len(line)
    return sorted(out)


def append(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(text)


def replace(path, text):
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".new", path)


@pytest.fixture
def places(tmp_path):
    for n in ("in", "out", "check"):
        (tmp_path / n).mkdir()
    return [str(tmp_path / n) for n in ("in", "out", "check")]


def kept(spark, out):
    return sorted((r["source"], r["offset"], r["line"]) for r in X.current(spark.read.parquet(f"{out}/part=*")).collect())


def test_growing_replaced_and_half_written_files(spark, places):
    folder, out, check = places
    a, b, c = (os.path.join(folder, n) for n in ("a.jsonl", "deep/b.jsonl", "c.jsonl"))
    append(a, "one\ntwo\nthr")
    append(b, "eins\r\n\r\nzwei é\n")
    append(os.path.join(folder, "note.txt"), "no\n")
    q = X.keep_lines(X.tail(spark, folder), out, check).start()
    try:
        q.processAllAvailable()
        assert kept(spark, out) == on_disk(folder) and len(on_disk(folder)) == 4  # "thr" waits
        append(a, "ee\nfour\n")
        append(c, "")
        q.processAllAvailable()
        assert kept(spark, out) == on_disk(folder)
        replace(b, "neu\n")
        append(c, "x\ny")
        q.processAllAvailable()
        assert kept(spark, out) == on_disk(folder)
        modes = {(r["source"], r["mode"]) for r in spark.read.parquet(f"{out}/part=*").filter("batch >= 2").collect()}
        assert ("deep/b.jsonl", "full") in modes and ("a.jsonl", "full") not in modes
        with open(a, "r+", encoding="utf-8") as f:  # cut short in place
            f.truncate(4)
        q.processAllAvailable()
        assert kept(spark, out) == on_disk(folder)
    finally:
        q.stop()
    # what comes while the stream is down, and a restart from its checkpoint
    append(a, "after\n")
    append(c, "z\n")
    before = spark.read.parquet(f"{out}/part=*").count()
    q = X.keep_lines(X.tail(spark, folder), out, check).start()
    try:
        q.processAllAvailable()
        assert kept(spark, out) == on_disk(folder)
        assert spark.read.parquet(f"{out}/part=*").count() == before + 2  # nothing is read twice
    finally:
        q.stop()


def test_random_growth_equals_a_full_reading(spark, places):
    folder, out, check = places
    r = random.Random(7)
    q = X.keep_lines(X.tail(spark, folder), out, check).start()
    try:
        for _ in range(6):
            for _ in range(8):
                path = os.path.join(folder, f"f{r.randrange(4)}.jsonl")
                text = "".join(r.choice(["ab", "é", "\n", "line\n", "long " * 50, "\r\n"]) for _ in range(r.randint(1, 12)))
                if r.random() < 0.15:
                    replace(path, text)
                else:
                    append(path, text)
            q.processAllAvailable()
            assert kept(spark, out) == on_disk(folder)
    finally:
        q.stop()


def test_last_line_break_is_found_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    path = str(tmp_path / "x")
    for text in ("", "abc", "a\nbcdefghij", "a\nb\n", "\n", "abcdefgh\nijklmnop\nq"):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        for start in range(len(text) + 1):
            want = text.rfind("\n", start) + 1
            assert X.complete_until(path, start, len(text)) == max(start, want)


def test_turns_and_bad_lines(spark, places):
    folder, out, check = places
    good = {"format": 1, "session_id": "s1", "turn_uuid": "t1", "seq": 1, "ts": "2026-01-01T00:00:00Z", "role": "user", "harness": "codex", "blocks": [{"block_type": "text", "text": "hi"}]}
    append(os.path.join(folder, "a.jsonl"), json.dumps(good) + "\n{broken\n" + json.dumps(good | {"session_id": "a:b"}) + "\n")
    q = X.turns(X.tail(spark, folder)).writeStream.format("memory").queryName("tail_turns").option("checkpointLocation", check).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("tail_turns").orderBy("offset").collect()
    assert [g["valid"] for g in got] == [True, False, False]
    assert got[0]["session_id"] == "s1" and got[0]["blocks"][0]["text"] == "hi" and got[1]["session_id"] is None
    assert spark.table("tail_turns").agg(F.count("source")).first()[0] == 3
