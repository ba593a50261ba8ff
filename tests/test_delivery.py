"""Delivery through a queue: refused batches wait and arrive, nothing is lost on a restart, batches stay in bounds."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from loomlake.streaming import delivery as D


def sink_into(folder, refuse=None, die=None):
    """Writes each batch to a file; refuses what ``refuse`` is in as long as the file ``folder/refuse`` exists."""

    def sink(payloads):
        if refuse and os.path.exists(os.path.join(folder, "refuse")) and any(refuse in p for p in payloads):
            raise ConnectionError("not now " + "x" * 2000)
        with open(os.path.join(folder, f"{uuid.uuid4().hex}.json"), "w", encoding="utf-8") as f:
            json.dump(payloads, f)

    return sink


def batches(folder):
    out = []
    for n in os.listdir(folder):
        if n.endswith(".json"):
            with open(os.path.join(folder, n), encoding="utf-8") as f:
                out.append(json.load(f))
    return out


def arrived(folder):
    return sorted(p for b in batches(folder) for p in b)


class Stage:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.options, self.now = spark, options, [1000.0]
        self.dir = {n: str(tmp_path / n) for n in ("in", "queue", "check", "out")}
        os.makedirs(self.dir["in"])
        os.makedirs(self.dir["out"])

    def come(self, *rows):
        part = self.spark.createDataFrame(list(rows) or [(None, None)], "id string, payload string")
        part.coalesce(1).write.mode("append").parquet(self.dir["in"])

    def run(self, sink):
        stream = self.spark.readStream.schema("id string, payload string").option("maxFilesPerTrigger", 1).parquet(self.dir["in"])
        q = D.deliver(stream, sink, self.dir["queue"], self.dir["check"], lambda: self.now[0], **self.options).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if q.exception():
            raise q.exception()

    def waiting(self):
        return {r["id"]: (r["attempts"], r["next_at"], r["error"]) for r in D.pending(self.spark, self.dir["queue"]).collect()}


def test_a_refused_batch_waits_and_arrives_once(spark, tmp_path):
    s = Stage(spark, tmp_path, lanes=2)
    sink = sink_into(s.dir["out"], refuse="bad")
    open(os.path.join(s.dir["out"], "refuse"), "w").close()
    s.come(*[(f"i{k}", f"good {k}") for k in range(20)])
    s.run(sink)
    assert arrived(s.dir["out"]) == sorted(f"good {k}" for k in range(20)) and s.waiting() == {}
    s.come(("b1", "bad 1"))
    waits = []
    for attempt in range(1, 9):  # 30 seconds, doubled each time, an hour at most
        s.run(sink)
        attempts, at, error = s.waiting()["b1"]
        assert attempts == attempt and error.startswith("ConnectionError: not now") and len(error) <= D.ERROR
        waits.append(at - s.now[0])
        s.come()
        s.now[0] = at - 1
        s.run(sink)  # too early: nothing is tried
        assert s.waiting()["b1"][0] == attempt
        s.now[0] = at
        s.come()
    assert waits == [30, 60, 120, 240, 480, 960, 1920, 1920]
    os.remove(os.path.join(s.dir["out"], "refuse"))
    s.run(sink)
    assert s.waiting() == {} and arrived(s.dir["out"]).count("bad 1") == 1
    s.come()
    s.run(sink)
    assert arrived(s.dir["out"]).count("bad 1") == 1


def test_a_micro_batch_that_fails_behind_the_sink_is_sent_again(spark, tmp_path, monkeypatch):
    s = Stage(spark, tmp_path, lanes=1)
    sink = sink_into(s.dir["out"])
    s.come(("a", "one"), ("b", "two"))
    real = D.cycle

    def breaks(*args, **kwargs):
        real(*args, **kwargs).collect()  # everything is sent, and then the snapshot is never written
        raise RuntimeError("lost")

    monkeypatch.setattr(D, "cycle", breaks)
    with pytest.raises(Exception, match="lost"):
        s.run(sink)
    monkeypatch.setattr(D, "cycle", real)
    s.run(sink)
    assert set(arrived(s.dir["out"])) == {"one", "two"} and s.waiting() == {}
    s.come(("c", "three"))
    s.run(sink)
    assert arrived(s.dir["out"]).count("three") == 1


def test_batches_are_bounded(spark, tmp_path):
    s = Stage(spark, tmp_path, lanes=3, most_bytes=100, most_rows=4)
    rows = [(f"i{k}", "é" * (k % 30)) for k in range(60)] + [("long", "x" * 500)]
    s.come(*rows)
    s.run(sink_into(s.dir["out"]))
    assert arrived(s.dir["out"]) == sorted(p for _, p in rows)
    for b in batches(s.dir["out"]):
        assert len(b) <= 4 and (len(b) == 1 or sum(len(p.encode()) + 1 for p in b) <= 100)
    assert len(batches(s.dir["out"])) >= 61 / 4


def test_a_later_row_takes_the_place_of_a_waiting_one(spark, tmp_path):
    s = Stage(spark, tmp_path, lanes=1)
    sink = sink_into(s.dir["out"], refuse="bad")
    open(os.path.join(s.dir["out"], "refuse"), "w").close()
    s.come(("a", "bad old"))
    s.run(sink)
    s.come(("a", "new"), ("a", "new"))
    s.run(sink)
    assert arrived(s.dir["out"]) == ["new"] and s.waiting() == {}


def test_first_batch_of_a_lane(spark):
    rows = [(k % 3, k, "x" * (k * 7 % 40)) for k in range(90)]
    got = D.batched(spark.createDataFrame(rows, "lane int, k int, payload string"), "lane", ["k"], 120, 8).collect()
    for lane in range(3):
        want, size = [], 0
        for _, k, p in sorted(r for r in rows if r[0] == lane):
            if want and (size + len(p) + 1 > 120 or len(want) >= 8):
                break
            want.append(k)
            size += len(p) + 1
        assert sorted(r["k"] for r in got if r["lane"] == lane) == want
    assert D.batched(spark.createDataFrame([(0, 0, "y" * 500)], "lane int, k int, payload string"), "lane", ["k"], 10).count() == 1


def test_ticks_have_no_ids(spark):
    t = D.ticks(spark)
    assert t.isStreaming and t.columns == ["id", "payload"] and F is not None
