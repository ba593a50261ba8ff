"""The seams: scanners that fail closed, and layouts of logs told from their lines."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomlake.operators import scanning as C
from loomlake.sources import opening as O
from loomlake.sources import transcripts as X

KEY = "AKIA" + "Q" * 16


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, t string")


def test_findings_are_taken_out(spark):
    def scanner(texts):
        out = []
        for t in texts:
            found = [("A", "secret-1", "PLAIN")] * t.count("secret-1") + [("B", "secret-12", "PLAIN")] * ("secret-12" in t)
            found += [("C", "hidden", "BASE64")] * ("aGlkZGVu" in t) + [("D", "nowhere", "PLAIN")] * ("lost" in t) + [("E", "secret-1", "PLAIN")] * ("twice" in t and "secret-1" in t)
            out.append(found)
        return out

    df = frame(spark, "a secret-1 b secret-12 c secret-1", "clean", None, "aGlkZGVu secret-1", "lost", "twice secret-1")
    got = {r["i"]: (r["t"], r["removed"], r["held"]) for r in C.excised(df.withColumn("findings", C.scan(F.col("t"), scanner)), "t").collect()}
    assert got[0] == ("a [REDACTED:A] b [REDACTED:B] c [REDACTED:A]", ["B", "A"], False)
    assert got[1] == ("clean", [], False) and got[2] == ("", [], False)
    assert got[3][0] is None and got[3][2] and got[4][0] is None and got[4][2]
    assert got[5] == ("twice [REDACTED:A]", ["A"], False)


@pytest.mark.parametrize("scanner", [lambda t: [[]] * (len(t) - 1), lambda t: [], lambda t: None, lambda t: [[]] * (len(t) + 1), lambda t: [None] * len(t), lambda t: [[("A", "", "PLAIN")]] * len(t), lambda t: 1 / 0])
def test_a_scanner_that_fails_lets_nothing_pass(spark, scanner):
    with pytest.raises(Exception, match="ScanError|ZeroDivision|clean|findings"):
        frame(spark, "a", "b").withColumn("findings", C.scan(F.col("t"), scanner)).collect()


def test_the_built_in_scanner(spark):
    df = frame(spark, f"x {KEY} y", 'password = "' + "0af1" * 8 + '"', "nothing").withColumn("findings", C.scan(F.col("t"), C.pattern_scanner))
    got = {r["i"]: r["t"] for r in C.excised(df, "t").collect()}
    assert got == {0: "x [REDACTED:AWS] y", 1: 'password = "[REDACTED:Assignment]"', 2: "nothing"}


def write(folder, name, *lines, at=None):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    if at:
        os.utime(path, (at, at))


def logs(folder):
    turn = {"format": 1, "session_id": "t", "turn_uuid": "t1", "seq": 1, "ts": "2026-01-01T00:00:00Z", "role": "user", "harness": "codex", "blocks": [{"block_type": "text", "text": "own"}]}
    write(folder, "own.jsonl", turn, at=5)
    write(folder, "a/codex.jsonl", {"type": "session_meta", "payload": {"id": "c"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "codex says"}}, at=4)
    write(folder, "b/claude.jsonl", {"type": "user", "sessionId": "l", "uuid": "u", "message": {"role": "user", "content": "claude says"}}, at=3)
    write(folder, "pi.jsonl", {"type": "session", "id": "p"}, {"type": "message", "id": "m", "message": {"role": "user", "content": "pi says"}}, at=2)
    write(folder, "any.jsonl", "", {"text": "any says", "id": 7}, at=1)


def test_layouts_are_told_from_lines(spark, tmp_path):
    logs(str(tmp_path))
    got = {r["layout"]: (r["session"], r["text"]) for r in O.open_logs(spark, str(tmp_path)).collect()}
    assert got == {"turns": ("t", "own"), "codex": ("c", "codex says"), "claude": ("l", "claude says"), "pi": ("p", "pi says"), "generic": ("any", "any says")}
    assert sorted(r["layout"] for r in O.open_logs(spark, str(tmp_path), limit=2).collect()) == ["codex", "turns"]


def test_unknown_files_are_refused_or_left_out(spark, tmp_path):
    logs(str(tmp_path))
    write(str(tmp_path), "bad.jsonl", "{broken", {"n": 1})
    with pytest.raises(ValueError, match="bad.jsonl"):
        O.open_logs(spark, str(tmp_path))
    assert O.open_logs(spark, str(tmp_path), strict=False).count() == 5


def test_no_files(spark, tmp_path):
    assert O.open_logs(spark, str(tmp_path / "absent")).collect() == []
    (tmp_path / "empty").mkdir()
    assert O.open_logs(spark, str(tmp_path / "empty")).collect() == []


def test_a_layout_can_be_added(spark, tmp_path):
    write(str(tmp_path), "x.jsonl", {"text": "generic too", "colour": "red"})
    read = lambda lines: X.generic(lines).withColumn("text", F.upper("text"))
    before = dict(O._LAYOUTS)
    try:
        O.register(O.Layout("colours", lambda: X.first_of("colour").isNotNull(), read))
        assert [(r["layout"], r["text"]) for r in O.open_logs(spark, str(tmp_path)).collect()] == [("colours", "GENERIC TOO")]
    finally:
        O._LAYOUTS.clear()
        O._LAYOUTS.update(before)
