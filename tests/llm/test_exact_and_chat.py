import hashlib
import re

from loomlake.llm import chat_format as C
from loomlake.llm.exact_dedup import exact_dedup

DOCS = "doc_id long, text string, lang string, _norm string"


def brute_exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i))
    out = []
    for norm, g in groups.items():
        best = min(g)
        out += [(i, best[1], len(g), i == best[1], hashlib.sha256(norm.encode()).hexdigest()) for _, i in g]
    return sorted(out)


def test_exact_dedup_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a\tb ", None, "", " \n", "Ünï ", "Ü nï", "x" * 5000, "x" * 4999 + " x", " ", "ab "] * 3)]
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], DOCS)
    assert sorted(map(tuple, exact_dedup(df).collect())) == brute_exact(rows)


def test_exact_dedup_of_nothing_and_of_repeated_rows(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    got = exact_dedup(spark.createDataFrame([(1, "a", "", ""), (1, "a", "", ""), (None, "a", "", "")], DOCS)).collect()
    assert len(got) == 3 and {r["group_size"] for r in got} == {3} and sum(r["kept"] for r in got) == 1


TURNS = "conv_id long, turn long, role string, text string, block string"


def brute_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def chat_rows():
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    odd = ["<|turn|>", "\\<|end|>", "<\\|", "\\\\", "[\\INST]", "[INST]\\", "", None, "<|text|>a<|", "é\n\n<s>", "<\\\\|\\"]
    rows += [(1, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], t) for i, t in enumerate(odd * 4)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"word{i} " * (i % 700)) for i in range(600)]
    rows += [(3, 0, "a\nb", "x"), (3, 0, "a\nb", "x"), (3, None, None, "y"), (None, 0, "assistant", "z"), (4, 0, "assistant", "w " * 9000)]
    return rows


def test_chat_reads_back(spark):
    rows = chat_rows()
    windows = C.chat_windows(spark.createDataFrame([(*r, "clash") for r in rows], TURNS))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.conversation_digests(windows).collect()}
    assert got == brute_chat(rows)


def test_chat_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, i, "system" if i == 0 else "assistant" if i % 2 else "user", "be brief" if i == 0 else "one two three " * (i * 7 % 90)) for i in range(300)]
    got = C.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=1024).orderBy("block", "window").collect()
    assert len(got) > 3 and sum(r["n_new"] for r in got) == 300
    assert all(r["n_tokens"] <= 1024 for r in got)
    assert all("be brief" in r["formatted"] for r in got)
    assert any(r["formatted"].count(C.CONTEXT) >= 2 for r in got[1:])
    for r in got:  # nothing of a repeated turn is a target
        for s in r["loss"]:
            assert r["formatted"].rfind(C.NEW, 0, s["start"]) > r["formatted"].rfind(C.CONTEXT, 0, s["start"])


def test_chat_keeps_long_system_turns_and_history_over_blocks(spark):
    """A system turn of 300 tokens starts every window, and the first window of a block repeats the turns before it."""
    say = "rule " * 300
    rows = [(1, i, "system" if i == 0 else "assistant" if i % 2 else "user", say if i == 0 else f"t{i} " + "one two " * 40) for i in range(60)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"no{i}e") for i in range(600)]
    rows += [(3, i, "system" if i == 0 else "user", "rule " * 1900 if i == 0 else f"short {i}") for i in range(9)]
    got = C.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "block", "window").collect()
    mine = [r for r in got if r["conv_id"] == 1]
    assert len(mine) > 2 and all(say in r["formatted"] and r["n_tokens"] <= C.BUDGET for r in mine) and sum(r["n_new"] for r in mine) == 60
    assert all("rule " * 1900 in r["formatted"] and r["n_tokens"] <= C.BUDGET for r in got if r["conv_id"] == 3)
    first = {r["block"]: r["formatted"] for r in got if r["conv_id"] == 2 and r["window"] == 1}
    for block, turn in ((1, 256), (2, 512)):
        parts = first[block].split(C.END)[:3]
        assert [p.split(C.TEXT)[1] for p in parts] == [f"no{turn - 2}e", f"no{turn - 1}e", f"no{turn}e"]
        assert parts[0].startswith(C.CONTEXT) and parts[1].startswith(C.CONTEXT) and parts[2].startswith(C.NEW)
    assert first[0].startswith(C.NEW)


def test_chat_of_nothing(spark):
    assert C.conversation_digests(C.chat_windows(spark.createDataFrame([], TURNS))).count() == 0


def test_the_first_system_turn_starts_every_window_without_it(spark):
    from loomlake.llm import chat_format

    turns = [(1, i, "system" if i in (0, 30) else ("user", "assistant")[i % 2], "FIRST rules" if i == 0 else "SECOND rules" if i == 30 else f"turn {i} " + "word " * 60) for i in range(60)]
    windows = chat_format.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(windows) > 3
    assert all(w["formatted"].count("FIRST rules") == 1 for w in windows)
    assert sum("SECOND rules" in w["formatted"] for w in windows) >= 1


def test_signs_without_blanks_between_words_count_one_by_one(spark):
    from pyspark.sql import functions as F

    from loomlake.llm import chat_format

    df = spark.createDataFrame([("漢" * 400,), ("かな" * 50,), ("abcdefgh" * 50,), ("漢a漢",)], "t string")
    got = [r[0] - chat_format.TURN_TOKENS for r in df.select(chat_format.tokens(F.col("t"))).collect()]
    assert got == [400, 100, 50, 3]


def test_exact_dedup_of_rows_that_share_ids_or_have_none(spark):
    from loomlake.llm import exact_dedup

    rows = [(None, "same text")] * 30 + [(7, "same  text")] * 30 + [(7, "x"), (None, "y"), (None, "y ")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), partitions=4).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r)
    assert sorted((len(g), {r["group_size"] for r in g}.pop(), sum(r["kept"] for r in g), {r["keep_id"] for r in g}.pop()) for g in groups.values() if len(g) != 2) == [(1, 1, 1, 7), (60, 60, 1, 7)]
    two = next(g for g in groups.values() if len(g) == 2)
    assert sum(r["kept"] for r in two) == 1 and {r["keep_id"] for r in two} == {None}
