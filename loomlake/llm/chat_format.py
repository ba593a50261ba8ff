"""Chat formatting into budgeted, turn-aligned training windows, in DataFrame operations only.

Prefix sums of turn tokens choose the spans: a turn of more than half the room of a window stands alone, the others go
where the sum before them falls on a grid of half that room, so a window never exceeds its budget unless one turn does
by itself. Every window starts with the conversation's system turn, however long, and a limited history of turns
before it; a system turn of more than its share takes the rest from the window's room. Both are context, outside the loss mask, so that each assistant text is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window; of these for the system turn (a longer one takes more) and for repeated history at most; and those of a turn's markers.
BUDGET, SYSTEM_BUDGET, HISTORY_BUDGET, HISTORY_TURNS, TURN_TOKENS = 2048, 256, 256, 2, 4
#: Turns of a conversation that are laid out together; a longer one goes on in the next block.
BLOCK_TURNS = 256

#: The template's markers: a new turn, a repeated one, the start of its text, its end.
NEW, CONTEXT, TEXT, END = "<|turn|>", "<|context|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    """Doubles backslashes, then breaks up every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``)
    by a single backslash after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=\||/?s>)|\[(?=/?INST\])", "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(<|\[)\\(?=\||/?s>|/?INST\])", "$1"), F.lit("\\\\"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Pieces of up to eight letters, single digits, letters of scripts that put no blanks between words one by one,
    and up to four signs: the estimate of a turn's tokens. A long run counts by its length."""
    alone = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
    return F.regexp_count(text, F.lit(rf"[\p{{L}}&&[^{alone}]]{{1,8}}|[\p{{L}}&&[{alone}]]|\p{{N}}|[^\s\p{{L}}\p{{N}}]{{1,4}}")) + F.lit(TURN_TOKENS)


def _segment(marker: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(marker), role, F.lit(TEXT), text, F.lit(END))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: ``conv_id, block, window, formatted, loss, n_new, n_tokens``.

    ``turns`` has ``conv_id, turn, role, text`` (other columns are ignored); ``loss`` is an array of (start, end) code
    points of ``formatted``, end exclusive. Null texts and roles are empty, a null turn number sorts last, a null
    conversation id is a conversation of its own; equal turn numbers are ordered by role and text, repeated rows are
    turns of their own. ``block`` and ``window`` order a conversation's windows. An empty table gives no rows.
    """
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    base = base.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(1 << 40)))
    system = base.filter("_role = 'system'").groupBy("conv_id").agg(F.min(F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), F.col("_text").alias("x"))).alias("_first_system"))
    system = system.select(F.col("conv_id").alias("_c"), "_first_system", escaped(F.col("_first_system.x")).alias("_sys"), tokens(F.col("_first_system.x")).alias("_sys_t"))
    left = F.lit(budget) - F.greatest(F.lit(SYSTEM_BUDGET), F.coalesce("_sys_t", F.lit(0)))
    most = F.greatest(F.lit(0), F.least(F.lit(HISTORY_BUDGET), F.floor(left / 2)))
    laid = base.select("*", tokens(F.col("_text")).alias("_t"), escaped(F.col("_role")).alias("_r"), escaped(F.col("_text")).alias("_x"))
    long = system.filter(F.col("_sys_t") > SYSTEM_BUDGET).select("_c", "_sys_t")
    rows = laid.join(long, F.col("conv_id").eqNullSafe(F.col("_c")), "left").withColumn("_half", F.greatest(F.lit(1), F.floor((left - most) / 2))).drop("_c", "_sys_t")
    order = [F.col("turn").asc_nulls_last(), "_role", "_text"]
    w = Window.partitionBy("conv_id", "block").orderBy(*order)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_at", F.row_number().over(w))
    rows = rows.withColumn("_large", F.col("_t") > F.col("_half")).withColumn("_grid", F.floor(F.col("_before") / F.col("_half")))
    starts = F.col("_large") | F.coalesce(F.lag("_large").over(w), F.lit(True)) | (F.lag("_grid").over(w) != F.col("_grid"))
    rows = rows.withColumn("_starts", starts)
    turn = F.struct("_r", "_x", "_t", "_role")
    past = F.filter(F.array(*[F.lag(turn, k).over(w) for k in range(history_turns, 0, -1)]), lambda x: x.isNotNull()) if history_turns else F.array().cast("array<struct<_r:string,_x:string,_t:int,_role:string>>")
    rows = rows.select("*", F.sum(F.col("_starts").cast("int")).over(w).alias("window"), F.when(F.col("_starts"), past).alias("_past"))
    # the last turns of the blocks before, where a conversation has several
    spans = base.groupBy("conv_id").agg(F.min("block").alias("_least"), F.max("block").alias("_most")).filter("_least < _most").select(F.col("conv_id").alias("_c"))
    back = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").desc_nulls_first(), F.desc("_role"), F.desc("_text"))
    tails = laid.join(spans, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= max(1, history_turns))
    tails = tails.groupBy("conv_id", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), turn.alias("turn")))), lambda x: x["turn"]).alias("_tail"))
    blocks = Window.partitionBy("conv_id").orderBy("block")  # one row for BLOCK_TURNS turns
    before = F.flatten(F.filter(F.array(*[F.lag("_tail", k).over(blocks) for k in range(max(1, history_turns), 0, -1)]), lambda x: x.isNotNull()))
    before = tails.select(F.col("conv_id").alias("_pc"), F.col("block").alias("_pb"), before.alias("_prior")).filter(F.size("_prior") > 0)
    windows = rows.groupBy("conv_id", "block", "window").agg(
        F.sort_array(F.collect_list(F.struct("_at", F.col("_role").eqNullSafe("assistant").alias("target"), F.col("_role").eqNullSafe("system").alias("system"), _segment(NEW, F.col("_r"), F.col("_x")).alias("s"), (F.char_length("_r") + len(NEW) + len(TEXT)).alias("lead"), F.char_length("_x").alias("n")))).alias("_new"),
        F.first("_past", ignorenulls=True).alias("_past"),
        F.min(F.when(F.col("_role") == "system", F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), F.col("_text").alias("x")))).alias("_own_system"),
        F.sum("_t").alias("_new_t"),
    )
    joined = windows.join(system, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    joined = joined.join(before, F.col("conv_id").eqNullSafe(F.col("_pc")) & (F.col("block") == F.col("_pb")), "left")
    recent = F.when(F.col("_prior").isNull(), F.col("_past")).otherwise(F.concat("_prior", "_past"))
    joined = joined.withColumn("_recent", F.slice(F.reverse(recent), 1, history_turns)).withColumn("_most", most)
    # history: from the nearest turn back while the sum fits, without the system turn that comes first anyway
    total = lambda k: F.aggregate(F.slice("_recent", 1, k + 1), F.lit(0), lambda a, x: a + x["_t"])
    fits = F.filter("_recent", lambda x, k: (total(k) <= F.col("_most")) & ~((x["_role"] == "system") & (x["_x"] == F.col("_sys"))))
    joined = joined.withColumn("_history", F.transform(F.reverse(fits), lambda x: F.struct(_segment(CONTEXT, x["_r"], x["_x"]).alias("s"), x["_t"].alias("t"))))
    # the retained turn comes first wherever the window doesn't hold that very turn, other system turns or not
    with_system = F.col("_sys").isNotNull() & ~F.col("_own_system").eqNullSafe(F.col("_first_system"))
    head = F.concat(F.when(with_system, _segment(CONTEXT, F.lit("system"), F.col("_sys"))).otherwise(F.lit("")), F.array_join(F.transform("_history", lambda h: h["s"]), ""))
    joined = joined.withColumn("_head", head)
    zero = F.struct(F.char_length("_head").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, seg: Column) -> Column:
        start = acc["at"] + seg["lead"]
        span = F.struct(start.cast("long").alias("start"), (start + seg["n"]).cast("long").alias("end"))
        return F.struct((acc["at"] + F.char_length(seg["s"])).cast("long").alias("at"), F.when(seg["target"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return joined.select(
        "conv_id", "block", "window",
        F.concat("_head", F.array_join(F.transform("_new", lambda s: s["s"]), "")).alias("formatted"),
        F.aggregate("_new", zero, step, lambda acc: acc["spans"]).alias("loss"),
        F.size("_new").alias("n_new"),
        (F.col("_new_t") + F.when(with_system, F.col("_sys_t")).otherwise(F.lit(0)) + F.coalesce(F.aggregate("_history", F.lit(0), lambda a, h: a + h["t"]), F.lit(0))).cast("long").alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets parsed out of the formatted windows: ``conv_id, block, window, formatted, turns, targets``.

    ``turns``: array of (role, text) of the new turns in order; ``targets``: the unescaped texts under the loss mask.
    """
    parts = F.split("formatted", r"<\|", -1)
    number = F.floor((F.size(parts) - 1) / 3).cast("int")
    triple = F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(F.element_at("_parts", i * 3 + 2).alias("head"), F.element_at("_parts", i * 3 + 3).alias("body")))).otherwise(F.array().cast("array<struct<head:string,body:string>>"))
    new, text = NEW[2:], TEXT[2:]
    turns = F.transform(F.filter("_triples", lambda t: t["head"].startswith(new)), lambda t: F.struct(unescaped(F.substr(t["head"], F.lit(len(new) + 1))).alias("role"), unescaped(F.substr(t["body"], F.lit(len(text) + 1))).alias("text")))
    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.withColumn("_parts", parts).withColumn("_triples", triple).select("conv_id", "block", "window", "formatted", turns.alias("turns"), targets.alias("targets"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: the columns of query ``op3_chat_format``."""
    back = read_back(windows).select("conv_id", "block", "window", F.size("turns").cast("long").alias("_n"), F.char_length("formatted").cast("long").alias("_f"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("_turns"), F.array_join("targets", "").alias("_loss"))
    grouped = back.groupBy("conv_id").agg(F.sum("_n").alias("n_turns"), F.sum("_f").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("block", "window", "_turns", "_loss"))).alias("_w"))
    loss = F.array_join(F.transform("_w", lambda w: w["_loss"]), "")
    return grouped.withColumn("_l", loss).select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("_w", lambda w: w["_turns"]), ""), 256).alias("turns_sha256"), F.char_length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), "formatted_chars")
