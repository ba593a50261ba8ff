"""Vendor transcripts as one frame: JSON lines of unknown shape, read by paths into the text of each line.

``session, message_id, role, content_type, text, ts, tool_name, source_path``: what each layout calls these differs,
so each is the first of several paths that a line has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import epoch_seconds

# Record types of the layouts, and what they are stored as.
CODEX_TYPES = {"message": None, "reasoning": "summary", "function_call": "tool_call", "custom_tool_call": "tool_call", "function_call_output": "tool_result", "custom_tool_call_output": "tool_result"}
CLAUDE_TYPES = {"user": "user_message", "assistant": "assistant_message", "system": "system", "summary": "summary"}
PI_ROLES = {"user": "user_message", "assistant": "assistant_message", "toolResult": "tool_result"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("source_path"))


def first_of(*paths: str) -> Column:
    """The first path of the line that holds something."""
    found = [F.get_json_object("value", f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(c != "", c) for c in found])


def content(*paths: str) -> Column:
    """Text of a content field: a string, or the texts of a list of parts, a line each."""
    parts = "array<struct<type:string,text:string,content:string>>"

    def one(path: str) -> Column:
        raw = F.get_json_object("value", f"$.{path}")
        listed = F.from_json(raw, parts)
        texts = F.filter(F.transform(listed, lambda p: F.coalesce(p["text"], p["content"])), lambda t: t.isNotNull() & (t != ""))
        return F.when(F.ltrim(raw).startswith("["), F.array_join(texts, "\n")).otherwise(raw)

    return F.coalesce(*[F.when(one(p) != "", one(p)) for p in paths])


def mapped(c: Column, names: dict[str, str | None], other: Column) -> Column:
    return reduce(lambda out, kv: out.when(c == kv[0], F.lit(kv[1])), [(k, v) for k, v in names.items() if v], F.when(F.lit(False), F.lit(""))).otherwise(other)


def timestamp(*paths: str) -> Column:
    """A stamp as text; numbers are seconds, or milliseconds where they are greater than 1e11."""
    raw = F.trim(first_of(*paths))
    number = raw.try_cast("double")
    at = F.date_format(F.timestamp_seconds(epoch_seconds(number)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(raw.rlike(r"^\d+(\.\d+)?$"), F.when(number > 0, at).otherwise("")).otherwise(F.coalesce(raw, F.lit("")))


def _with_session(rows: DataFrame, header: Column, found: Column) -> DataFrame:
    """Each file's session from its header lines, else the file's name."""
    h = rows.filter(header).groupBy("source_path").agg(F.min(found).alias("_session"))
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.jsonl$", "")
    return rows.join(h, "source_path", "left").withColumn("_session", F.coalesce("_session", stem))


def codex(lines: DataFrame) -> DataFrame:
    rows = _with_session(lines, first_of("type") == "session_meta", first_of("payload.id", "payload.session_id")).filter(first_of("type") == "response_item")
    kind = first_of("payload.type")
    is_out = kind.endswith("_output")
    role = F.when(is_out, "tool").otherwise(F.coalesce(first_of("payload.role"), F.lit("assistant")))
    name = F.when(role == "user", "user_message").otherwise("assistant_message")
    call = first_of("payload.id", "payload.call_id", "id")
    direction = F.when(is_out, F.concat(call, F.lit(":out"))).when(kind.endswith("_call"), F.concat(call, F.lit(":call"))).otherwise(call)
    body = content("payload.content", "payload.summary", "payload.arguments", "payload.input", "payload.output")
    out = rows.filter(kind.isin(list(CODEX_TYPES))).select(F.col("_session").alias("session"), direction.alias("message_id"), role.alias("role"), mapped(kind, CODEX_TYPES, name).alias("content_type"), body.alias("text"), timestamp("timestamp").alias("ts"), first_of("payload.name").alias("tool_name"), "source_path")
    return out.filter("text is not null")


def claude(lines: DataFrame) -> DataFrame:
    rows = _with_session(lines, first_of("sessionId").isNotNull(), first_of("sessionId"))
    kind = first_of("type")
    typed = kind.isin(list(CLAUDE_TYPES))
    shown = first_of("display")
    out = rows.select(
        F.coalesce(first_of("sessionId", "session_id"), F.col("_session")).alias("session"),
        first_of("uuid", "id").alias("message_id"),
        F.when(typed, F.coalesce(first_of("message.role", "role"), kind)).otherwise("user").alias("role"),
        F.when(typed, mapped(kind, CLAUDE_TYPES, kind)).otherwise("user_message").alias("content_type"),
        F.when(typed, content("message.content", "content", "summary")).otherwise(shown).alias("text"),
        timestamp("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("tool_name"),
        "source_path",
    )
    return out.filter("text is not null")


def pi(lines: DataFrame) -> DataFrame:
    rows = _with_session(lines, first_of("type") == "session", first_of("id", "sessionId")).filter(first_of("type") == "message")
    role = F.coalesce(first_of("message.role", "role"), F.lit(""))
    out = rows.select(F.col("_session").alias("session"), first_of("id", "message.id").alias("message_id"), F.when(role == "toolResult", "tool").otherwise(role).alias("role"), mapped(role, PI_ROLES, F.when(role != "", role).otherwise("message")).alias("content_type"), content("message.content", "message.text", "text").alias("text"), timestamp("timestamp", "message.timestamp").alias("ts"), first_of("message.toolName").alias("tool_name"), "source_path")
    return out.filter("text is not null")


def generic(lines: DataFrame) -> DataFrame:
    """Any JSON line with a text of some sort; the session is the file's where the line has none."""
    rows = _with_session(lines, first_of("session_id", "sessionId").isNotNull(), first_of("session_id", "sessionId"))
    out = rows.select(F.coalesce(first_of("session_id", "sessionId"), F.col("_session")).alias("session"), first_of("id", "uuid", "message_id").alias("message_id"), F.coalesce(first_of("role", "message.role"), F.lit("user")).alias("role"), F.lit("message").alias("content_type"), content("text", "content", "message.content", "prompt").alias("text"), timestamp("timestamp", "ts", "created_at").alias("ts"), first_of("name").alias("tool_name"), "source_path")
    return out.filter("text is not null")
