"""Predicates and projections as typed Column expressions: they reach the scan, and no SQL text is put together."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spellings that name each other (fixed values).
HARNESS_ALIASES = {"claude": ("claude_code", "claude"), "claude_code": ("claude_code", "claude")}
#: Content that is never indexed (fixed values).
LOW_VALUE = ("tool_call", "tool_result", "shell_output", "progress")
HIT_COLUMNS = ("id", "text", "session_id", "turn_uuid", "seq", "ts", "role", "block_type", "harness")
MOST_IDS = 5000


def equals(name: str, value: object) -> Column:
    return F.col(name) == F.lit(value)


def one_of(name: str, values: list) -> Column:
    return F.col(name).isin(list(values))


def has_word(name: str, word: str) -> Column:
    """Whether a space-joined set holds ``word``."""
    return F.array_contains(F.split(F.col(name), " "), word)


def absent(name: str) -> Column:
    return F.col(name).isNull()


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def harness_spellings(harness: str) -> list[str]:
    return list(HARNESS_ALIASES.get(harness, (harness,)))


def parse_day(text: str) -> date:
    """A bound in the one spelling that text comparison survives."""
    try:
        day = date.fromisoformat(text)
    except ValueError:
        day = None
    if day is None or day.isoformat() != text:
        raise ValueError(f"{text!r} is not a date: expected YYYY-MM-DD")
    return day


def day_range(name: str, since: str | None = None, until: str | None = None) -> Column:
    """Days from ``since`` through ``until``, both inclusive, compared as text."""
    out = []
    if since is not None:
        out.append(F.col(name) >= parse_day(since).isoformat())
    if until is not None:
        out.append(F.col(name) < (parse_day(until) + timedelta(days=1)).isoformat())
    return all_of(out)


def parse_repo(text: str) -> str:
    if not re.fullmatch(r"[^/\s]+/[^/\s]+", text):
        raise ValueError(f"{text!r} is not a repo: expected owner/name")
    return text


def recall_filter(block_type: str | None = None, role: str | None = None, harness: str | None = None, repo: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    out = [equals(n, v) for n, v in (("block_type", block_type), ("role", role)) if v is not None]
    if harness is not None:
        out.append(one_of("harness", harness_spellings(harness)))
    if repo is not None:
        out.append(has_word("repo", parse_repo(repo)))
    return all_of([*out, day_range("ts", since, until)])


def facets(**values: object) -> Column:
    return all_of([equals(k, v) for k, v in values.items() if v is not None])


def text_range(name: str, since: str | None, until: str | None) -> Column:
    return all_of([c for c in ((F.col(name) >= since) if since else None, (F.col(name) <= until) if until else None) if c is not None])


def seq_window(first: int | None, last: int | None) -> Column:
    return all_of([c for c in ((F.col("seq") >= first) if first is not None else None, (F.col("seq") <= last) if last is not None else None) if c is not None])


def noise(name: str, literals: list[str]) -> Column:
    return F.trim(F.col(name)).isin(literals)


def block_selected(hidden: tuple[str, ...] = ("thinking",)) -> Column:
    """Applied after the blocks of a turn are numbered, so numbers don't depend on what is hidden."""
    return ~F.col("block_type").isin(list(hidden))


def utc_bounds(name: str, since: str | None, until: str | None) -> Column:
    """Rows whose stamp is missing or malformed fail."""
    at = F.try_to_timestamp(F.col(name))
    out = [at.isNotNull()]
    if since:
        out.append(at >= F.to_timestamp(F.lit(since)))
    if until:
        out.append(at <= F.to_timestamp(F.lit(until)))
    return F.coalesce(all_of(out), F.lit(False))


def post_filter_window(limit: int, cap: int = 128) -> int:
    return min(4 * limit, cap)


def reindex_eligible(name: str) -> Column:
    return ~F.lower(F.coalesce(F.col(name), F.lit(""))).isin(list(LOW_VALUE))


def hit_columns(rows: DataFrame) -> DataFrame:
    """The columns of a hit; ones that an older table lacks are left out."""
    return rows.select(*[c for c in HIT_COLUMNS if c in rows.columns])


def partitioned(ranked: DataFrame, native: Column, order: list) -> DataFrame:
    """A ranking dealt in two, each keeping its order."""
    rows = ranked.withColumn("native", native)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("native").orderBy(*order)))


def marked_missing(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    seen = present.select(key).distinct().withColumn("_there", F.lit(1))
    return rows.join(seen, key, "left").withColumn("active", F.coalesce("_there", F.lit(0))).drop("_there")


def validated_ids(spark: SparkSession, ids: list[str]) -> DataFrame:
    """``id, place``: distinct ids by the place they are first seen at."""
    if not isinstance(ids, list) or len(ids) > MOST_IDS or any(not isinstance(i, str) or not i.strip() for i in ids):
        raise ValueError(f"expected a list of at most {MOST_IDS} non-empty strings")
    rows = spark.createDataFrame([(ids,)], "ids array<string>").select(F.posexplode("ids").alias("place", "id"))
    return rows.groupBy("id").agg(F.min("place").cast("long").alias("place"))


def scan(rows: DataFrame, columns: list[str], where: Column | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Projection, filter, then limit (never the limit first)."""
    out = rows if where is None else rows.filter(where)
    out = out.select(*columns)
    if limit is not None:
        out = out.orderBy(*(order or columns)).limit(limit)
    return out


def legacy_automation(agent: Column, kind: Column, path: Column) -> Column:
    """Output of automation runs that was once stored as memory: of agent ``codex``, type ``memory``, below its
    automation folder, and neither a note nor a setting (fixed values)."""
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    named = (F.lower(F.coalesce(agent, F.lit(""))) == "codex") & (F.lower(F.coalesce(kind, F.lit(""))) == "memory")
    return named & low.contains("/.codex/automations/") & ~(low.endswith(".md") | low.endswith(".toml"))
