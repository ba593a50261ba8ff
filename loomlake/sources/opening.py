"""Any folder of logs as one frame: which layout a file has is told from its lines, and layouts can be added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transcripts as X

MESSAGE = ("session", "message_id", "role", "content_type", "text", "ts", "tool_name", "source_path")


@dataclass(frozen=True)
class Layout:
    """``line``: whether a line (column ``value``) is one of this layout's; ``read``: from a file's lines (``value,
    source_path``) to MESSAGE."""

    name: str
    line: Callable[[], Column]
    read: Callable[[DataFrame], DataFrame]


def _typed(*kinds: str) -> Column:
    return F.coalesce(X.first_of("type").isin(*kinds), F.lit(False))


def turns(lines: DataFrame) -> DataFrame:
    """The library's own turn lines: a message for each block."""
    from ..operators.ingest import TURN, valid_turn

    rows = lines.select("source_path", F.from_json("value", TURN).alias("t")).select("source_path", "t.*").filter(valid_turn())
    each = rows.select("source_path", "session_id", "turn_uuid", "role", "ts", F.posexplode("blocks").alias("at", "b"))
    return each.select(F.col("session_id").alias("session"), F.concat_ws(":", "turn_uuid", F.col("at").cast("string")).alias("message_id"), "role", F.col("b.block_type").alias("content_type"), F.col("b.text").alias("text"), "ts", F.col("b.tool_name").alias("tool_name"), "source_path").filter("text is not null")


#: In the order in which a file is tried.
_LAYOUTS: dict[str, Layout] = {}


def register(layout: Layout) -> None:
    """Adds a layout, or puts it in the place of the one of that name; it is tried before those that came earlier, but
    for those it replaces."""
    before = dict(_LAYOUTS)
    _LAYOUTS.clear()
    if layout.name in before:
        _LAYOUTS.update(before | {layout.name: layout})
    else:
        _LAYOUTS.update({layout.name: layout} | before)


for _l in (
    Layout("generic", lambda: F.coalesce(X.content("text", "content", "message.content", "prompt") != "", F.lit(False)), X.generic),
    Layout("pi", lambda: _typed("session", "message") & X.first_of("payload").isNull() & (X.first_of("message").isNotNull() | _typed("session")), X.pi),
    Layout("claude", lambda: F.coalesce(X.first_of("sessionId").isNotNull() & (_typed(*X.CLAUDE_TYPES) | X.first_of("display").isNotNull()), F.lit(False)), X.claude),
    Layout("codex", lambda: _typed("session_meta", "response_item") & X.first_of("payload").isNotNull(), X.codex),
    Layout("turns", lambda: F.coalesce((X.first_of("format") == "1") & X.first_of("blocks").isNotNull() & X.first_of("turn_uuid").isNotNull(), F.lit(False)), turns),
):
    register(_l)


def layouts(lines: DataFrame) -> DataFrame:
    """``source_path, layout`` of each file: the first layout that any of its lines has; null if none does. One pass
    over the lines, and one row a file and task in the exchange."""
    names = list(_LAYOUTS)
    seen = lines.groupBy("source_path").agg(*[F.bool_or(layout.line()).alias(f"_{i}") for i, layout in enumerate(_LAYOUTS.values())])
    return seen.select("source_path", F.coalesce(*[F.when(F.col(f"_{i}"), n) for i, n in enumerate(names)]).alias("layout"))


def open_logs(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """MESSAGE and ``layout`` of all files under ``path``; with ``limit``, of the files changed last (of those changed
    at once, the first by path). A file in no known layout ends it with an error where ``strict``, else it is left out.
    An empty or absent folder has none. Paths stay in frames; only those of up to three refused files are shown."""
    try:
        lines = X.read_lines(spark, path)
        lines.schema  # noqa: B018 - an absent folder shows here
    except AnalysisException:
        lines = spark.createDataFrame([], "value string, source_path string")
        limit = None
    if limit is not None:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").format("binaryFile").load(path).select(F.col("path").alias("source_path"), "modificationTime")
        lines = lines.join(F.broadcast(files.orderBy(F.desc("modificationTime"), "source_path").limit(limit).select("source_path")), "source_path", "left_semi")
    found = layouts(lines.filter(F.trim("value") != ""))
    if strict and (bad := found.filter("layout is null").orderBy("source_path").limit(3).collect()):
        raise ValueError("in no known layout: " + ", ".join(r["source_path"] for r in bad))
    known = lines.join(found, "source_path")
    out = None
    for name, layout in _LAYOUTS.items():
        part = layout.read(known.filter(F.col("layout") == name).select("value", "source_path")).select(*MESSAGE, F.lit(name).alias("layout"))
        out = part if out is None else out.unionByName(part)
    return out
