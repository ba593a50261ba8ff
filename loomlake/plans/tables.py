"""The frames that queries start from, and the same as SQL: blocks and chunks of conversations, versioned documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splitting


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per turn of ``conversations``, with the attribution that turn logs carry."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    session = F.concat(F.lit("s"), conv.cast("string"))
    kind = F.when(turn % 4 == 2, "tool_use").when(turn % 4 == 3, "tool_result").otherwise("text")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return c.select(
        session.alias("session_id"),
        turn.cast("long").alias("seq"),
        F.concat(session, F.lit("-"), turn.cast("string")).alias("turn_uuid"),
        F.lit(0).cast("long").alias("block_idx"),
        "role",
        kind.alias("block_type"),
        F.when(turn % 4 == 2, F.concat(F.lit("tool"), (conv % 5).cast("string"))).alias("tool_name"),
        F.concat(F.lit("2026-01-"), two(1 + conv % 28), F.lit("T"), two(turn % 24), F.lit(":00:00Z")).alias("ts"),
        F.when(conv % 3 == 0, "claude_code").when(conv % 3 == 1, "codex").otherwise("pi").alias("harness"),
        F.when(conv % 4 != 0, F.concat(F.lit("org/repo"), (conv % 7).cast("string"), F.lit(" fork/repo"), (conv % 7).cast("string"))).alias("repo"),
        F.concat(F.lit("/home/u"), (conv % 9).cast("string"), F.lit("/dev/p.x")).alias("cwd"),
        "text",
    )


BLOCKS = """blocks AS (
  SELECT 's' || conv_id AS session_id, CAST(turn AS BIGINT) AS seq, 's' || conv_id || '-' || turn AS turn_uuid,
    CAST(0 AS BIGINT) AS block_idx, role,
    CASE turn % 4 WHEN 2 THEN 'tool_use' WHEN 3 THEN 'tool_result' ELSE 'text' END AS block_type,
    CASE WHEN turn % 4 = 2 THEN 'tool' || (conv_id % 5) END AS tool_name,
    '2026-01-' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS ts,
    CASE conv_id % 3 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' ELSE 'pi' END AS harness,
    CASE WHEN conv_id % 4 <> 0 THEN 'org/repo' || (conv_id % 7) || ' fork/repo' || (conv_id % 7) END AS repo,
    '/home/u' || (conv_id % 9) || '/dev/p.x' AS cwd, text
  FROM conversations)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.chunks(blocks(spark, sf_dir))


def piece_end(start: str) -> str:
    """SQL of the end of the piece of ``body`` that begins at ``start``."""
    seg = f"substr(body, {start} + 1, 1200)"
    last = lambda c: f"CASE WHEN strpos(reverse({seg}), {c}) > 0 THEN 1200 - strpos(reverse({seg}), {c}) ELSE -1 END"
    return f"CASE WHEN {start} + 1200 >= length(body) THEN length(body) WHEN ({last('chr(10)')}) > 600 THEN {start} + ({last('chr(10)')}) WHEN ({last(chr(39) + ' ' + chr(39))}) > 600 THEN {start} + ({last(chr(39) + ' ' + chr(39))}) ELSE {start} + 1200 END"


TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

RENDERED = f"""rendered AS (
  SELECT * EXCLUDE (text), {TRIM("CASE block_type WHEN 'tool_use' THEN '[tool_use ' || coalesce(tool_name, 'None') || '] ' || text WHEN 'tool_result' THEN '[tool_result' || coalesce(' ' || tool_name, '') || '] ' || text ELSE text END")} AS body
  FROM blocks)"""

#: After WITH RECURSIVE.
CHUNKS = f"""{BLOCKS}, {RENDERED}, cut AS (
  SELECT session_id, seq, block_idx, body, 0 AS k, 0 AS st, {piece_end("0")} AS en FROM rendered WHERE length(body) > 0
  UNION ALL
  SELECT session_id, seq, block_idx, body, k + 1, greatest(en - 150, st + 1), {piece_end("greatest(en - 150, st + 1)")} FROM cut WHERE en < length(body)
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, seq, block_idx ORDER BY k) - 1 AS split_idx
  FROM (SELECT session_id, seq, block_idx, k, {TRIM("substr(body, st + 1, en - st)")} AS text FROM cut) WHERE text <> ''
), chunks AS (
  SELECT r.* EXCLUDE (body), c.split_idx, c.text, substr(sha1(r.session_id || ':' || r.turn_uuid || ':' || r.block_idx || ':' || c.split_idx), 1, 16) AS id
  FROM rendered r JOIN kept c USING (session_id, seq, block_idx))"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned documents: every event is a revision of the document of its user and type."""
    e = table(spark, sf_dir, "events")
    ident = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    return e.select(
        ident.alias("source_identity"),
        F.concat(F.lit("v"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("source_version"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.sha1(F.concat_ws("|", ident, (F.col("event_id") % 3).cast("string"))).alias("content_hash"),
        (F.col("event_id") % 4).cast("long").alias("generation"),
        "event_id",
        "event_type",
        "user_id",
        "value",
    )


REVISIONS = """revisions AS (
  SELECT 'u' || user_id || '/' || event_type AS source_identity, 'v' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS source_version,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, sha1('u' || user_id || '/' || event_type || '|' || (event_id % 3)) AS content_hash,
    CAST(event_id % 4 AS BIGINT) AS generation, event_id, event_type, user_id, value
  FROM events)"""
