"""Table forms of the streaming mechanisms: upserts with all statuses, the delivery queue, tails of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tail as X
from ..streaming import delivery as D
from ..streaming import reindex as R
from ..streaming import stateful as S
from .registry import query
from .tables import table


def deliveries(spark, sf_dir):
    """Every event delivers a revision of the document of its user and type, out of order, some with derived fields."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    r, s = n % 3, lambda c: c.cast("string")
    ident = F.concat(F.lit("u"), s(F.col("user_id")), F.lit("/"), F.col("event_type"))
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    half = lambda k: F.floor(n / k)
    return e.select(
        ident.alias("identity"), ((n * 7919) % 1000003).cast("long").alias("arrival"), F.concat(F.lit("2026-01-0"), s(1 + r)).alias("updated_at"), F.concat(F.lit("v"), s(r)).alias("source_version"),
        F.sha1(F.concat(ident, F.lit("|"), s(r))).alias("content_hash"),
        F.when(n % 5 < 3, n % 4).cast("long").alias("shadow_generation"), F.when(n % 5 < 3, pick(half(3), "ok", "pending_provider", "fallback_provider_error")).alias("shadow_status"), F.when(n % 5 < 3, F.concat(F.lit("t"), s(n % 7))).alias("shadow_text"),
        F.when(n % 7 < 3, n % 2).cast("long").alias("index_generation"), F.when(n % 7 < 3, pick(half(2), "indexed", "pending", "held_invalid")).alias("index_status"), F.when(n % 7 < 3, F.concat(F.lit("T"), s(n % 4))).alias("indexed_at"),
        F.when(n % 2 == 1, F.concat(F.lit("2026-02-0"), s(n % 9))).alias("clock"), F.when(n % 4 != 0, F.concat(F.lit("p"), s(n % 5))).alias("project"), F.when(n % 6 == 0, F.concat(F.lit("r"), s(n % 8))).alias("repo"), F.lit(None).cast("string").alias("device_id"), n.alias("event_id"),
    )


#: Each group of fields as a string that sorts as the rules say.
_DELIVERIES = """d AS (
  SELECT event_id, 'u' || user_id || '/' || event_type AS identity, (event_id * 7919) % 1000003 AS arrival,
    '2026-01-0' || (1 + event_id % 3) || '|v' || (event_id % 3) || '|' || sha1('u' || user_id || '/' || event_type || '|' || (event_id % 3)) AS revision,
    CASE WHEN event_id % 5 < 3 THEN (event_id % 4) || '|' || CASE (event_id // 3) % 3 WHEN 0 THEN '1|ok' WHEN 1 THEN '0|pending_provider' ELSE '0|fallback_provider_error' END || '|t' || (event_id % 7) END AS shadow,
    CASE WHEN event_id % 7 < 3 THEN (event_id % 2) || '|' || CASE WHEN (event_id // 2) % 3 = 1 THEN '0' ELSE '1' END || '|T' || (event_id % 4) || '|' || CASE (event_id // 2) % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'pending' ELSE 'held_invalid' END END AS indexed,
    CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 2 = 1 THEN '2026-02-0' || (event_id % 9) ELSE '2026-01-0' || (1 + event_id % 3) END || '|p' || (event_id % 5) END AS project,
    CASE WHEN event_id % 6 = 0 THEN '2026-01-0' || (1 + event_id % 3) || '|r' || (event_id % 8) END AS repo
  FROM events)"""


@query("st_upsert_statuses", f"""WITH {_DELIVERIES}, w AS (
  SELECT *, max(revision) OVER a AS r0, max(shadow) OVER s AS s0, max(indexed) OVER s AS i0, max(project) OVER s AS p0, max(repo) OVER s AS q0 FROM d
  WINDOW a AS (PARTITION BY identity ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY identity, revision ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN r0 IS NULL THEN 'created' WHEN revision < r0 THEN 'stale' WHEN revision > r0 THEN 'updated'
  WHEN coalesce(shadow > coalesce(s0, ''), false) OR coalesce(indexed > coalesce(i0, ''), false) THEN 'derived_updated'
  WHEN coalesce(project > coalesce(p0, ''), false) OR coalesce(repo > coalesce(q0, ''), false) THEN 'metadata_updated' ELSE 'deduped' END AS status FROM w""")  # fmt: skip
def st_upsert_statuses(spark, sf_dir):
    """A status for each event; arrivals repeat from event 1000003 on, and of equal ones the lesser event comes first."""
    return S.delivered(deliveries(spark, sf_dir), "event_id").select("event_id", "status")


@query("st_stored", f"""WITH {_DELIVERIES}, e AS (SELECT identity, revision, max(shadow) AS shadow, max(indexed) AS indexed, max(project) AS project, max(repo) AS repo FROM d GROUP BY 1, 2)
SELECT identity, revision, shadow, indexed, project, repo FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY revision DESC) AS n FROM e) WHERE n = 1""")
def st_stored(spark, sf_dir):
    joined = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat_ws("|", *[F.col(f"{c}.{p}").cast("string") for p in parts])).alias(c)
    s = S.stored(deliveries(spark, sf_dir))
    return s.select("identity", joined("revision", *S.REVISION), joined("shadow", "generation", "final", "status", "text"), joined("indexed", "generation", "terminal", "at", "status"), joined("project", "clock", "value"), joined("repo", "clock", "value"))


@query("st_queue_batches", """WITH q AS (SELECT event_id % 16 AS lane, event_id, CAST(event_id % 9 AS INTEGER) AS attempts, CAST(event_id % 100 AS DOUBLE) AS next_at, repeat('x', CAST(event_id % 50 AS INTEGER)) AS payload FROM events),
w AS (SELECT *, sum(length(payload) + 1) OVER o AS bytes, count(*) OVER o AS n FROM q WHERE next_at <= 60 WINDOW o AS (PARTITION BY lane ORDER BY next_at, event_id ROWS UNBOUNDED PRECEDING))
SELECT lane, event_id, CASE WHEN event_id % 3 = 0 THEN attempts + 1 END AS attempts, CASE WHEN event_id % 3 = 0 THEN 60 + least(30 * pow(2, least(attempts, 6)), 3600) END AS next_at FROM w WHERE n = 1 OR (bytes <= 400 AND n <= 12)""")  # fmt: skip
def st_queue_batches(spark, sf_dir):
    """The first batch of each lane, and when those of its rows that are refused are tried again."""
    n = F.col("event_id")
    q = table(spark, sf_dir, "events").select((n % 16).alias("lane"), n, (n % 9).cast("int").alias("attempts"), (n % 100).cast("double").alias("next_at"), F.repeat(F.lit("x"), (n % 50).cast("int")).alias("payload"))
    first = D.batched(q.filter("next_at <= 60"), "lane", ["next_at", "event_id"], 400, 12)
    again = D.retried(first.filter(n % 3 == 0), F.lit(60.0)).select("event_id", F.col("attempts").alias("_a"), F.col("next_at").alias("_t"))
    return first.join(again, "event_id", "left").select("lane", "event_id", F.col("_a").alias("attempts"), F.col("_t").alias("next_at"))


@query("st_tail_lines", """WITH l AS (SELECT 'f' || (user_id % 40) AS source, CAST(100 + event_id % 2 AS BIGINT) AS inode, event_id % 50 * 10 AS "offset", event_type || event_id AS line, CASE WHEN event_id % 5 = 0 THEN 'full' ELSE 'tail' END AS mode, CAST(event_id % 1009 AS INTEGER) AS batch FROM events),
f AS (SELECT source, max(batch * 1000 + inode) AS top FROM l WHERE mode = 'full' GROUP BY source)
SELECT source, "offset", line FROM (SELECT l.*, row_number() OVER (PARTITION BY source, "offset" ORDER BY batch DESC, line DESC) AS n FROM l JOIN f USING (source) WHERE batch >= top // 1000 AND inode = top % 1000) WHERE n = 1""")  # fmt: skip
def st_tail_lines(spark, sf_dir):
    """The lines that files hold now, out of all that a tail of them has given."""
    n = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("source"), (100 + n % 2).cast("long").alias("inode"), (n % 50 * 10).cast("long").alias("offset"), F.concat("event_type", n.cast("string")).alias("line"), F.when(n % 5 == 0, "full").otherwise("tail").alias("mode"), (n % 1009).cast("int").alias("batch"))
    return X.current(lines)


def _reset_sql(source: str, g: int, all_: bool) -> str:
    """SQL of a control over ``source``."""
    free, canonical = "ix IS DISTINCT FROM 'waiting_durability'", "kind NOT IN ('progress', 'telemetry', 'status')"
    one = f"SELECT id, kind, el, raw, CASE WHEN {g} > sg AND el THEN raw ELSE sh END AS sh, CASE WHEN {g} > sg AND el THEN 'pending_provider' ELSE ss END AS ss, greatest(sg, {g}) AS sg, CASE WHEN {g} > sg AND el AND {g} > ig AND {free} THEN NULL ELSE ix END AS ix, CASE WHEN {g} > sg AND el AND {g} > ig THEN {g} ELSE ig END AS ig, eg FROM {source}"
    if not all_:
        return one
    two = f"SELECT * REPLACE (CASE WHEN {g} > ig AND {canonical} AND {free} THEN NULL ELSE ix END AS ix, greatest(ig, {g}) AS ig) FROM ({one})"
    return f"SELECT * REPLACE (CASE WHEN {g} > eg AND {canonical} AND {free} THEN NULL ELSE ix END AS ix, greatest(eg, {g}) AS eg) FROM ({two})"


@query("st_reindex_rows", f"""WITH r AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'progress' ELSE event_type END AS kind, event_id % 3 <> 0 AS el, 'raw' || event_id AS raw, 's' || event_id AS sh, 'ok' AS ss, event_id % 7 AS sg, CASE event_id % 4 WHEN 0 THEN 'waiting_durability' WHEN 1 THEN 'indexed' END AS ix, event_id % 6 AS ig, event_id % 8 AS eg FROM events),
a AS ({_reset_sql("r", 5, False)}), b AS ({_reset_sql("a", 3, True)})
SELECT id, sh AS shadow_text, ss AS shadow_status, sg AS shadow_generation, ix AS index_status, ig AS index_generation, eg AS embedding_generation FROM b""")  # fmt: skip
def st_reindex_rows(spark, sf_dir):
    """Rows behind two controls, the newer one over shadows only."""
    n = F.col("event_id")
    s = n.cast("string")
    rows = table(spark, sf_dir, "events").select(n.alias("id"), F.concat(F.lit("raw"), s).alias("raw_text"), F.when(n % 5 == 0, "progress").otherwise(F.col("event_type")).alias("content_type"), (n % 3 != 0).alias("provider_eligible"), F.concat(F.lit("s"), s).alias("shadow_text"), F.lit("ok").alias("shadow_status"), (n % 7).alias("shadow_generation"), F.when(n % 4 == 0, "waiting_durability").when(n % 4 == 1, "indexed").alias("index_status"), (n % 6).alias("index_generation"), (n % 8).alias("embedding_generation"))
    for generation, scope in ((5, "retrieval"), (3, "all")):
        rows = R.reset(rows, F.lit(generation), F.lit(scope))
    return rows.select("id", *R.CHANGED)
