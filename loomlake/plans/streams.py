"""Incremental operators over tables (their streaming forms share the code)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..streaming import upserts as U
from .ingest import _REDACTED
from .registry import query
from .tables import BLOCKS, CHUNKS, REVISIONS, blocks, chunks, revisions, table

_STATUS = f"""WITH {REVISIONS}, b AS (SELECT *, max(updated_at || '|' || source_version || '|' || content_hash) OVER (PARTITION BY source_identity ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM revisions),
s AS (SELECT event_id, CASE WHEN before IS NULL THEN 'created' WHEN updated_at < substr(before, 1, 20) THEN 'stale' WHEN content_hash = right(before, 40) THEN 'deduped' ELSE 'updated' END AS status FROM b)"""


@query("st_upsert", f"{_STATUS} SELECT event_id, status FROM s")
def st_upsert(spark, sf_dir):
    return U.statuses(revisions(spark, sf_dir), "source_identity", "event_id").select("event_id", "status")


@query("st_late_stale", _STATUS.replace("ORDER BY event_id", "ORDER BY (event_id * 7919) % 1000003") + " SELECT event_id FROM s WHERE status = 'stale'")
def st_late_stale(spark, sf_dir):
    """Deliveries in an order of arrival of their own, so that older ones come behind newer ones; arrivals repeat from
    event 1000003 on, and of equal ones the lesser event comes first."""
    r = revisions(spark, sf_dir).withColumn("arrival", (F.col("event_id") * 7919) % 1000003)
    return U.late(r, "source_identity", "arrival", "event_id").select("event_id")


@query("st_merged", f"WITH {REVISIONS} SELECT source_identity, max(updated_at || source_version) AS top FROM revisions GROUP BY source_identity")
def st_merged(spark, sf_dir):
    return U.merged(revisions(spark, sf_dir), "source_identity").select("source_identity", F.concat("updated_at", "source_version").alias("top"))


@query("st_lww_clocks", "SELECT user_id, max(strftime(ts, '%Y%m%d%H%M%S') || '|' || event_type) AS event_type, right(max(strftime(ts, '%Y%m%d%H%M%S') || '|' || lpad(CAST(event_id AS VARCHAR), 9, '0')), 9) AS last_id FROM events GROUP BY user_id")
def st_lww_clocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMddHHmmss").alias("clock"), "event_type", F.lpad(F.col("event_id").cast("string"), 9, "0").alias("last_id"))
    e = e.withColumn("event_type", F.concat("clock", F.lit("|"), "event_type"))
    return U.last_writers(e, "user_id", ["event_type", "last_id"], "clock")


@query("st_soft_delete", "SELECT c_custkey, true AS source_missing, CAST(2 AS INTEGER) AS version FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 200000)")
def st_soft_delete(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("version"))
    out = U.tombstones(stored, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_totalprice < 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return out.select("c_custkey", "source_missing", "version")


@query("st_generation_guard", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 >= event_id % 4 THEN 'new' ELSE 'old' END AS state, CASE WHEN event_id % 2 = 0 AND event_id % 5 >= event_id % 4 THEN event_id % 5 ELSE event_id % 4 END AS generation FROM events")
def st_generation_guard(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    current = e.select("event_id", F.lit("old").alias("state"), (F.col("event_id") % 4).alias("generation"))
    incoming = e.filter("event_id % 2 = 0").select("event_id", F.lit("new").alias("state"), (F.col("event_id") % 5).alias("generation"))
    return U.guarded(current, incoming, "event_id", "state", "generation")


@query("st_monotone_state", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, event_type DESC) AS r FROM events) WHERE r = 1")
def st_monotone_state(spark, sf_dir):
    return U.monotone(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id", "event_type"])


_SECRET = "(regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') OR regexp_matches(text, '(?i)\\b(?:password|token|secret|api_key)\\s*=\\s*\"?([0-9a-f]{24,64})\\b') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'))"


@query("st_push_gate", f"WITH RECURSIVE {CHUNKS}, bad AS (SELECT DISTINCT session_id, seq FROM chunks WHERE strpos(text, 'ound') > 0) SELECT id FROM chunks WHERE (session_id, seq) NOT IN (SELECT session_id, seq FROM bad)")
def st_push_gate(spark, sf_dir):
    """Any finding in a block holds every row of it (a frequent string stands for a secret here)."""
    return U.held_blocks(chunks(spark, sf_dir), ["session_id", "seq"], F.col("text").contains("ound")).select("id")


@query("st_doc_gate", f"SELECT doc_id FROM documents WHERE NOT {_SECRET}")
def st_doc_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~I.has_secret(F.col("text"))).select("doc_id")


@query("st_counters", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS indexed FROM events GROUP BY event_type")
def st_counters(spark, sf_dir):
    return U.counters(table(spark, sf_dir, "events"), "event_type", F.when(F.col("event_id") % 3 == 0, "indexed").otherwise("pending"))


@query("st_queue", "SELECT event_id, CAST(least(30 * pow(2, least(event_id % 9, 6)), 3600) AS INTEGER) AS wait FROM events")
def st_queue(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", U.backoff_seconds(F.col("event_id") % 9).alias("wait"))


@query("st_reindex_control", f"WITH {REVISIONS}, c AS (SELECT event_type, max(event_id % 7) AS target FROM revisions GROUP BY event_type) SELECT r.event_id, r.generation < c.target AS due FROM revisions r JOIN c USING (event_type)")
def st_reindex_control(spark, sf_dir):
    r = revisions(spark, sf_dir).select("event_id", "event_type", "generation")
    control = r.groupBy("event_type").agg(F.max(F.col("event_id") % 7).alias("target"))  # one row a type
    return r.join(control, "event_type").select("event_id", (F.col("generation") < F.col("target")).alias("due"))


@query("st_pacer", "SELECT event_id, CAST(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) > 100 AS BOOLEAN) AS over_budget FROM events")
def st_pacer(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-60, 0)
    return table(spark, sf_dir, "events").select("event_id", (F.sum("value").over(w) > 100).alias("over_budget"))


@query("st_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_windows(spark, sf_dir):
    return U.windows(table(spark, sf_dir, "events"), "ts", "1 hour")


@query("st_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def st_session_windows(spark, sf_dir):
    return U.session_windows(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")


@query("st_scrub", f"SELECT doc_id, md5({_REDACTED}) AS m FROM documents WHERE {_SECRET}")
def st_scrub(spark, sf_dir):
    """Stored texts with findings, as they are after the scrub."""
    found = table(spark, sf_dir, "documents").filter(I.has_secret(F.col("text")))
    return I.sanitized(found).select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
