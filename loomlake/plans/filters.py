"""Scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import predicates as P
from .registry import query
from .tables import BLOCKS, CHUNKS, REVISIONS, TRIM, blocks, chunks, revisions, table

_KEYS = "session_id, seq"


def _keys(df: DataFrame) -> DataFrame:
    return df.select("session_id", "seq")


@query("f_eq", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE role = 'user' AND harness = 'codex'")
def f_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(blocks(spark, sf_dir).filter(P.equals("role", "user") & P.equals("harness", "codex")))


@query("f_in", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE block_type IN ('tool_use', 'it''s')")
def f_in(spark, sf_dir):
    return _keys(blocks(spark, sf_dir).filter(P.one_of("block_type", ["tool_use", "it's"])))


@query("f_has_word", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE list_contains(string_split(repo, ' '), 'fork/repo3')")
def f_has_word(spark, sf_dir):
    return _keys(blocks(spark, sf_dir).filter(P.has_word("repo", "fork/repo3")))


@query("f_null_vec", "SELECT l.quality IS NULL AS absent, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def f_null_vec(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(P.absent("quality").alias("absent")).agg(F.count(F.lit(1)).alias("n"))


@query("f_where", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE block_type = 'text' AND role = 'user' AND harness IN ('claude_code', 'claude') AND list_contains(string_split(repo, ' '), 'org/repo3') AND ts >= '2026-01-03' AND ts < '2026-01-21'")
def f_where(spark, sf_dir):
    where = P.recall_filter(block_type="text", role="user", harness="claude", repo="org/repo3", since="2026-01-03", until="2026-01-20")
    return _keys(blocks(spark, sf_dir).filter(where))


@query("f_harness_alias", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE harness IN ('claude_code', 'claude')")
def f_harness_alias(spark, sf_dir):
    return _keys(blocks(spark, sf_dir).filter(P.one_of("harness", P.harness_spellings("claude"))))


@query("f_day_range", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE substr(ts, 1, 10) BETWEEN '2026-01-05' AND '2026-01-09'")
def f_day_range(spark, sf_dir):
    return _keys(blocks(spark, sf_dir).filter(P.day_range("ts", "2026-01-05", "2026-01-09")))


@query("f_canonical", f"WITH {REVISIONS} SELECT source_identity, source_version FROM revisions WHERE event_type = 'click' AND generation = 2")
def f_canonical(spark, sf_dir):
    return revisions(spark, sf_dir).filter(P.facets(event_type="click", generation=2)).select("source_identity", "source_version")


@query("f_seq_window", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE session_id = 's3' AND seq BETWEEN 2 AND 5")
def f_seq_window(spark, sf_dir):
    return _keys(blocks(spark, sf_dir).filter(P.equals("session_id", "s3") & P.seq_window(2, 5)))


@query("f_scaffold", "SELECT page_id FROM pages WHERE starts_with(ltrim(html, chr(9) || chr(10) || chr(13) || ' '), '<') OR starts_with(ltrim(html, chr(9) || chr(10) || chr(13) || ' '), '#')")
def f_scaffold(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(T.is_scaffolding(F.col("html"))).select("page_id")


@query("f_noise", "SELECT doc_id FROM documents WHERE trim(text) IN ('That it.', 'In.')")
def f_noise(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(P.noise("text", ["That it.", "In."])).select("doc_id")


@query("f_block_selected", f"WITH {BLOCKS} SELECT {_KEYS}, block_idx FROM blocks WHERE block_type <> 'tool_result'")
def f_block_selected(spark, sf_dir):
    return blocks(spark, sf_dir).filter(P.block_selected(("tool_result",))).select("session_id", "seq", "block_idx")


@query("f_sidecar_facets", f"WITH {REVISIONS} SELECT source_version FROM revisions WHERE event_type = 'view' AND updated_at >= '2024-01-05' AND updated_at <= '2024-01-20T12:00:00Z'")
def f_sidecar_facets(spark, sf_dir):
    r = revisions(spark, sf_dir)
    return r.filter(P.facets(event_type="view") & P.text_range("updated_at", "2024-01-05", "2024-01-20T12:00:00Z")).select("source_version")


_POST = f"WITH {REVISIONS}, top AS (SELECT * FROM revisions ORDER BY value DESC, event_id LIMIT 128)"


@query("f_pg_post", f"{_POST} SELECT event_id FROM top WHERE try_cast(updated_at AS TIMESTAMP) >= TIMESTAMP '2024-01-10' AND try_cast(updated_at AS TIMESTAMP) <= TIMESTAMP '2024-01-25 06:00:00'")
def f_pg_post(spark, sf_dir):
    """Bounds hold after the bounded window, not before it."""
    top = revisions(spark, sf_dir).orderBy(F.desc("value"), "event_id").limit(P.post_filter_window(40))
    return top.filter(P.utc_bounds("updated_at", "2024-01-10T00:00:00Z", "2024-01-25T06:00:00Z")).select("event_id")


@query("f_low_value", f"WITH {BLOCKS} SELECT {_KEYS} FROM blocks WHERE lower(block_type) NOT IN ('tool_call', 'tool_result', 'shell_output', 'progress')")
def f_low_value(spark, sf_dir):
    return _keys(blocks(spark, sf_dir).filter(P.reindex_eligible("block_type")))


@query("p_hit_cols", f"WITH RECURSIVE {CHUNKS} SELECT id, text, session_id, turn_uuid, seq, ts, role, block_type, harness FROM chunks")
def p_hit_cols(spark, sf_dir):
    return P.hit_columns(chunks(spark, sf_dir))


@query("p_partition", f"WITH {BLOCKS}, r AS (SELECT session_id, seq, harness, row_number() OVER (ORDER BY length(text) DESC, session_id, seq) AS rank FROM blocks) SELECT session_id, seq, harness = 'codex' AS native, row_number() OVER (PARTITION BY harness = 'codex' ORDER BY rank) AS place FROM r WHERE rank <= 200")
def p_partition(spark, sf_dir):
    top = blocks(spark, sf_dir).orderBy(F.desc(F.char_length("text")), "session_id", "seq").limit(200)
    return P.partitioned(top, F.col("harness") == "codex", [F.desc(F.char_length("text")), "session_id", "seq"]).select("session_id", "seq", "native", "place")


@query("f_mark_missing", "SELECT c_custkey, CASE WHEN o.k IS NULL THEN 0 ELSE 1 END AS active FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k")
def f_mark_missing(spark, sf_dir):
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return P.marked_missing(table(spark, sf_dir, "customer").select("c_custkey"), present, "c_custkey")


@query("f_validate_ids", "SELECT s AS id, CAST(min(i) AS BIGINT) AS place FROM (SELECT unnest(['b', 'a', 'b', 'c', 'a']) AS s, unnest([0, 1, 2, 3, 4]) AS i) GROUP BY s")
def f_validate_ids(spark, sf_dir):
    return P.validated_ids(spark, ["b", "a", "b", "c", "a"])


@query("scan_rows", "SELECT doc_id, lang FROM documents WHERE n_chars > 2000 ORDER BY doc_id LIMIT 50")
def scan_rows(spark, sf_dir):
    return P.scan(table(spark, sf_dir, "documents"), ["doc_id", "lang"], F.col("n_chars") > 2000, 50, ["doc_id"])


@query("scan_fold", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def scan_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("take_rows", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def take_rows(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(wanted, "doc_id", "left_semi")


@query("count_rows", "SELECT count(*) AS n FROM documents WHERE lang = 'fr'")
def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(P.equals("lang", "fr")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_text", f"SELECT doc_id, md5({TRIM('regexp_replace(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS m FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("m"))


@query("one_line", f"SELECT doc_id, CASE WHEN length(x) > 80 THEN substr(x, 1, 79) || '…' ELSE x END AS line FROM (SELECT doc_id, {TRIM('regexp_replace(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS x FROM documents)")
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text"), 80).alias("line"))


@query("excerpt", "SELECT doc_id, substr(text, greatest(strpos(text, 'License') - 20, 1), strpos(text, 'License') + 27 - greatest(strpos(text, 'License') - 20, 1)) AS part FROM documents WHERE strpos(text, 'License') > 0")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), "License", 20).alias("part")).filter("part is not null")


@query("base64url", "SELECT doc_id, rtrim(replace(replace(to_base64(encode(source || '/' || lang || '?>~' || doc_id)), '+', '-'), '/', '_'), '=') AS ref FROM documents")
def base64url(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.base64url(F.concat("source", F.lit("/"), "lang", F.lit("?>~"), F.col("doc_id").cast("string"))).alias("ref"))
