"""Ingest: identifiers, rendering, splitting, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import ingest as I
from ..operators import language as L
from ..operators import scanning as SC
from ..operators import splitting
from .registry import query
from .tables import BLOCKS, CHUNKS, RENDERED, REVISIONS, TRIM, blocks, chunks, piece_end, revisions, table


@query("t_workdir", f"WITH {BLOCKS} SELECT session_id, seq, regexp_replace(trim(cwd), '[^A-Za-z0-9]', '-', 'g') AS workdir FROM blocks")
def t_workdir(spark, sf_dir):
    return blocks(spark, sf_dir).select("session_id", "seq", T.workdir(F.col("cwd")).alias("workdir"))


@query("t_repo_identity", "SELECT page_id, array_to_string(list_slice(string_split(regexp_replace(regexp_replace(url, '^[a-z+]+://', ''), '(\\.git)?/*$', ''), '/'), -2, -1), '/') AS repo FROM pages WHERE len(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z+]+://', ''), '(\\.git)?/*$', ''), '/'), lambda x: x <> '')) >= 3")
def t_repo_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.repo_identity(F.col("url")).alias("repo")).filter("repo is not null")


@query("t_repo_join", f"WITH {BLOCKS} SELECT session_id, string_agg(DISTINCT r, ' ' ORDER BY r) AS repos FROM (SELECT session_id, unnest(string_split(repo, ' ')) AS r FROM blocks) GROUP BY session_id")
def t_repo_join(spark, sf_dir):
    rows = blocks(spark, sf_dir).filter("repo is not null").select("session_id", F.explode(F.split("repo", " ")).alias("r"))
    return rows.groupBy("session_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("r"))).alias("repos"))


@query("t_elide", "SELECT doc_id, md5('data:image/png;base64,[elided] ' || text) AS m FROM documents")
def t_elide(spark, sf_dir):
    payload = F.concat(F.lit("data:image/png;base64,"), F.base64(F.substring("text", 1, 20).cast("binary")), F.lit(" "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.elide_data_uris(payload).cast("binary")).alias("m"))


@query("t_render", f"WITH {BLOCKS}, {RENDERED} SELECT session_id, seq, md5(body) AS m FROM rendered")
def t_render(spark, sf_dir):
    b = blocks(spark, sf_dir)
    rendered = T.render(F.col("block_type"), F.col("text"), F.col("tool_name"))
    return b.select("session_id", "seq", F.md5(T.trim_unicode(rendered).cast("binary")).alias("m"))


@query("t_split", f"WITH RECURSIVE {CHUNKS} SELECT session_id, seq, split_idx, text FROM chunks")
def t_split(spark, sf_dir):
    return chunks(spark, sf_dir).select("session_id", "seq", "split_idx", "text")


@query("t_chunk_id", f"WITH {BLOCKS} SELECT session_id, seq, substr(sha1(session_id || ':' || turn_uuid || ':' || block_idx || ':0'), 1, 16) AS id FROM blocks")
def t_chunk_id(spark, sf_dir):
    return blocks(spark, sf_dir).select("session_id", "seq", ids.chunk_id(F.col("session_id"), F.col("turn_uuid"), F.col("block_idx"), F.lit(0)).alias("id"))


@query("t_canonical_id", "SELECT doc_id, substr(sha1('canonical' || chr(0) || source || '/' || doc_id || chr(0) || '0'), 1, 16) AS id FROM documents")
def t_canonical_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.document_chunk_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.lit(0)).alias("id"))


@query("t_opaque_id", "SELECT doc_id, sha256('source-id' || chr(0) || source) AS id FROM documents")
def t_opaque_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.opaque("source-id", F.col("source")).alias("id"))


@query("t_chunks", f"WITH RECURSIVE {CHUNKS} SELECT id, session_id, seq, block_idx, split_idx, block_type, md5(text) AS m FROM chunks")
def t_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "session_id", "seq", "block_idx", "split_idx", "block_type", F.md5(F.col("text").cast("binary")).alias("m"))


@query("t_tier", f"WITH {BLOCKS} SELECT session_id, seq, CASE block_type WHEN 'tool_use' THEN 2 WHEN 'tool_result' THEN 3 ELSE 1 END AS tier FROM blocks")
def t_tier(spark, sf_dir):
    return blocks(spark, sf_dir).select("session_id", "seq", I.tier(F.col("block_type")).alias("tier"))


_DOCUMENT_CUT = f"""WITH RECURSIVE d AS (SELECT source || '/' || doc_id AS ident, {TRIM('text')} AS body FROM documents), cut AS (
  SELECT ident, body, 0 AS k, 0 AS st, {piece_end("0")} AS en FROM d WHERE length(body) > 0
  UNION ALL SELECT ident, body, k + 1, greatest(en - 150, st + 1), {piece_end("greatest(en - 150, st + 1)")} FROM cut WHERE en < length(body)
), kept AS (SELECT ident, row_number() OVER (PARTITION BY ident ORDER BY k) - 1 AS split_idx, text FROM (SELECT ident, k, {TRIM("substr(body, st + 1, en - st)")} AS text FROM cut) WHERE text <> '')"""


@query("t_document_chunks", f"{_DOCUMENT_CUT} SELECT substr(sha1('canonical' || chr(0) || ident || chr(0) || split_idx), 1, 16) AS id, ident AS source_identity, ident AS session_id, '' AS workdir, 'document' AS role, split_idx, md5(text) AS m FROM kept")
def t_document_chunks(spark, sf_dir):
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_identity"), none.alias("session_id"), none.alias("project"), none.alias("role"), F.col("text").alias("body"))
    return I.document_rows(d, splitting.split_text(F.col("body"))).select("id", "source_identity", "session_id", "workdir", "role", "split_idx", F.md5(F.col("text").cast("binary")).alias("m"))


@query("t_normalize_doc", f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS raw, text AS retrieval, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS agent, lang FROM documents) SELECT doc_id, CASE WHEN {TRIM('raw')} <> '' THEN md5(raw) ELSE md5(retrieval) END AS m, coalesce(nullif({TRIM('agent')}, ''), lang) AS source_agent, CASE WHEN doc_id % 11 = 0 THEN 'source_version is required' END AS refused FROM d")
def t_normalize_doc(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    docs = d.select("doc_id", i.cast("string").alias("source_identity"), F.when(i % 11 == 0, " ").otherwise("v1").alias("source_version"), F.when(i % 5 == 0, " ").otherwise(F.col("text")).alias("raw_text"), F.col("text").alias("retrieval_text"), F.when(i % 7 == 0, "").otherwise(F.col("source")).alias("source_agent"), F.to_json(F.struct(F.col("lang").alias("source_agent"))).alias("metadata_json"))
    return I.normalized_documents(docs, ("source_agent",)).select("doc_id", F.md5(F.col("raw_text").cast("binary")).alias("m"), "source_agent", "refused")


@query("t_embed_gen", f"WITH {REVISIONS}, v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN source_version ELSE '~eg-v1:' || lpad(CAST(generation AS VARCHAR), 20, '0') || ':' || source_version END AS ver FROM revisions) SELECT event_id, CAST(nullif(regexp_extract(ver, '^~eg-v1:(\\d{{20}}):.+$', 1), '') AS BIGINT) AS generation FROM v")
def t_embed_gen(spark, sf_dir):
    version = F.when(F.col("event_id") % 3 == 0, F.col("source_version")).otherwise(F.concat(F.lit("~eg-v1:"), F.lpad(F.col("generation").cast("string"), 20, "0"), F.lit(":"), F.col("source_version")))
    return revisions(spark, sf_dir).select("event_id", I.generation_of(version).alias("generation"))


@query("t_source_version", f"""WITH {REVISIONS}, d AS (SELECT event_id, generation, sha256('["' || source_version || '","' || content_hash || '","' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'é\\"h' || event_id END || '","p1","' || sha256('r' || event_id) || '","' || CASE WHEN event_id % 5 = 0 THEN '1' ELSE '0' END || '","' || CASE WHEN event_id % 2 = 0 THEN event_id % 6 ELSE 0 END || '","local"]') AS digest FROM revisions)
SELECT event_id, CASE WHEN generation > 0 THEN '~eg-v1:' || lpad(CAST(generation AS VARCHAR), 20, '0') || ':' || digest ELSE digest END AS version FROM d""")  # fmt: skip
def t_source_version(spark, sf_dir):
    n = F.col("event_id")
    s = n.cast("string")
    version = I.source_version(F.col("generation"), F.col("source_version"), F.col("content_hash"), F.when(n % 3 != 0, F.concat(F.lit('é"h'), s)), F.lit("p1"), F.concat(F.lit("r"), s), F.when(n % 5 == 0, True), F.when(n % 2 == 0, n % 6), F.lit("local"))
    return revisions(spark, sf_dir).select("event_id", version.alias("version"))


@query("t_identity", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'own' || doc_id WHEN doc_id % 4 = 1 THEN source || '#chunk:' || doc_id WHEN doc_id % 4 = 2 THEN source ELSE 'generated:' || sha256(lang || chr(31) || substr(text, 1, 256)) END AS identity FROM documents")
def t_identity(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    found = ids.identity(source_identity=F.when(i % 4 == 0, F.concat(F.lit("own"), s)), source_path=F.when(i % 4 != 3, F.col("source")), chunk=F.when(i % 4 == 1, s), message_id=none, session_id=none, attribution=F.col("lang"), raw=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("identity"))


@query("t_split_large", "SELECT doc_id, CASE WHEN length(text) <= 6000 THEN 1 ELSE CAST(list_sum(list_transform(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), lambda p: ceil(length(p) / 6000.0))) AS INTEGER) END AS parts FROM documents")
def t_split_large(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(splitting.large_parts(F.col("text"))).alias("parts"))


@query("t_record_version", "SELECT doc_id, sha256(md5(text) || '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS version FROM documents")
def t_record_version(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.record_version(F.md5(F.col("text").cast("binary")), F.struct("lang", "source")).alias("version"))


@query("t_ascii_terms", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_.:/@+-]*')) AS term, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_.:/@+-]*'), 1) AS i FROM documents), f AS (SELECT doc_id, lower(term) AS k, min(i) AS i, arg_min(term, i) AS term FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS terms FROM r WHERE n <= 256 GROUP BY doc_id")
def t_ascii_terms(spark, sf_dir):
    found = T.ascii_terms(F.col("text"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("terms")).filter("terms <> ''")


_CJK = "'[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]'"


@query("t_shadow_state", f"WITH d AS (SELECT doc_id, regexp_replace(replace(replace(text, 'the', '検索'), 'an', '語'), '\\s+', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN (length(x) - length(regexp_replace(x, {_CJK}, '', 'g'))) / greatest(length(x), 1) > 0.1 THEN 'pending_provider' ELSE 'skipped_non_cjk' END AS state FROM d")
def t_shadow_state(spark, sf_dir):
    """Frequent syllables stand for CJK words here, so that both states occur."""
    body = F.replace(F.replace("text", F.lit("the"), F.lit("検索")), F.lit("an"), F.lit("語"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(T.cjk_ratio(body) > 0.1, "pending_provider").otherwise("skipped_non_cjk").alias("state"))


_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(text, '\bAKIA[0-9A-Z]{16}\b', '[REDACTED:AWS]', 'g'),
  '(?i)(\b(?:password|token|secret|api_key)\s*=\s*"?)[0-9a-f]{24,64}\b', '\1[REDACTED:Assignment]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----', '[REDACTED:PrivateKey]', 'g')"""


@query("t_redact", f"SELECT doc_id, md5({_REDACTED}) AS m FROM documents")
def t_redact(spark, sf_dir):
    return I.sanitized(table(spark, sf_dir, "documents")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))


@query("src_canonical", f"WITH {REVISIONS} SELECT source_identity, source_version, updated_at, value FROM (SELECT *, row_number() OVER (PARTITION BY source_identity ORDER BY updated_at DESC, source_version DESC) AS r FROM revisions) WHERE r = 1")
def src_canonical(spark, sf_dir):
    return I.latest_documents(revisions(spark, sf_dir)).select("source_identity", "source_version", "updated_at", "value")


@query("src_markdown", "SELECT doc_id, parts FROM (SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN regexp_full_match(split_part(text, chr(10), 1), '\\s*') THEN 1 ELSE 0 END AS BIGINT) AS parts FROM documents) WHERE parts > 0")
def src_markdown(spark, sf_dir):
    """Every line but the first made a heading: a section for each line, a blank first one left out."""
    marked = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n# ")).alias("body"))
    return splitting.sections(marked, "doc_id", "body").groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("src_validate", "SELECT conv_id, turn, (conv_id % 5 <> 0 AND turn <> 3) AS ok FROM conversations")
def src_validate(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("format"), F.concat(F.when(c % 5 == 0, "a:b").otherwise("s"), c.cast("string")).alias("session_id"), F.concat(F.lit("t"), t.cast("string")).alias("turn_uuid"), t.cast("long").alias("seq"), F.when(t == 3, "2026-01-01").otherwise("2026-01-01T00:00:00Z").alias("ts"), "role", F.lit("codex").alias("harness"), F.array(F.struct(F.lit("text").alias("block_type"), F.col("text"))).alias("blocks"))
    return turns.select("conv_id", "turn", I.valid_turn().alias("ok"))


@query("t_lang_gate", f"WITH {BLOCKS} SELECT session_id, seq, length(regexp_replace(text, '(?s)```.*?(```|$)', '', 'g')) AS chars FROM blocks WHERE block_type = 'text' AND role IN ('user', 'assistant')")
def t_lang_gate(spark, sf_dir):
    b = blocks(spark, sf_dir).filter(F.col("block_type").eqNullSafe("text") & F.col("role").isin("user", "assistant"))
    return b.select("session_id", "seq", F.char_length(T.prose(F.col("text"))).cast("long").alias("chars"))


def _grams(source: str) -> str:
    """SQL of the letter trigrams of ``body`` in ``source`` (its other columns go along)."""
    words = "regexp_extract_all(' ' || trim(regexp_replace(lower(body), '[^\\p{L}]+', ' ', 'g')) || ' ', '(?s).')"
    return f"(SELECT * EXCLUDE (body, c), unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM (SELECT *, {words} AS c FROM {source}))"


_LANGUAGE_MODEL = f"""known AS (SELECT lang, text AS body, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
taught AS (SELECT lang, body FROM known WHERE CAST('0x' || substr(md5(body), 1, 7) AS BIGINT) % n < 2000),
counts AS (SELECT lang, gram, count(*) AS n FROM {_grams("taught")} GROUP BY 1, 2),
chosen AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts) WHERE r <= 300),
filled AS (SELECT gram, lang, coalesce(n, 0) AS n FROM (SELECT * FROM chosen, (SELECT DISTINCT lang FROM known)) LEFT JOIN counts USING (gram, lang)),
model AS (SELECT gram, lang, CAST(round(1000 * ln((n + 1) / (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))) AS BIGINT) AS score FROM filled)"""


@query("t_lang", f"""WITH RECURSIVE {CHUNKS}, {_LANGUAGE_MODEL},
own AS (SELECT id, regexp_replace(text, '(?s)```.*?(```|$)', '', 'g') AS body FROM chunks WHERE block_type = 'text' AND split_idx = 0 AND role IN ('user', 'assistant') AND NOT (role = 'user' AND (starts_with(text, '<') OR starts_with(text, '#')))),
told AS (SELECT id, lang, sum(score) AS score FROM {_grams("own")} JOIN model USING (gram) GROUP BY 1, 2),
ranked AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS r FROM told WINDOW w AS (PARTITION BY id ORDER BY score DESC, lang DESC))
SELECT c.id, CASE WHEN second IS NULL OR score - second >= 2197 THEN lang END AS lang FROM chunks c LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (id)""")  # fmt: skip
def t_lang(spark, sf_dir):
    """The language of each chunk that has one, by a model learned from the labelled documents."""
    return L.block_languages(chunks(spark, sf_dir), L.learn(table(spark, sf_dir, "documents")), T.is_scaffolding(F.col("text")))


@query("t_scan", f"""WITH f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\bAKIA[0-9A-Z]{{16}}\\b'))) AS raw, 'AWS' AS detector FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)\\b(?:password|token|secret|api_key)\\s*=\\s*"?([0-9a-f]{{24,64}})\\b', 1))), 'Assignment' FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'))), 'PrivateKey' FROM documents),
g AS (SELECT doc_id, string_agg(detector, ' ' ORDER BY length(raw) DESC, raw) AS removed FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(removed, '') AS removed, false AS held, md5({_REDACTED}) AS m FROM documents d LEFT JOIN g USING (doc_id)""")  # fmt: skip
def t_scan(spark, sf_dir):
    """Secrets found by a scanner behind the seam, and taken out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = SC.excised(d.withColumn("findings", SC.scan(F.col("text"), SC.pattern_scanner)), "text")
    return out.select("doc_id", F.array_join("removed", " ").alias("removed"), "held", F.md5(F.col("text").cast("binary")).alias("m"))
