"""What a service over the store does: search routes, reranking, versions of a table, cycles of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import predicates as P
from ..operators import searching as S
from ..sources import store
from ..streaming import cycles as C
from .registry import query
from .streams import _SECRET
from .tables import BLOCKS, REVISIONS, blocks, revisions, table

# ---- search

_FIELDS = """WITH f AS (SELECT doc_id, 'text' AS field, 5.0 AS weight, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents UNION ALL SELECT doc_id, 'source', 2.0, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') FROM documents),
stats AS (SELECT field, count(*) AS n, avg(len(ws)) AS avgdl FROM f GROUP BY field),
h AS (SELECT doc_id, field, weight, dl, term, count(*) AS tf FROM (SELECT doc_id, field, weight, len(ws) AS dl, unnest(ws) AS term FROM f) WHERE term IN ('src1', 'of') GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY term),
s AS (SELECT doc_id, -sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score, count(DISTINCT term) AS terms FROM h JOIN d USING (term) JOIN stats USING (field) GROUP BY doc_id)"""


@query("k_search_cascade", f"{_FIELDS} SELECT doc_id, 0 AS route, CAST(row_number() OVER (ORDER BY round(score, 9), doc_id) AS INTEGER) AS place FROM s WHERE terms = 2 ORDER BY place LIMIT 25")
def k_search_cascade(spark, sf_dir):
    """The first route answers."""
    return S.search_cascade(table(spark, sf_dir, "documents"), "doc_id", {"text": 5.0, "source": 2.0}, "n_chars", "src1 of", 25)


@query("k_search_fallback", "SELECT doc_id, 3 AS route, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents WHERE contains(coalesce(text, '') || ' ' || coalesce(source, ''), ', t') ORDER BY place LIMIT 100")
def k_search_fallback(spark, sf_dir):
    """Signs are no words: the query is looked for as it is, and the limit is clamped to 100."""
    return S.search_cascade(table(spark, sf_dir, "documents"), "doc_id", {"text": 5.0, "source": 2.0}, "n_chars", ", t", 5000)


@query("k_search_cjk", """WITH d AS (SELECT doc_id, n_chars, replace(text, 'ion', '検索') || ' ' || source AS x FROM documents),
t AS (SELECT doc_id, n_chars, x, row_number() OVER (ORDER BY CASE WHEN contains(lower(x), 'zzqxw') THEN 9 ELSE 0 END DESC, n_chars DESC, doc_id) AS place FROM d WHERE contains(lower(x), 'zzqxw')),
c AS (SELECT doc_id, 4 AS route, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM d WHERE contains(x, '検') OR contains(x, '索') ORDER BY place LIMIT 30) SELECT * FROM c WHERE (SELECT count(*) FROM t) = 0""")
def k_search_cjk(spark, sf_dir):
    """Neither the words nor the identifier of the query are there: any of its CJK signs is."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("ion"), F.lit("検索")))
    return S.search_cascade(d, "doc_id", {"text": 5.0, "source": 2.0}, "n_chars", "zzqxw検索", 30)


@query("k_search_facets", """WITH d AS (SELECT doc_id, n_chars, text, source, replace(text, 'ion', '検索') || ' ' || source AS x FROM documents WHERE source = 'src2'),
f AS (SELECT doc_id, 'text' AS field, 5.0 AS weight, regexp_extract_all(lower(replace(text, 'ion', '検索')), '[\\p{L}\\p{N}]+') AS ws FROM d UNION ALL SELECT doc_id, 'source', 2.0, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') FROM d),
stats AS (SELECT field, count(*) AS n, avg(len(ws)) AS avgdl FROM f GROUP BY field),
h AS (SELECT doc_id, field, weight, dl, count(*) AS tf FROM (SELECT doc_id, field, weight, len(ws) AS dl, unnest(ws) AS term FROM f) WHERE term = 'with' GROUP BY 1, 2, 3, 4),
c AS (SELECT count(DISTINCT doc_id) AS df FROM h),
s AS (SELECT doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM h JOIN stats USING (field), c GROUP BY doc_id),
p AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM s ORDER BY 2 LIMIT 60),
g AS (SELECT p.doc_id, row_number() OVER (ORDER BY CASE WHEN contains(x, '検索') THEN 2 ELSE 0 END DESC, p.place) AS place FROM p JOIN d USING (doc_id))
SELECT doc_id, 1 AS route, CAST(place AS INTEGER) AS place FROM g ORDER BY place LIMIT 15""")  # fmt: skip
def k_search_facets(spark, sf_dir):
    """The source is asked for by the filter, so its name is no word of the question; 'with' is."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("ion"), F.lit("検索")))
    return S.search_cascade(d, "doc_id", {"text": 5.0, "source": 2.0}, "n_chars", "src2 with 検索", 15, F.col("source") == "src2", facets=("src2",))


@query("k_overfetch", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 36")
def k_overfetch(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(S.candidate_limit(12)).select("c_custkey")


@query("k_rerank", "WITH p AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30) SELECT c_custkey, round(1 / (1 + exp(-(c_custkey % 17 - 8.0))), 9) AS relevance FROM p ORDER BY c_custkey % 17 DESC, c_custkey LIMIT 8")
def k_rerank(spark, sf_dir):
    """A scorer's logits over a pool that is larger than what is asked."""
    pool = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30)
    return S.reranked(pool, "c_custkey", "c_acctbal", 8, F.col("c_custkey") % 17 - 8).select("c_custkey", F.round("relevance", 9).alias("relevance"))


@query("k_rerank_failed", "WITH p AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30) SELECT c_custkey FROM p ORDER BY CAST(c_acctbal AS DOUBLE) DESC, c_custkey LIMIT 8")
def k_rerank_failed(spark, sf_dir):
    """A scorer that gives no score for a row: the order before it stays."""
    pool = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30)
    return S.reranked(pool, "c_custkey", "c_acctbal", 8, F.when(F.col("c_acctbal") < F.lit(1e9), F.lit(None).cast("double")).otherwise(1.0)).select("c_custkey")


@query("k_bm25_stored", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents), stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w), h AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN ('the', 'and', 'license') GROUP BY 1, 2, 3), d AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN d USING (term), stats GROUP BY doc_id ORDER BY round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) DESC, doc_id LIMIT 20")
def k_bm25_stored(spark, sf_dir):
    """Out of a term index that is written first; later questions read its folders only."""
    path = store.shared_folder(spark, "postings")
    S.write_postings(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return S.bm25_stored(spark, path, "doc_id", "the license and", 20).select("doc_id", F.round("score", 6).alias("score"))


# ---- texts


@query("text_shadow_query", f"WITH {BLOCKS}, k AS (SELECT session_id, seq, array_to_string(list_filter([CASE WHEN contains(text, 'the') THEN 'article' END, CASE WHEN contains(text, 'qu') THEN 'question' END], lambda x: x IS NOT NULL), ' ') AS known, array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.*:/-]+'), ' ') AS own FROM blocks) SELECT session_id, seq, md5(CASE WHEN known = '' AND own = '' THEN 'none' WHEN known = '' OR own = known THEN own WHEN own = '' THEN known ELSE known || ' ' || own END) AS m FROM k")
def text_shadow_query(spark, sf_dir):
    q = T.shadow_query(F.col("text"), {"the": "article", "qu": "question"}, "none")
    return blocks(spark, sf_dir).select("session_id", "seq", F.md5(q.cast("binary")).alias("m"))


@query("text_valid_rewrite", f"WITH {BLOCKS}, n AS (SELECT session_id, seq, text, replace(text, '1', '2') AS new FROM blocks) SELECT session_id, seq, len(list_filter(regexp_extract_all(text, 'https?://\\S+|(?:[~/]|\\.{{1,2}}/)[^\\s]+|[A-Za-z][A-Za-z0-9_.*:/-]*'), lambda e: NOT contains(new, e))) = 0 AND list_sort(regexp_extract_all(text, '\\d+(?:\\.\\d+)*')) = list_sort(regexp_extract_all(new, '\\d+(?:\\.\\d+)*')) AS ok FROM n")
def text_valid_rewrite(spark, sf_dir):
    """Rewrites with another digit for some of the numbers."""
    new = F.replace("text", F.lit("1"), F.lit("2"))
    return blocks(spark, sf_dir).select("session_id", "seq", T.valid_rewrite(F.col("text"), new).alias("ok"))


@query("text_sort_key", "SELECT doc_id, md5(replace(source || chr(92) || lang, chr(92), chr(92) || chr(92))) AS m FROM documents")
def text_sort_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sort_key(F.concat("source", F.lit("\\"), "lang"))).alias("m"))


@query("f_legacy_auto", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 1 AND doc_id % 7 > 1")
def f_legacy_auto(spark, sf_dir):
    i = F.col("doc_id")
    agent, kind = F.when(i % 3 == 0, "Codex").when(i % 3 == 1, "pi"), F.when(i % 2 == 0, "MEMORY").otherwise("note")
    folder = F.when(i % 5 == 1, "C:\\u\\.codex\\sessions\\").otherwise("C:\\u\\.codex\\Automations\\")
    path = F.concat(folder, i.cast("string"), F.when(i % 7 == 0, ".MD").when(i % 7 == 1, ".toml").otherwise(".jsonl"))
    return table(spark, sf_dir, "documents").filter(P.legacy_automation(agent, kind, path)).select("doc_id")


@query("t_convert", "SELECT conv_id, turn, '{\"session_id\":\"s' || conv_id || '\",\"turn_uuid\":\"t' || turn || '@v' || (conv_id % 3) || '\",\"seq\":' || turn || '}' AS value FROM conversations")
def t_convert(spark, sf_dir):
    """Turns of a vendor's log as lines of the open format, the version in the turn's id."""
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("turn_uuid"), F.col("turn").alias("seq"), "conv_id", "turn")
    line = store.turn_lines(turns.select("session_id", "turn_uuid", "seq", "conv_id"), F.concat(F.lit("v"), (F.col("conv_id") % 3).cast("string")))
    parsed = line.select(F.regexp_replace("value", r',"conv_id":[0-9]+', "").alias("value"), F.get_json_object("value", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("value", "$.seq").cast("long").alias("turn"))
    return parsed.select("conv_id", "turn", "value")


# ---- tables with versions


@query("sink_create", "SELECT n_nationkey, n_name FROM nation")
def sink_create(spark, sf_dir):
    s = store.Store(spark, store.shared_folder(spark, "create"))
    s.create(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return s.read()


@query("sink_append", "SELECT o_orderkey, o_custkey FROM orders")
def sink_append(spark, sf_dir):
    s, o = store.Store(spark, store.shared_folder(spark, "append")), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s.create(o.filter("o_orderkey % 2 = 0"))
    s.append(o.filter("o_orderkey % 2 = 1"))
    return s.read()


@query("sink_overwrite", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def sink_overwrite(spark, sf_dir):
    s, o = store.Store(spark, store.shared_folder(spark, "overwrite")), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s.create(o)
    s.overwrite(o.filter("o_orderkey % 3 = 0"))
    return s.read()


@query("scan_rows_with_ids", "SELECT doc_id AS row_id, source, n_chars FROM documents WHERE lang = 'en'")
def scan_rows_with_ids(spark, sf_dir):
    return store.rows_with_ids(table(spark, sf_dir, "documents"), "doc_id", ["source", "n_chars"], F.col("lang") == "en")


@query("src_discover", None)
def src_discover(spark, sf_dir):
    """The files of the tables, without those of two of them."""
    found = store.discover(spark, [sf_dir], "*.parquet", ["lineitem", "embeddings"])
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size")


@query("src_limit_recent", None)
def src_limit_recent(spark, sf_dir):
    return store.signature(store.most_recent(store.files(spark, sf_dir, "*.parquet"), 5)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "signature")


@query("st_compaction", "WITH f AS (SELECT doc_id AS fragment, n_chars AS n_rows, doc_id % 4 <> 0 AS indexed FROM documents), a AS (SELECT count(*) FILTER (WHERE indexed AND n_rows < 4096) > 256 AS whole FROM f) SELECT fragment, n_rows < 4096 AND (NOT indexed OR whole) AS \"merge\" FROM f, a")
def st_compaction(spark, sf_dir):
    """Documents stand for the fragments of a store here."""
    fragments = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fragment"), F.col("n_chars").alias("n_rows"), (F.col("doc_id") % 4 != 0).alias("indexed"))
    return store.compaction_plan(fragments)


@query("st_compacted", "SELECT o_orderkey, o_custkey FROM orders")
def st_compacted(spark, sf_dir):
    """A compaction that was planned before an append lands beside it."""
    s, o = store.Store(spark, store.shared_folder(spark, "compact")), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s.create(o.filter("o_orderkey % 3 = 0"))
    planned = s.append(o.filter("o_orderkey % 3 = 1"))
    s.append(o.filter("o_orderkey % 3 = 2"))
    s.compact(1, planned)
    return s.read()


_OPERATIONS = {"click": "append", "view": "reserve", "signup": "config"}


@query("st_replay", "WITH l AS (SELECT user_id AS branch, event_id AS version, CASE event_type WHEN 'click' THEN 'append' WHEN 'view' THEN 'reserve' WHEN 'signup' THEN 'config' ELSE 'overwrite' END AS operation FROM events), p AS (SELECT user_id AS plan, user_id AS branch, max(event_id) - 2 * user_id AS \"read\" FROM events GROUP BY user_id) SELECT plan, coalesce(bool_and(operation IN ('append', 'config', 'reserve') OR version <= \"read\"), true) AS lands FROM p LEFT JOIN l USING (branch) GROUP BY plan")
def st_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.lit("overwrite")
    for k, v in _OPERATIONS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    log = e.select(F.col("user_id").alias("branch"), F.col("event_id").alias("version"), kind.alias("operation"))
    plans = e.groupBy(F.col("user_id").alias("plan")).agg((F.max("event_id") - 2 * F.first("user_id")).alias("read")).withColumn("branch", F.col("plan"))
    return store.replayable(log, plans)


# ---- cycles

_LINES = "l AS (SELECT user_id AS source, event_id AS line, CASE WHEN event_id % 97 <> 0 THEN sum(length(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id) END AS until FROM events)"


@query("st_cursor", f"WITH {_LINES} SELECT source, line, CASE WHEN source % 5 = 0 OR source % 7 = 0 THEN 'full' ELSE 'tail' END AS mode FROM l WHERE until IS NOT NULL AND (source % 5 = 0 OR source % 7 = 0 OR until > 200)")
def st_cursor(spark, sf_dir):
    """Files of a user's events: some are new, some were replaced, the others were read up to byte 200."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    until = F.sum(F.char_length("props") + 1).over(Window.partitionBy("user_id").orderBy("event_id"))
    lines = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 97 != 0, until).alias("until"))
    files = e.select(F.col("user_id").alias("source")).distinct().withColumn("inode", F.col("source") + 1000)
    cursors = files.filter("source % 5 <> 0").select("source", F.when(F.col("source") % 7 == 0, 1).otherwise(F.col("inode")).alias("inode"), F.lit(200).alias("offset"))
    return C.tails(lines, files, cursors)


@query("st_missing", "SELECT o_custkey AS source, o_orderkey AS record FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 5 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0)")
def st_missing(spark, sf_dir):
    """Records that a full reading of their source no longer has."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("record"))
    return C.gone(stored, stored.filter("source % 2 = 0 and record % 5 <> 0"), ["record"])


@query("st_budgeted", "SELECT event_id FROM (SELECT event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events)) WHERE spent < 100")
def st_budgeted(spark, sf_dir):
    """Each owner's pending rows by tier, until the budget is used up."""
    e = table(spark, sf_dir, "events").withColumn("tier", F.when(F.col("event_type") == "click", 0).otherwise(1))
    return C.within_budget(e, "user_id", ["tier", "event_id"], F.floor("value"), 100).select("event_id")


_CYCLE = f"""WITH {REVISIONS}, d AS (SELECT doc_id AS event_id, text FROM documents), claimed AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN source_version || 'x' ELSE source_version END AS source_version, generation FROM revisions),
c AS (SELECT r.event_id, r.source_version, r.generation, coalesce({_SECRET}, false) AS secret, coalesce(text, '') = '' OR r.event_id % 11 = 0 AS invalid FROM revisions r LEFT JOIN d USING (event_id) WHERE r.event_id % 13 <> 0),
o AS (SELECT a.event_id, CASE WHEN c.event_id IS NULL OR a.source_version <> c.source_version OR a.generation <> c.generation THEN 'superseded' WHEN c.secret THEN 'held_secret' WHEN c.invalid THEN 'held_invalid' ELSE 'indexed' END AS status FROM claimed a LEFT JOIN c USING (event_id))"""


def _cycle(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    r = revisions(spark, sf_dir).select("event_id", "source_version", "generation")
    claimed = r.withColumn("source_version", F.when(F.col("event_id") % 6 == 0, F.concat("source_version", F.lit("x"))).otherwise(F.col("source_version")))
    current = r.filter("event_id % 13 <> 0").join(d, "event_id", "left")
    secret = F.coalesce(I.has_secret(F.col("text")), F.lit(False))
    invalid = (F.coalesce("text", F.lit("")) == "") | (F.col("event_id") % 11 == 0)
    return C.reconcile(claimed, current, "event_id", ["source_version", "generation"], invalid, secret)


@query("st_reconcile", f"{_CYCLE} SELECT event_id, status FROM o")
def st_reconcile(spark, sf_dir):
    """Claimed revisions against what is stored now; a revision's document has its number."""
    return _cycle(spark, sf_dir)


@query("st_settled", f"{_CYCLE}, b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'pending' ELSE 'failed' END AS status FROM events) SELECT b.event_id, CASE WHEN o.status = 'superseded' THEN b.status ELSE o.status END AS status FROM b JOIN o USING (event_id)")
def st_settled(spark, sf_dir):
    before = F.when(F.col("event_id") % 3 == 0, "indexed").when(F.col("event_id") % 3 == 1, "pending").otherwise("failed")
    stored = table(spark, sf_dir, "events").select("event_id", before.alias("status"))
    return C.settled(stored, _cycle(spark, sf_dir), "event_id")
