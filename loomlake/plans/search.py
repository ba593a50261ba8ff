"""Search: scoring, ranking, fusion, pages, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import postings as PO
from ..operators import searching as S
from ..operators import splitting
from .registry import query
from .tables import BLOCKS, REVISIONS, blocks, revisions, table

QUERY = "the thing of and"
VECTOR = [((i * 37) % 64 - 31.5) / 100 for i in range(64)]
_V = "[" + ", ".join(map(repr, VECTOR)) + "]::DOUBLE[]"
_VEC = f"SELECT vec_id, distance FROM (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + list_inner_product({_V}, {_V}) - 2 * list_inner_product(CAST(embedding AS DOUBLE[]), {_V}) AS distance FROM embeddings) ORDER BY distance, vec_id"


@query("k_vector", f"SELECT vec_id, round(distance, 6) AS distance FROM ({_VEC} LIMIT 20)")
def k_vector(spark, sf_dir):
    return S.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR, 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query("k_cosine_rank", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V}) DESC, vec_id LIMIT 20")
def k_cosine_rank(spark, sf_dir):
    return S.cosine_ranked(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR, 20).select("vec_id", F.round("score", 6).alias("score"))


def _bm25(where: str = "true", limit: int = 20) -> str:
    return f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE {where}),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
h AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN ('the', 'thing', 'of', 'and') GROUP BY 1, 2, 3),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score, count(*) AS terms FROM h JOIN d USING (term), stats GROUP BY doc_id),
t AS (SELECT doc_id, score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT {limit})"""


@query("k_bm25", f"WITH {_bm25('source <> ' + chr(39) + 'src3' + chr(39))} SELECT doc_id, round(score, 6) AS score FROM t")
def k_bm25(spark, sf_dir):
    out = S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, 20, F.col("source") != "src3")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("k_bm25_weighted", """WITH f AS (SELECT doc_id, 'text' AS field, 5.0 AS weight, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents UNION ALL SELECT doc_id, 'source', 2.0, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') FROM documents),
stats AS (SELECT field, count(*) AS n, avg(len(ws)) AS avgdl FROM f GROUP BY field),
h AS (SELECT doc_id, field, weight, dl, term, count(*) AS tf FROM (SELECT doc_id, field, weight, len(ws) AS dl, unnest(ws) AS term FROM f) WHERE term IN ('src0', 'the') GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY term),
s AS (SELECT doc_id, -sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score, count(DISTINCT term) AS terms FROM h JOIN d USING (term) JOIN stats USING (field) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM s WHERE terms = 2 ORDER BY round(score, 9), doc_id LIMIT 20)""")
def k_bm25_weighted(spark, sf_dir):
    out = S.bm25_fields(table(spark, sf_dir, "documents"), "doc_id", {"text": 5.0, "source": 2.0}, "src0 the", 20)
    return out.select("doc_id", F.round("score", 6).alias("score"))


_HYBRID = f"""WITH {_bm25(limit=30)}, v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM ({_VEC} LIMIT 30)),
x AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM t),
f AS (SELECT doc_id, CAST(sum(CAST(CAST(1.0 / (rank + 60) AS FLOAT) AS DOUBLE)) AS FLOAT) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM x) GROUP BY doc_id)
SELECT doc_id, round(CAST(score AS DOUBLE), 9) AS score FROM (SELECT * FROM f ORDER BY score DESC, doc_id LIMIT 30)"""


@query("k_hybrid", _HYBRID)
def k_hybrid(spark, sf_dir):
    """Nearest vectors and BM25 out of the stored index, fused; vectors stand for documents of the same number."""
    v = S.nearest(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", VECTOR, S.CANDIDATES)
    t = PO.search(spark, PO.of_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"), "doc_id", "bigint", QUERY, S.CANDIDATES)
    return S.hybrid(v, t, "doc_id").select("doc_id", F.round(F.col("score").cast("double"), 9).alias("score"))


_LISTS = "l AS (SELECT 0 AS list_idx, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, 'n' || (c_custkey % 40) AS identity FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER), CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'n' || (s_suppkey % 40) END FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50))"
_FUSED = f"{_LISTS}, o AS (SELECT list_idx, CASE WHEN identity = '' THEN 'anonymous:' || list_idx || ':' || rank ELSE identity END AS identity, rank FROM l), one AS (SELECT list_idx, identity, min(rank) AS rank FROM o GROUP BY 1, 2), f AS (SELECT identity, sum(1.0 / (60 + rank)) AS score, min(list_idx * 1000 + rank) AS seen FROM one GROUP BY identity), p AS (SELECT identity, score, row_number() OVER (ORDER BY round(score, 12) DESC, seen) AS place FROM f)"


def _fused(spark, sf_dir, limit):
    c = S.ranked(table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50), [F.desc("c_acctbal"), "c_custkey"])
    s = S.ranked(table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(50), [F.desc("s_acctbal"), "s_suppkey"])
    name = lambda k: F.concat(F.lit("n"), (F.col(k) % 40).cast("string"))
    lists = c.select(F.lit(0).alias("list_idx"), "rank", name("c_custkey").alias("identity")).unionByName(s.select(F.lit(1).alias("list_idx"), "rank", F.when(F.col("s_suppkey") % 9 == 0, "").otherwise(name("s_suppkey")).alias("identity")))
    return S.rrf_stable(lists, limit)


@query("k_rrf_stable", f"WITH {_FUSED} SELECT identity, round(score, 9) AS score, place FROM p WHERE place <= 25")
def k_rrf_stable(spark, sf_dir):
    return _fused(spark, sf_dir, 25).select("identity", F.round("score", 9).alias("score"), "place")


@query("k_rrf_native", "WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 60)), b AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS rank FROM (SELECT * FROM customer ORDER BY c_name DESC, c_custkey LIMIT 60)), f AS (SELECT k, CAST(sum(CAST(CAST(1.0 / (rank + 60) AS FLOAT) AS DOUBLE)) AS FLOAT) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k) SELECT k, round(CAST(score AS DOUBLE), 9) AS score FROM (SELECT * FROM f ORDER BY score DESC, k LIMIT 30)")
def k_rrf_native(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_name")
    lists = [S.ranked(c.orderBy(*o).limit(60), o, 0) for o in ([F.desc("c_acctbal"), "k"], [F.desc("c_name"), "k"])]
    return S.rrf_native(lists, "k", 30).select("k", F.round(F.col("score").cast("double"), 9).alias("score"))


@query("k_diverse", f"WITH {_FUSED}, g AS (SELECT identity, place, CASE WHEN identity LIKE 'anonymous%' THEN NULL ELSE right(identity, 1) END AS grp FROM p WHERE place <= 60), n AS (SELECT *, CASE WHEN grp IS NOT NULL AND row_number() OVER (PARTITION BY grp ORDER BY place) > 2 THEN 1 ELSE 0 END AS late FROM g) SELECT identity, row_number() OVER (ORDER BY late, place) AS place FROM n ORDER BY late, place LIMIT 20")
def k_diverse(spark, sf_dir):
    rows = _fused(spark, sf_dir, 60).withColumn("grp", F.when(~F.col("identity").startswith("anonymous"), F.right("identity", F.lit(1))))
    return S.diverse(rows, "grp", 20).select("identity", "place")


@query("k_pool", "WITH a AS (SELECT c_custkey AS k, c_acctbal AS score, 0 AS pool FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40), b AS (SELECT s_suppkey AS k, s_acctbal AS score, 1 AS pool FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 40), u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pool) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT k, pool FROM u WHERE r = 1 ORDER BY score DESC, pool, k LIMIT 30")
def k_pool(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "k").limit(40)
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("score")).orderBy(F.desc("score"), "k").limit(40)
    return S.pooled([a, b], "k", 30).select("k", "pool")


@query("k_like", f"WITH {REVISIONS} SELECT event_id FROM revisions WHERE contains(source_identity, '7/cl') ORDER BY updated_at DESC, event_id LIMIT 40")
def k_like(spark, sf_dir):
    return S.contains_newest(revisions(spark, sf_dir), "event_id", "source_identity", "7/cl", "updated_at", 40)


@query("k_local_like", "SELECT event_id FROM events WHERE contains(props, '1') ORDER BY ts DESC, event_id LIMIT 40")
def k_local_like(spark, sf_dir):
    return S.contains_newest(table(spark, sf_dir, "events"), "event_id", "props", "1", "ts", 40)


@query("k_term_score", "SELECT doc_id, score FROM (SELECT doc_id, n_chars, CAST(CASE WHEN contains(lower(text), 'license') THEN 7 ELSE 0 END + CASE WHEN contains(lower(text), 'apache') THEN 6 ELSE 0 END + CASE WHEN contains(lower(text), 'mit') THEN 3 ELSE 0 END AS INTEGER) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, n_chars DESC, doc_id LIMIT 50")
def k_term_score(spark, sf_dir):
    return S.term_score(table(spark, sf_dir, "documents"), "doc_id", "text", ["License", "Apache", "MIT"], "n_chars", 50)


@query("k_overlap_proxy", "WITH q AS (SELECT ['the', 'thing', 'of', 'license'] AS qs), d AS (SELECT doc_id, len(list_filter(qs, lambda x: list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), x))) / 4.0 AS score FROM documents, q) SELECT doc_id, round(score, 6) AS score FROM d ORDER BY score DESC, doc_id DESC LIMIT 30")
def k_overlap_proxy(spark, sf_dir):
    q = F.array(*[F.lit(x) for x in ("the", "thing", "of", "license")])
    d = table(spark, sf_dir, "documents").select("doc_id", S.overlap(q, T.words(F.col("text"))).alias("score"))
    return d.orderBy(F.desc("score"), F.desc("doc_id")).limit(30).select("doc_id", F.round("score", 6).alias("score"))


@query("k_page_recent", "SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def k_page_recent(spark, sf_dir):
    return S.page_of_recent(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], 50).select("event_id")


@query("k_get_range", f"""WITH {BLOCKS}, r AS (SELECT seq, trim(CASE block_type WHEN 'tool_use' THEN '[tool_use ' || coalesce(tool_name, 'None') || '] ' || text WHEN 'tool_result' THEN '[tool_result' || coalesce(' ' || tool_name, '') || '] ' || text ELSE text END, chr(10) || chr(13) || chr(9) || ' ') AS text FROM blocks WHERE session_id = 's5')
SELECT 's5' AS session_id, seq, md5(text) AS m, (SELECT count(*) FROM r WHERE text <> '') AS total FROM r WHERE text <> '' AND seq BETWEEN 1 AND 20""")  # fmt: skip
def k_get_range(spark, sf_dir):
    """A session asked for by the identity of its document, from its second turn on."""
    own = splitting.chunks(blocks(spark, sf_dir)).withColumn("source_identity", F.concat(F.lit("doc/"), "session_id"))
    turns = S.turn_range(own, "doc/s5", first=1)
    return turns.select("session_id", "seq", F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").cast("binary")).alias("m"), "total")


@query("k_scan", f"WITH {BLOCKS}, h AS (SELECT session_id, seq, block_idx, strpos(lower(text), 'th') - 1 AS place FROM blocks WHERE strpos(lower(text), 'th') > 0), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, block_idx) AS k, min(seq) OVER (PARTITION BY session_id) AS f FROM h), b AS (SELECT session_id, seq AS boundary FROM n WHERE k = 4) SELECT session_id, seq, block_idx, CAST(place AS INTEGER) AS place FROM n LEFT JOIN b USING (session_id) WHERE boundary IS NULL OR CASE WHEN f < boundary THEN seq < boundary ELSE k <= 3 END")
def k_scan(spark, sf_dir):
    return S.literal_hits(blocks(spark, sf_dir), "TH", True, 3).withColumnRenamed("at", "place")


@query("k_bounded_batch", "WITH r AS (SELECT doc_id, source, row_number() OVER w AS n, sum(n_chars) OVER w AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id FROM r WHERE n = 1 OR (n <= 8 AND s <= 20000)")
def k_bounded_batch(spark, sf_dir):
    return S.bounded_prefix(table(spark, sf_dir, "documents"), "source", ["doc_id"], F.col("n_chars"), 8, 20000).select("doc_id")


@query("k_token_estimate", "SELECT doc_id, CAST(floor((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) * 9 / 10) + 2 * length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + 32 AS BIGINT) AS tokens FROM documents")
def k_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))


@query("k_reconcile_pick", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END, o_orderdate, o_orderkey LIMIT 64")
def k_reconcile_pick(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    return o.orderBy(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0), "o_orderdate", "o_orderkey").limit(64).select("o_orderkey")


@query("k_equal_sample", "WITH t AS (SELECT max(doc_id) AS m FROM documents), i AS (SELECT DISTINCT CAST(floor(i * m / 99) AS BIGINT) AS doc_id FROM t, range(100) AS r(i)) SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM i)")
def k_equal_sample(spark, sf_dir):
    return S.equally_spaced(spark, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query("k_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def k_keyset(spark, sf_dir):
    return S.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 50)


@query("k_get", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 7 ORDER BY CASE WHEN c_name = 'Customer#000000007' THEN 0 ELSE 1 END, c_custkey LIMIT 1")
def k_get(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    own = F.col("c_name") == "Customer#000000007"
    return c.filter(own | (F.col("c_custkey") == 7)).orderBy(F.when(own, 0).otherwise(1), "c_custkey").limit(1)


@query("k_exact_only", f"WITH {REVISIONS} SELECT event_id FROM revisions WHERE source_identity = 'u7/click'")
def k_exact_only(spark, sf_dir):
    return revisions(spark, sf_dir).filter(F.col("source_identity") == "u7/click").select("event_id")


@query("k_sources", f"WITH {REVISIONS} SELECT source_identity, max(updated_at) AS updated_at FROM revisions GROUP BY source_identity ORDER BY max(updated_at) DESC, source_identity LIMIT 100")
def k_sources(spark, sf_dir):
    return revisions(spark, sf_dir).groupBy("source_identity").agg(F.max("updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), "source_identity").limit(100)


@query("k_pending_translate", "SELECT event_id FROM events WHERE event_id % 3 = 1 AND NOT (event_id % 4 = 0) ORDER BY ts, event_id LIMIT 30")
def k_pending_translate(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("updated_at"), F.when(n % 3 == 1, "pending_provider").when(n % 3 == 2, "ok").alias("shadow_status"), F.when(n % 4 == 0, "waiting_durability").when(n % 4 == 1, "indexed").alias("index_status"))
    return S.pending_shadows(rows, "event_id", 30).select("event_id")


@query("k_valid_vectors", "SELECT count(*) FILTER (WHERE len(embedding) = 64) AS valid, count(*) AS n FROM embeddings")
def k_valid_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count_if(V.valid(F.col("embedding"), 64)).alias("valid"), F.count(F.lit(1)).alias("n"))
