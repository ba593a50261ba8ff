"""Hydration, reuse, gates, batches, running totals, and what only a row count can hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ambiguity as AM
from ..operators import duplicates as DU
from ..operators import ingest as I
from ..operators import joining as J
from ..operators import searching as S
from ..operators import vectors as VO
from .ingest import _REDACTED
from .registry import query
from .tables import BLOCKS, CHUNKS, REVISIONS, blocks, revisions, table


@query("j_fts_rows", "SELECT doc_id, source, n_chars FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'apache')")
def j_fts_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = S.postings(d, "doc_id", "text").filter("term = 'apache'").select("doc_id")
    return d.select("doc_id", "source", "n_chars").join(hits, "doc_id", "left_semi")


@query("j_hydrate", "WITH h AS (SELECT o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT place, c_custkey, c_name FROM h JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def j_hydrate(spark, sf_dir):
    """Ranked ids to current rows; rows that are gone leave the ranking."""
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    ranked = S.ranked(top, [F.desc("o_totalprice"), "o_orderkey"]).select(F.col("rank").alias("place"), F.col("o_custkey").alias("c_custkey"))
    return ranked.join(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey").select("place", "c_custkey", "c_name")


@query("j_revalidate", f"WITH {REVISIONS}, claimed AS (SELECT event_id, source_identity, CASE WHEN event_id % 6 = 0 THEN source_version || 'x' ELSE source_version END AS source_version, content_hash, generation FROM revisions) SELECT c.event_id FROM claimed c JOIN revisions r ON c.event_id = r.event_id AND c.source_identity = r.source_identity AND c.source_version = r.source_version AND c.content_hash = r.content_hash AND c.generation = r.generation")
def j_revalidate(spark, sf_dir):
    r = revisions(spark, sf_dir).select("event_id", "source_identity", "source_version", "content_hash", "generation")
    claimed = r.withColumn("source_version", F.when(F.col("event_id") % 6 == 0, F.concat("source_version", F.lit("x"))).otherwise(F.col("source_version")))
    return claimed.join(r, r.columns, "left_semi").select("event_id")


@query("j_embed_cache", f"WITH {BLOCKS} SELECT session_id, seq, (session_id || seq) IS NOT NULL AND seq % 2 = 0 AS reused FROM blocks")
def j_embed_cache(spark, sf_dir):
    b = blocks(spark, sf_dir).select(F.col("turn_uuid").alias("id"), "session_id", "seq", "text")
    stored = b.filter("seq % 2 = 0").select("id", "text", F.array(F.lit(9.0).cast("float")).alias("vector"))
    return VO.with_reuse(b, stored, "id", "text").select("session_id", "seq", (F.col("vector")[0] == 9.0).alias("reused"))


@query("t_stable_identity", f"WITH {BLOCKS} SELECT session_id, seq, sha256(session_id || chr(31) || role || chr(31) || md5(text)) AS identity FROM blocks")
def t_stable_identity(spark, sf_dir):
    parts = F.concat_ws("\x1f", "session_id", "role", F.md5(F.col("text").cast("binary")))
    return blocks(spark, sf_dir).select("session_id", "seq", F.sha2(parts, 256).alias("identity"))


@query("t_canonical_doc", f"WITH {REVISIONS} SELECT event_id, 'ref:' || rtrim(replace(replace(to_base64(encode(source_identity)), '+', '-'), '/', '_'), '=') AS session_ref FROM revisions")
def t_canonical_doc(spark, sf_dir):
    return revisions(spark, sf_dir).select("event_id", F.concat(F.lit("ref:"), T.base64url(F.col("source_identity"))).alias("session_ref"))


_PLANTED = "left(text, 600) || ' password = ' || md5(session_id || seq) || ' ' || substr(text, 601)"


@query("t_resplit", f"""WITH RECURSIVE {BLOCKS.replace("blocks AS", "raw AS", 1)}, planted AS (SELECT * REPLACE ({_PLANTED} AS text) FROM raw), blocks AS (SELECT * REPLACE ({_REDACTED} AS text) FROM planted){CHUNKS[len(BLOCKS):]} SELECT session_id, seq, id, md5(text) AS m FROM chunks WHERE length(text) > 0""")
def t_resplit(spark, sf_dir):
    """Whole blocks with a secret in their midst are redacted and then split anew under their own identity, so that the
    cuts lie elsewhere behind it."""
    from ..operators import splitting

    secret = F.md5(F.concat("session_id", F.col("seq").cast("string")).cast("binary"))
    b = blocks(spark, sf_dir).withColumn("text", F.concat(F.left("text", F.lit(600)), F.lit(" password = "), secret, F.lit(" "), F.substr("text", F.lit(601))))
    return splitting.chunks(I.sanitized(b)).select("session_id", "seq", "id", F.md5(F.col("text").cast("binary")).alias("m"))


@query("t_embed", None)
def t_embed(spark, sf_dir):
    return blocks(spark, sf_dir).select("session_id", "seq", VO.embed(F.col("text")).alias("vector"))


@query("t_meta_canonical", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k":' || regexp_extract(props, '(\\d+)', 1) || '}' WHEN 1 THEN '{"a":[2.5,{"é":true}],"k":{"A":null,"b":' || regexp_extract(props, '(\\d+)', 1) || '}}' ELSE '"no json ' || event_id || '"' END AS props FROM events""")
def t_meta_canonical(spark, sf_dir):
    """Properties as they are, with nested, unsorted keys and a raw text, and what is no JSON."""
    k, n = F.regexp_extract("props", r"(\d+)", 1), F.col("event_id")
    nested = F.concat(F.lit('{"raw_text": "x", "k": {"b": '), k, F.lit(', "A": null}, "a": [2.5, {"raw_text": 1, "\\u00e9": true}]}'))
    props = F.when(n % 3 == 0, F.col("props")).when(n % 3 == 1, nested).otherwise(F.concat(F.lit("no json "), n.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", I.canonical_json(props).alias("props"))


@query("k_cjk_rerank", "SELECT doc_id, CAST(CASE WHEN contains(text, 'the') THEN 3 ELSE 0 END + CASE WHEN contains(text, 'ing') THEN 3 ELSE 0 END + CASE WHEN contains(text, 'é') THEN 1 ELSE 0 END AS INTEGER) AS score FROM documents ORDER BY 2 DESC, doc_id LIMIT 40")
def k_cjk_rerank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.matched_length(F.col("text"), ["the", "ing", "é"]).alias("score"))
    return d.orderBy(F.desc("score"), "doc_id").limit(40)


@query("k_cjk_chars", "SELECT doc_id FROM documents WHERE contains(text, 'ß') OR contains(text, 'ñ')")
def k_cjk_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(S.any_char(F.col("text"), "ßñ")).select("doc_id")


@query("k_exact_entities", "WITH t AS (SELECT text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3) SELECT coalesce(bool_or(regexp_matches(text, '(^|[^A-Za-z0-9_])gpl-3\\.0([^A-Za-z0-9_]|$)')), false) AS hit FROM t")
def k_exact_entities(spark, sf_dir):
    top = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(3)
    return top.agg(F.coalesce(F.bool_or(S.has_entities(F.col("text"), S.query_entities(F.lit("is it gpl-3.0 or")))), F.lit(False)).alias("hit"))


@query("k_token_batches", """WITH RECURSIVE d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id,
  CAST(floor((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) * 9 / 10) + 2 * length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + 32 AS BIGINT) AS t FROM documents),
w AS (SELECT source, k, doc_id, t AS s, 1 AS n, 0 AS batch FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.k, d.doc_id, CASE WHEN w.n >= 16 OR w.s + d.t > 30000 THEN d.t ELSE w.s + d.t END, CASE WHEN w.n >= 16 OR w.s + d.t > 30000 THEN 1 ELSE w.n + 1 END, w.batch + CASE WHEN w.n >= 16 OR w.s + d.t > 30000 THEN 1 ELSE 0 END
  FROM w JOIN d ON d.source = w.source AND d.k = w.k + 1) SELECT doc_id, batch FROM w""")
def k_token_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))
    return S.greedy_batches(d, "source", "doc_id", "tokens", 16, 30000).select("doc_id", "batch")


@query("k_ambiguity", """WITH n AS (SELECT max(item_id) + 1 AS n FROM benchmark), q AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN '检索方法' WHEN 1 THEN 'plain words' WHEN 2 THEN '检索 conf_1' WHEN 3 THEN repeat('检索', 90) ELSE 'in 检索 方法' END AS raw, item_id FROM benchmark),
h AS (SELECT doc_id % n AS query_id, row_number() OVER (PARTITION BY doc_id % n ORDER BY doc_id) AS rank, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN 'p' || doc_id END AS grp,
  ['see', 'conf_' || (doc_id % 11), 'or', 'api-key', 'node' || (doc_id % 23) || 'x', 'x1'] AS words FROM documents, n),
w AS (SELECT h.* FROM h JOIN q USING (query_id) WHERE rank <= 6 AND item_id % 5 IN (0, 4)),
r AS (SELECT DISTINCT query_id FROM (SELECT query_id, grp FROM w WHERE grp IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)),
s AS (SELECT DISTINCT query_id FROM (SELECT query_id, name FROM (SELECT DISTINCT query_id, rank, unnest(words) AS name FROM w) WHERE regexp_full_match(name, '[A-Za-z][A-Za-z0-9]{1,23}([_-][A-Za-z0-9*]{1,24})+|[A-Za-z]{2,16}[0-9][A-Za-z0-9]{1,15}') AND name <> 'api-key' GROUP BY 1, 2 HAVING count(*) >= 2))
SELECT query_id, query_id IN (SELECT query_id FROM r) AND query_id IN (SELECT query_id FROM s) AS ambiguous FROM q""")  # fmt: skip
def k_ambiguity(spark, sf_dir):
    """Queries of five kinds over hits of which some share a source or an identifier."""
    i = F.col("item_id")
    items = table(spark, sf_dir, "benchmark")
    raw = F.when(i % 5 == 0, "检索方法").when(i % 5 == 1, "plain words").when(i % 5 == 2, "检索 conf_1").when(i % 5 == 3, "检索" * 90).otherwise("in 检索 方法")
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").crossJoin(F.broadcast(items.agg((F.max("item_id") + 1).alias("n"))))
    group = F.when(d % 3 == 0, F.col("source")).when(d % 3 == 1, F.concat(F.lit("p"), d.cast("string")))
    body = F.concat(F.lit("see conf_"), (d % 11).cast("string"), F.lit(" or api-key node"), (d % 23).cast("string"), F.lit("x x1"))
    hits = docs.select((d % F.col("n")).alias("query_id"), F.row_number().over(Window.partitionBy(d % F.col("n")).orderBy("doc_id")).alias("rank"), group.alias("source_group"), body.alias("text"))
    return AM.ambiguous(items.select(i.alias("query_id"), raw.alias("raw")), hits)


@query("k_ivfpq", None)
def k_ivfpq(spark, sf_dir):
    """The ten nearest rows, itself among them, of every row whose id is divisible by 100, by the index."""
    e = table(spark, sf_dir, "embeddings")
    index = VO.ProductIndex.fit(e, "embedding")
    stored = VO.coded(e, "vec_id", "embedding", index)
    found = VO.index_search(stored, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), index)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"))


def units(spark, sf_dir):
    """Every vector, a near copy of each third one, and in each label a hub: a quarter of its vectors drawn close to
    the label's first one."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("h"))
    moved = lambda a, b, t: F.zip_with(a, b, lambda x, y: x + F.lit(t) * y)
    copies = e.filter("vec_id % 3 = 0").join(after, "vec_id").select("label", (F.col("vec_id") + 1000000).alias("key"), moved("v", "w", 0.15).alias("v"))
    hub = e.filter("vec_id % 4 = 1").join(F.broadcast(first), "label").select("label", (F.col("vec_id") + 2000000).alias("key"), moved("h", "v", 0.05).alias("v"))
    return e.select("label", F.col("vec_id").alias("key"), "v").unionByName(copies).unionByName(hub)


_MIX = "(({x}) :: UHUGEINT * {c} :: UHUGEINT % 18446744073709551616 :: UHUGEINT) :: UBIGINT"
_STEP = "((({x}) :: UHUGEINT + 11400714819323198485 :: UHUGEINT) % 18446744073709551616 :: UHUGEINT) :: UBIGINT"
#: The directions as SplitMix64 gives them, the units, and the number of each band.
_UNITS = f"""e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS h FROM e GROUP BY label),
units AS (SELECT label, vec_id AS key, v FROM e
  UNION ALL SELECT e.label, e.vec_id + 1000000, list_transform(list_zip(e.v, w.v), lambda z: z[1] + 0.15 * z[2]) FROM e JOIN e w ON w.vec_id = e.vec_id + 1 WHERE e.vec_id % 3 = 0
  UNION ALL SELECT label, vec_id + 2000000, list_transform(list_zip(h, v), lambda z: z[1] + 0.05 * z[2]) FROM e JOIN f USING (label) WHERE vec_id % 4 = 1),
s0 AS (SELECT p, d, ((p :: UHUGEINT * 11400714819323198485 :: UHUGEINT + d :: UHUGEINT + 7640891576956012809 :: UHUGEINT) % 18446744073709551616 :: UHUGEINT) :: UBIGINT AS x FROM range(80) a(p), range(64) b(d)),
s1 AS (SELECT p, d, {_STEP.format(x="x")} AS x FROM s0), s2 AS (SELECT p, d, {_MIX.format(x="xor(x, x >> 30)", c="13787848793156543929")} AS x FROM s1), s3 AS (SELECT p, d, {_MIX.format(x="xor(x, x >> 27)", c="10723151780598845931")} AS x FROM s2),
planes AS (SELECT p, list(CASE WHEN xor(x, x >> 31) % 2 = 0 THEN -1.0 :: DOUBLE ELSE 1.0 END ORDER BY d) AS plane FROM s3 GROUP BY p),
bands AS (SELECT key, p // 10 AS band, CAST(sum(CASE WHEN list_inner_product(v, plane) >= 0 THEN 1 << (p % 10) ELSE 0 END) AS INTEGER) AS h FROM units, planes GROUP BY 1, 2)"""


@query("j_lsh_dup", f"""WITH RECURSIVE {_UNITS}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key) AS at FROM units),
shared AS (SELECT DISTINCT a.key AS a, b.key AS b FROM bands a JOIN bands b USING (band, h) WHERE a.key < b.key),
edges AS (SELECT a.key AS a, b.key AS b FROM placed a JOIN placed b ON a.label = b.label AND a.key < b.key LEFT JOIN shared s ON s.a = a.key AND s.b = b.key WHERE list_cosine_similarity(a.v, b.v) >= 0.97 AND (s.a IS NOT NULL OR abs(a.at - b.at) <= 16)),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), walk AS (SELECT key AS node, key AS seen FROM units UNION SELECT w.node, x.b FROM walk w JOIN both_ x ON x.a = w.seen),
g AS (SELECT node, min(seen) AS root FROM walk GROUP BY node) SELECT node AS key, root, count(*) OVER (PARTITION BY root) AS size FROM g""")  # fmt: skip
def j_lsh_dup(spark, sf_dir):
    """Classes of near-duplicates by window and bands, hubs compared in blocks."""
    return DU.classes(units(spark, sf_dir), "label", "key", ["key"], "v")


@query("d_simhash", f"WITH {_UNITS} SELECT key, string_agg(CAST(h AS VARCHAR), ' ' ORDER BY band) AS bands FROM bands GROUP BY key")
def d_simhash(spark, sf_dir):
    return units(spark, sf_dir).select("key", F.array_join(DU.band_keys(F.col("v")).cast("array<string>"), " ").alias("bands"))


@query("a_block_vector", "WITH e AS (SELECT label, vec_id % 3 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, sum(CAST(x AS DOUBLE) * w) / sum(w) AS v FROM e GROUP BY 1, 2) SELECT label, round(sqrt(sum(v * v)) / sqrt(sum(v * v)), 6) AS norm, round(max(v) / sqrt(sum(v * v)), 6) AS most FROM m GROUP BY label")
def a_block_vector(spark, sf_dir):
    v = VO.block_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding", F.col("vec_id") % 3 + 1)
    return v.select("label", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.array_max("vector"), 6).alias("most"))


@query("a_cumulative_metrics", "WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM c")
def a_cumulative_metrics(spark, sf_dir):
    cycles = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return cycles.select("day", F.sum("n").over(Window.orderBy("day")).alias("total"))  # one row a day


@query("a_run_summary", f"WITH {BLOCKS} SELECT count(DISTINCT session_id) AS sessions, count(*) AS blocks_, count(*) FILTER (WHERE text = '') AS skipped FROM blocks")
def a_run_summary(spark, sf_dir):
    return blocks(spark, sf_dir).agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("blocks_"), F.count_if(F.col("text") == "").alias("skipped"))


@query("d_clamp", """WITH d AS (SELECT doc_id, doc_id % 60 - 3 AS u0, n_chars * 4 AS c0 FROM documents), c AS (SELECT *, least(greatest(c0, 1000), 40000) AS c FROM d), u AS (SELECT *, least(greatest(u0, 1), 40, greatest(c // 240, 1)) AS u FROM c)
SELECT doc_id, u AS units, c AS chars, CASE WHEN u <> u0 THEN u END AS units_changed, CASE WHEN c <> c0 THEN c END AS chars_changed FROM u""")  # fmt: skip
def d_clamp(spark, sf_dir):
    from ..operators.digest import clamped

    return table(spark, sf_dir, "documents").select("doc_id", clamped(F.col("doc_id") % 60 - 3, F.col("n_chars") * 4).alias("c")).select("doc_id", "c.*")


@query("p_public", "SELECT doc_id, lang FROM documents")
def p_public(spark, sf_dir):
    return J.public_columns(table(spark, sf_dir, "documents").withColumnsRenamed({"text": "raw_text", "source": "_source"}).drop("n_chars"))
