"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph
from ..operators import joining as J
from ..operators import splitting
from .registry import query
from .tables import BLOCKS, CHUNKS, REVISIONS, blocks, chunks, revisions, table


@query("j_band_neighbors", f"""WITH RECURSIVE {CHUNKS}, hits AS (SELECT DISTINCT session_id, seq, turn_uuid FROM chunks WHERE seq = 3)
SELECT h.session_id, h.seq, string_agg(c.seq || ':' || c.split_idx || ':' || length(c.text), ',' ORDER BY c.seq, c.block_idx, c.split_idx) AS neighbors
FROM hits h JOIN chunks c ON c.session_id = h.session_id AND abs(c.seq - h.seq) <= 1 AND c.turn_uuid <> h.turn_uuid GROUP BY h.session_id, h.seq""")
def j_band_neighbors(spark, sf_dir):
    """Only blocks that can be hits or their neighbours are split; the filters reach the scan."""
    b = blocks(spark, sf_dir)
    hits = splitting.chunks(b.filter("seq = 3")).select("session_id", "seq", "turn_uuid").distinct()
    near = splitting.chunks(b.filter("seq between 2 and 4")).withColumn("text", F.concat_ws(":", F.col("seq").cast("string"), F.col("split_idx").cast("string"), F.char_length("text").cast("string")))
    out = J.neighbors(hits, near, 1)
    return out.select(F.col("h_session").alias("session_id"), F.col("h_seq").alias("seq"), F.array_join(F.transform("neighbors", lambda n: n["text"]), ",").alias("neighbors"))


@query("j_anti_new", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY o_custkey")
def j_anti_new(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return J.new_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), stored, "o_custkey", ["o_orderkey"])


@query("j_push_delta", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j_push_delta(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return J.delta(table(spark, sf_dir, "documents"), labels, labels.filter("toxic = 1"), "doc_id")


@query("j_rows_with_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def j_rows_with_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(wanted, "o_orderkey", "left_semi")


@query("j_unpushed", f"WITH RECURSIVE {CHUNKS} SELECT id FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE seq < 4)")
def j_unpushed(spark, sf_dir):
    c = chunks(spark, sf_dir).select("id", "seq")
    return c.join(c.filter("seq < 4").select("id"), "id", "left_anti").select("id")


@query("j_owed_sessions", f"WITH RECURSIVE {CHUNKS} SELECT DISTINCT session_id FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE seq < 4)")
def j_owed_sessions(spark, sf_dir):
    c = chunks(spark, sf_dir).select("id", "session_id", "seq")
    return J.owed(c, c.filter("seq < 4"), "id", "session_id")


@query("j_session_overlay", f"""WITH {BLOCKS}, owed AS (SELECT DISTINCT session_id FROM blocks WHERE seq = 6)
SELECT session_id, seq, 'remote' AS side FROM blocks WHERE session_id NOT IN (SELECT session_id FROM owed)
UNION ALL SELECT session_id, seq, 'local' FROM blocks WHERE session_id IN (SELECT session_id FROM owed)""")
def j_session_overlay(spark, sf_dir):
    b = blocks(spark, sf_dir).select("session_id", "seq")
    owed = b.filter("seq = 6").select("session_id").distinct()
    return J.overlay(b.withColumn("side", F.lit("local")), b.withColumn("side", F.lit("remote")), owed, "session_id")


@query("j_repo_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= DATE '1998-06-01'")
def j_repo_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate >= date '1998-06-01'").select("l_orderkey", "l_linenumber")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return rows.join(facts, "l_orderkey")


@query("j_fill_vectors", "SELECT doc_id, coalesce(quality, CASE WHEN n_chars > 1000 THEN -1 END) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def j_fill_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, -1).cast("int").alias("quality"))
    return J.filled_exactly(d, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id", "quality")


_UPSERT = f"""WITH {REVISIONS}, stored AS (SELECT source_identity, source_version FROM revisions WHERE event_id % 2 = 0), batch AS (SELECT source_identity, source_version FROM revisions WHERE event_id % 97 = 1)
SELECT * FROM stored WHERE source_identity NOT IN (SELECT source_identity FROM batch) UNION ALL SELECT * FROM batch"""


@query("j_upsert_docs", _UPSERT)
def j_upsert_docs(spark, sf_dir):
    r = revisions(spark, sf_dir).select("source_identity", "source_version", "event_id")
    return J.replaced(r.filter("event_id % 2 = 0").drop("event_id"), r.filter("event_id % 97 = 1").drop("event_id"), "source_identity")


_LATEST = "latest AS (SELECT source_identity, updated_at, source_version FROM (SELECT *, row_number() OVER (PARTITION BY source_identity ORDER BY updated_at DESC, source_version DESC) AS r FROM revisions WHERE event_id % 3 = 0) WHERE r = 1)"


@query("j_revision_select", f"""WITH {REVISIONS}, {_LATEST} SELECT r.event_id, CASE WHEN l.source_version IS NULL THEN 'changed' WHEN l.source_version = r.source_version THEN 'unchanged' WHEN (r.updated_at < l.updated_at OR (r.updated_at = l.updated_at AND r.source_version < l.source_version)) THEN 'stale' ELSE 'changed' END AS state
FROM revisions r LEFT JOIN latest l USING (source_identity)""")
def j_revision_select(spark, sf_dir):
    from ..operators.ingest import latest_documents

    r = revisions(spark, sf_dir).select("source_identity", "source_version", "updated_at", "content_hash", "event_id")
    return J.revision_state(r.drop("content_hash"), latest_documents(r.filter("event_id % 3 = 0"))).select("event_id", "state")


@query("j_get_many", "SELECT c_custkey, c_name, CAST(7 - (c_custkey % 8) AS INTEGER) AS place FROM customer WHERE c_custkey BETWEEN 8 AND 15")
def j_get_many(spark, sf_dir):
    ids = [*range(15, 7, -1), 15, 10**9]
    wanted = spark.createDataFrame([(ids,)], "ids array<long>").select(F.posexplode("ids").alias("place", "c_custkey"))
    return J.ordered_lookup(wanted, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", "place")


@query("j_presence", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS present FROM customer")
def j_presence(spark, sf_dir):
    return J.presence(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j_enqueue_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j_enqueue_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    remote = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(remote, "c_custkey", "left_anti").join(c.filter("c_acctbal < 0"), "c_custkey", "left_anti").select("c_custkey")


@query("j_owes_one", f"WITH {BLOCKS} SELECT count(*) > 0 AS owes FROM blocks WHERE session_id = 's2' AND seq >= 4")
def j_owes_one(spark, sf_dir):
    b = blocks(spark, sf_dir).filter("session_id = 's2'").select("turn_uuid", "seq")
    return b.join(b.filter("seq < 4").select("turn_uuid"), "turn_uuid", "left_anti").agg((F.count(F.lit(1)) > 0).alias("owes"))


@query("j_counts_left", "SELECT c_custkey, count(o_orderkey) AS n, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0) AS BIGINT) AS open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j_counts_left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("open"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"))


@query("j_cross_state", "SELECT lang, CAST(sum(CASE WHEN n_chars > m THEN 1 ELSE 0 END) AS BIGINT) AS longer FROM documents, (SELECT avg(n_chars) AS m FROM documents) GROUP BY lang")
def j_cross_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    state = d.agg(F.avg("n_chars").alias("m"))  # one row
    return d.crossJoin(F.broadcast(state)).groupBy("lang").agg(F.sum(F.when(F.col("n_chars") > F.col("m"), 1).otherwise(0)).alias("longer"))


@query("j_queue", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= DATE '1996-01-01' AND c_mktsegment = 'BUILDING' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def j_queue(spark, sf_dir):
    due = table(spark, sf_dir, "orders").filter("o_orderdate <= date '1996-01-01'")
    records = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return due.join(records, "o_custkey").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


_DIFF = """WITH b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderkey IS NULL THEN 'delete' WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'update' END AS change FROM b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey)"""


def _diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    after = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return J.table_diff(o.filter("o_orderkey % 10 <> 0"), after, "o_orderkey")


@query("j_table_diff", f"{_DIFF} SELECT o_orderkey, change FROM d WHERE change IS NOT NULL")
def j_table_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("a_tail_counts", f"{_DIFF} SELECT change, count(*) AS n FROM d WHERE change IS NOT NULL GROUP BY change")
def a_tail_counts(spark, sf_dir):
    return _diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35"


def _pairs(spark, sf_dir):
    """Within a session (here: a label) the units are compared pair by pair, in blocks."""
    return graph.similar_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35)


@query("j_allpairs_dup", _NEAR)
def j_allpairs_dup(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b")


@query("a_dup_groups", f"""WITH RECURSIVE e AS ({_NEAR}), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT w.node, b.b FROM walk w JOIN both_ b ON b.a = w.seen),
g AS (SELECT node, min(seen) AS root FROM walk GROUP BY node) SELECT node, root, count(*) OVER (PARTITION BY root) AS size FROM g""")
def a_dup_groups(spark, sf_dir):
    """Which vectors hang together: links between blocks, not all pairs, are what the components are made of."""
    found = graph.components(graph.similar_links(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35))
    size = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "root").select("node", "root", "size")


@query("j_gold_span", f"WITH {BLOCKS} SELECT b.session_id, b.seq FROM blocks b JOIN (SELECT session_id AS s, min(seq) + 1 AS f, min(seq) + 2 AS t FROM blocks GROUP BY session_id) g ON b.session_id = g.s AND b.seq BETWEEN g.f AND g.t WHERE b.role = 'assistant'")
def j_gold_span(spark, sf_dir):
    b = blocks(spark, sf_dir).select("session_id", "seq", "role")
    spans = b.groupBy(F.col("session_id").alias("span_session")).agg((F.min("seq") + 1).alias("span_from"), (F.min("seq") + 2).alias("span_to"))
    return J.within_spans(b.filter("role = 'assistant'"), spans).select("session_id", "seq")


@query("j_cas_update", f"""WITH {REVISIONS}, u AS (SELECT source_identity, source_version, content_hash, CASE WHEN event_id % 4 = 0 THEN generation ELSE generation + 1 END AS generation FROM revisions WHERE event_id % 2 = 0)
SELECT r.event_id, CASE WHEN u.source_version IS NULL THEN 'pending' ELSE 'indexed' END AS status FROM revisions r LEFT JOIN u ON r.source_identity = u.source_identity AND r.source_version = u.source_version AND r.content_hash = u.content_hash AND r.generation = u.generation""")
def j_cas_update(spark, sf_dir):
    r = revisions(spark, sf_dir).select("source_identity", "source_version", "content_hash", "generation", "event_id")
    u = r.filter("event_id % 2 = 0").withColumn("generation", F.when(F.col("event_id") % 4 == 0, F.col("generation")).otherwise(F.col("generation") + 1)).drop("event_id").withColumn("status", F.lit("indexed"))
    keys = ["source_identity", "source_version", "content_hash", "generation"]
    return J.compare_and_set(r.withColumn("status", F.lit("pending")), u, keys, "status").select("event_id", "status")


@query("u_intersect", "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey").intersect(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("u_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 200000")
def u_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_totalprice < 200000").select("o_custkey").distinct())


@query("u_pool_union", "SELECT id, min(pool) AS pool FROM (SELECT o_custkey AS id, 0 AS pool FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT c_custkey, 1 FROM customer) GROUP BY id")
def u_pool_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.lit(0).alias("pool"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("pool"))
    return J.first_per(a.unionByName(b), "id", ["pool"])


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))
