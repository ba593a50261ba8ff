"""Ranked search: exact vectors, BM25 over a postings table, fusion of rankings, scans and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vectors as V

K1, B = 1.2, 0.75
RANK_CONSTANT = 60
CANDIDATES, HITS = 30, 8


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """``key, distance`` of the k nearest by L2; the filter holds before the cut. Each task keeps its own k."""
    wanted = rows.filter(F.col(vector).isNotNull() if where is None else where & F.col(vector).isNotNull())
    return wanted.select(key, V.l2_squared(F.col(vector), V.literal(query)).alias("distance")).orderBy("distance", key).limit(k)


def cosine_ranked(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    return rows.select(key, V.cosine(F.col(vector), V.literal(query)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def query_terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def postings(rows: DataFrame, key: str, body: str) -> DataFrame:
    """``term, key, tf, dl``: the term index; ``write_postings`` keeps it. A text's words are counted in its row, by
    where each stretch of equal ones begins in their order, so that nothing is exchanged."""
    words = rows.select(key, F.sort_array(text.words(F.col(body))).alias("_w"))
    placed = F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    first = words.withColumn("_f", F.filter(placed, lambda p: (p["i"] == 0) | (p["w"] != F.get(F.col("_w"), p["i"] - 1))))
    dl = F.size("_w").cast("long")
    end = lambda j: F.coalesce(F.get(F.col("_f"), j + 1)["i"], F.size("_w"))
    each = first.select(key, dl.alias("dl"), F.explode(F.transform("_f", lambda p, j: F.struct(p["w"].alias("term"), (end(j) - p["i"]).cast("long").alias("tf")))).alias("_t"))
    return each.select("_t.term", key, "dl", "_t.tf")


#: Folders that a stored term index is dealt to by a hash of the term: a query reads those of its terms.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame, key: str, body: str, path: str) -> None:
    """The term index of ``rows`` under ``path``: postings in BUCKETS folders, sorted by term, so that a file's
    statistics skip what a query doesn't ask for; and one row of the number of documents and of words. Dealing them to
    the folders is the only exchange."""
    words = rows.select(key, text.words(F.col(body)).alias("_w"))
    words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_w").cast("double")).alias("avgdl")).write.parquet(f"{path}/stats")
    found = postings(rows, key, body).withColumn("bucket", _bucket(F.col("term")))
    # a frequent term's postings are dealt to several tasks by document
    found.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{path}/postings")


def bm25_stored(spark: SparkSession, path: str, key: str, query: str, k: int, require_all: bool = False) -> DataFrame:
    """``bm25`` out of a stored term index: no text is read, only the folders of the query's terms."""
    terms = query_terms(query)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()] if terms else []
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select(key, "term", F.col("dl").cast("double").alias("dl"), "tf")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats"))).groupBy(key).agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("_terms"))
    return (out.filter(F.col("_terms") == len(terms)) if require_all else out).select(key, "score").orderBy(F.desc(F.round("score", 9)), key).limit(k)


def _counted(rows: DataFrame, key: str, fields: list[str], terms: list[str]) -> DataFrame:
    """``key, c``: of each field its number of words and how often each term occurs. These few numbers a document are
    exchanged once, and both the statistics and the scores read them there: every text is read and parted once."""

    def one(words: Column) -> Column:
        often = lambda hit, t: F.size(F.filter(hit, lambda x: x == t)).cast("double")
        each = lambda hit: F.array(*[often(hit, t) for t in terms])
        few = F.transform(F.array(F.filter(words, lambda x: x.isin(terms))), each)[0]
        return F.struct(F.size(words).cast("double").alias("dl"), few.alias("tf"))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.array(*[text.words(F.col(f)) for f in fields])
    return rows.select(key, F.transform(words, one).alias("c")).repartition(n, key)


def _scored(counted: DataFrame, key: str, weights: list[float], terms: list[str]) -> DataFrame:
    """``key, score, found``: the weighted sum of BM25, and the number of terms that a document has in any field."""
    fields, each = range(len(weights)), range(len(terms))
    has = lambda c, i: F.exists(c, lambda f: f["tf"][i] > 0)
    # the key is counted, not the rows, so that both readers of the exchange want the same columns
    stats = counted.agg(F.count(F.struct(key)).alias("n"), F.array(*[F.avg(F.col("c")[f]["dl"]) for f in fields]).alias("avgdl"), F.array(*[F.count_if(has(F.col("c"), i)) for i in each]).alias("df"))
    parts = []
    for f in fields:
        for i in each:
            tf, dl, avg, df = F.col("c")[f]["tf"][i], F.col("c")[f]["dl"], F.col("avgdl")[f], F.col("df")[i]
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            parts.append(F.when(tf > 0, weights[f] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))).otherwise(0.0))
    score = parts[0]
    for x in parts[1:]:
        score = score + x
    found = sum((has(F.col("c"), i).cast("int") for i in each), F.lit(0))
    # what no term is in has the score 0; the test needs the statistics, so it stays behind the exchange
    return counted.crossJoin(F.broadcast(stats)).select(key, score.alias("score"), found.alias("found")).filter("score > 0")


def bm25(rows: DataFrame, key: str, body: str, query: str, k: int, where: Column | None = None, require_all: bool = False) -> DataFrame:
    """``key, score``: BM25 over the rows that pass ``where``; any term matches, or all where asked. A query without
    words finds nothing."""
    terms = query_terms(query)
    base = rows if where is None else rows.filter(where)
    if not terms:
        return base.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    out = _scored(_counted(base, key, [body], terms), key, [1.0], terms)
    if require_all:
        out = out.filter(F.col("found") == len(terms))
    return out.select(key, "score").orderBy(F.desc(F.round("score", 9)), key).limit(k)


def bm25_fields(rows: DataFrame, key: str, fields: dict[str, float], query: str, k: int) -> DataFrame:
    """Weighted sum of BM25 over several fields, all terms required somewhere; lower is better."""
    terms = query_terms(query)
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    out = _scored(_counted(rows, key, list(fields), terms), key, list(fields.values()), terms)
    return out.filter(F.col("found") == len(terms)).select(key, (-F.col("score")).alias("score")).orderBy(F.round("score", 9), key).limit(k)


def ranked(rows: DataFrame, order: list, first: int = 1) -> DataFrame:
    """A cut ranking (a few hundred rows at most) with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1 + first)


def rrf_native(lists: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Sum of 1 / (rank + 60), ranks from 0, in single precision: scores that are equal there go by key. ``lists``: two
    of ``key, rank``. The sum of two single numbers is exact in double precision, so its order doesn't matter."""
    rows = lists[0].select(key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(key, "rank"))
    part = (1.0 / (F.col("rank") + RANK_CONSTANT)).cast("float").cast("double")
    return rows.groupBy(key).agg(F.sum(part).cast("float").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def rrf_stable(lists: DataFrame, limit: int) -> DataFrame:
    """``identity, score, place``: ranks from 1, an identity counts once a list, ties by where it was seen first.

    ``lists``: ``list_idx, rank, identity``; a blank identity is one of its own.
    """
    own = F.coalesce(F.when(F.trim("identity") != "", F.col("identity")), F.concat_ws(":", F.lit("anonymous"), F.col("list_idx").cast("string"), F.col("rank").cast("string")))
    once = lists.withColumn("identity", own).groupBy("list_idx", "identity").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("identity").agg(F.sum(1.0 / (RANK_CONSTANT + F.col("rank"))).alias("score"), F.min(F.struct("list_idx", "rank")).alias("seen"))
    top = fused.orderBy(F.desc(F.round("score", 12)), "seen").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "seen"))).select("identity", "score", "place")


def diverse(fused: DataFrame, group: str, limit: int) -> DataFrame:
    """The third and later results of a group go behind all others. ``fused`` is cut and has ``place``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy("place"))
    late = F.coalesce((n > 2) & F.col(group).isNotNull(), F.lit(False))
    rows = fused.withColumn("_late", late).orderBy("_late", "place").limit(limit)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_late", "place"))).drop("_late")


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, key: str, candidates: int = CANDIDATES) -> DataFrame:
    """Two cut rankings fused. ``vector_hits``: ``key, distance``; ``text_hits``: ``key, score``."""
    v = ranked(vector_hits, ["distance", key], 0)
    t = ranked(text_hits, [F.desc(F.round("score", 9)), key], 0)
    return rrf_native([v, t], key, candidates)


def pooled(pools: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Candidates of several stores: an id counts in its first pool, then by score. Each pool is cut already."""
    rows = pools[0].withColumn("pool", F.lit(0))
    for i, p in enumerate(pools[1:], 1):
        rows = rows.unionByName(p.withColumn("pool", F.lit(i)))
    first = rows.groupBy(key).agg(F.min_by(F.struct("score", "pool"), "pool").alias("_r")).select(key, "_r.*")
    return first.orderBy(F.desc(F.round("score", 12)), "pool", key).limit(limit)


def term_score(rows: DataFrame, key: str, body: str, terms: list[str], newest: str, k: int) -> DataFrame:
    """Sum of min(32, length) over the terms a text has, then the newest."""
    low = F.lower(F.col(body))
    score = sum((F.when(low.contains(t.lower()), min(32, len(t))).otherwise(0) for t in terms), F.lit(0))
    return rows.select(key, newest, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), F.desc(newest), key).limit(k).select(key, "score")


def contains_newest(rows: DataFrame, key: str, body: str, needle: str, newest: str, k: int) -> DataFrame:
    return rows.filter(F.col(body).contains(needle)).orderBy(F.desc(newest), key).limit(k).select(key)


def overlap(a: Column, b: Column) -> Column:
    """Share of the query's distinct words that a text has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))


def page_of_recent(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page from the newest end, oldest first; ``order`` is a total order, ascending."""
    return rows.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(limit).orderBy(*order)


def literal_hits(blocks: DataFrame, needle: str, ignore_case: bool, cap: int) -> DataFrame:
    """``session_id, seq, block_idx, at``: the first occurrence in each whole block, in reading order, cut at a turn
    boundary where more than ``cap`` are found (where one turn alone has more, at the cap)."""
    body = F.lower("text") if ignore_case else F.col("text")
    at = F.locate(needle.lower() if ignore_case else needle, body)
    hits = blocks.withColumn("at", at - 1).filter("at >= 0").select("session_id", "seq", "block_idx", "at")
    w = Window.partitionBy("session_id").orderBy("seq", "block_idx")
    numbered = hits.withColumn("_n", F.row_number().over(w))
    boundary = numbered.filter(F.col("_n") == cap + 1).select(F.col("session_id").alias("_s"), F.col("seq").alias("_boundary"))
    cut = numbered.join(boundary, F.col("session_id") == F.col("_s"), "left")
    whole = F.min("seq").over(Window.partitionBy("session_id"))
    kept = F.col("_boundary").isNull() | F.when(whole < F.col("_boundary"), F.col("seq") < F.col("_boundary")).otherwise(F.col("_n") <= cap)
    return cut.withColumn("_k", kept).filter("_k").select("session_id", "seq", "block_idx", "at")


def bounded_prefix(rows: DataFrame, group: str, order: list[str], size: Column, most_rows: int, most_size: int) -> DataFrame:
    """The prefix of each group's order within both bounds; the first row is always taken."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_s", F.sum(size).over(w))
    return out.filter((F.col("_n") == 1) | ((F.col("_n") <= most_rows) & (F.col("_s") <= most_size))).drop("_n", "_s")


def estimated_tokens(body: Column) -> Column:
    """Nine tenths of the ASCII characters, 2 for each other, and 32."""
    n = F.char_length(body)
    other = F.char_length(F.regexp_replace(body, r"[\x00-\x7F]", ""))
    return (F.floor((n - other) * 9 / 10) + 2 * other + 32).cast("long")


def greedy_batches(rows: DataFrame, group: str, key: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """``batch`` number of each row within its group: a batch ends before the row that would break a bound.

    A fold in key order within a group (a producer's outbox); larger inputs are dealt into more groups.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        batch, n, s, out = 0, 0, 0, []
        for x in pdf[size].tolist():
            if n and (n >= most_rows or s + x > most_size):
                batch, n, s = batch + 1, 0, 0
            n, s = n + 1, s + x
            out.append(batch)
        return pdf.assign(batch=out)

    schema = rows.schema.simpleString()[7:-1] + ",batch:int"
    return rows.groupBy(group).applyInPandas(fold, ", ".join(f.replace(":", " ", 1) for f in schema.split(",")))


def matched_length(body: Column, terms: list[str]) -> Column:
    return sum((F.when(body.contains(t), len(t)).otherwise(0) for t in terms), F.lit(0))


def any_char(body: Column, characters: str) -> Column:
    out = F.lit(False)
    for c in dict.fromkeys(characters):
        out |= body.contains(c)
    return out


#: What an identifier is made of, what may end it without being part of it, what makes it stand out.
ENTITY, ENTITY_ENDS, ENTITY_MARKS = r"[A-Za-z][A-Za-z0-9_.*:/-]+", "*:-/", r"[0-9_/:]"


def query_entities(c: Column) -> Column:
    """Array of the identifiers of a query that stand out, lower-cased, each once."""
    plain = F.transform(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), lambda m: F.rtrim(F.lower(m), F.lit(ENTITY_ENDS)))
    return F.array_distinct(F.filter(plain, lambda m: m.rlike(ENTITY_MARKS)))


def has_entities(body: Column, entities: Column) -> Column:
    """Whether there are any and all stand in the text as whole words, whatever their case."""
    word = lambda e: F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), e, F.lit(r"\E(?![A-Za-z0-9_])"))
    return (F.size(entities) > 0) & F.forall(entities, lambda e: F.rlike(body, word(e)))


def candidate_limit(limit: int) -> int:
    """Candidates of each route for ``limit`` results of all: three times as many, 100 at most."""
    return min(3 * max(limit, 1), 100)


def reranked(rows: DataFrame, key: str, fused: str, limit: int, score: Column | None = None, logits: bool = True) -> DataFrame:
    """``rows`` (a cut pool) with ``relevance``, the ``limit`` best: the scorer's, logits made shares of 1; the fused
    score where there is no scorer, where it fails for a row of the pool (null), or the pool isn't larger than asked."""
    if score is None:
        return rows.withColumn("relevance", F.col(fused).cast("double")).orderBy(F.desc("relevance"), key).limit(limit)
    given = text.sigmoid(score.cast("double")) if logits else score.cast("double")
    pool = rows.withColumn("_given", given)
    said = pool.agg(((F.count(F.lit(1)) > limit) & (F.count("_given") == F.count(F.lit(1)))).alias("_use"))
    out = pool.crossJoin(F.broadcast(said)).withColumn("relevance", F.when(F.col("_use"), F.col("_given")).otherwise(F.col(fused).cast("double")))
    return out.drop("_given", "_use").orderBy(F.desc("relevance"), key).limit(limit)


def search_cascade(rows: DataFrame, key: str, fields: dict[str, float], newest: str, query: str, limit: int = 20, where: Column | None = None, broad: bool = True, facets: tuple[str, ...] = ()) -> DataFrame:
    """``key, route, place``: the results of the first routes that find any, at most ``limit`` (1 to 100).

    Routes: all words by weighted BM25 (0); for a query with CJK signs also its ASCII identifiers, any of them, as
    words (1), and in front of both, if no result has them all, as parts of the text (2); of these, those with more of
    the query's CJK grams come first. If nothing is found, a query that isn't plain words is looked for as it is (3),
    then any of its CJK signs (4). Identifiers that only repeat what ``where`` asks for (``facets``: its values) are left
    out, unless there are no others. The last three read all texts, so ``broad`` can turn them off. Each route is cut
    before it meets the others; whether one found anything is asked by one row.
    """
    import re

    limit = max(1, min(limit, 100))
    base = rows if where is None else rows.filter(where)
    whole = F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    seen = base.select(key, newest, whole.alias("_all"))
    strict = re.search(r"[^\w\s]", query) is not None  # signs are no words: the strict route can't take them
    none = base.select(key).filter(F.lit(False)).select(key, F.lit(0).alias("place"))
    place = lambda df, order: df.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(key, "place")
    first = none if strict else place(bm25_fields(base, key, fields, query, limit), [F.round("score", 9), key])
    cjk = [c for c in dict.fromkeys(query) if re.match("[㐀-䶿一-鿿豈-﫿]", c)]
    found = first.withColumn("route", F.lit(0))
    if cjk:
        given = {f.lower() for f in facets}
        terms = list({t.lower(): t for t in re.findall(text.ASCII_TERM, query)}.values())
        terms = [t for t in terms if t.lower() not in given] or terms
        if terms:
            words = sorted({w for t in terms for w in query_terms(t)})
            wide = min(100, max(32, 4 * limit))
            second = _scored(_counted(base, key, list(fields), words), key, list(fields.values()), words).orderBy(F.desc(F.round("score", 9)), key).limit(wide)
            found = found.unionByName(place(second, [F.desc(F.round("score", 9)), key]).withColumn("route", F.lit(1)))
            if broad:
                low = F.lower("_all")
                score = sum((F.when(low.contains(t.lower()), min(32, len(t))).otherwise(0) for t in terms), F.lit(0))
                every = F.lit(True)
                for t in terms:
                    every &= low.contains(t.lower())
                covered = seen.join(found.select(key), key, "left_semi").agg(F.coalesce(F.bool_or(every), F.lit(False)).alias("_covered"))
                third = seen.select(key, newest, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), F.desc(newest), key).limit(min(100, 4 * limit))
                third = place(third, [F.desc("score"), F.desc(newest), key]).crossJoin(F.broadcast(covered)).filter("not _covered").select(key, "place", F.lit(-1).alias("route"))
                found = found.unionByName(third)
        once = found.groupBy(key).agg(F.min(F.struct("route", "place")).alias("at")).join(seen, key)
        grams = text.cjk_grams(F.lit(query))
        near = F.aggregate(grams, F.lit(0), lambda a, g: a + F.when(F.col("_all").contains(g), F.char_length(g)).otherwise(0))
        found = once.withColumn("_near", near).withColumn("place", F.row_number().over(Window.orderBy(F.desc("_near"), "at"))).select(key, "place", F.when(F.col("at.route") < 0, 2).otherwise(F.col("at.route")).alias("route"))
    out = found.orderBy("place").limit(limit)
    if not broad or not (strict or cjk):
        return out.select(key, "route", "place")
    some = out.agg((F.count(F.lit(1)) > 0).alias("_some"))

    def fallback(before: DataFrame, hit: Column, route: int) -> DataFrame:
        hits = seen.filter(hit).orderBy(F.desc(newest), key).limit(limit)
        return place(hits, [F.desc(newest), key]).crossJoin(F.broadcast(before)).filter("not _some").select(key, "place", F.lit(route).alias("route"))

    if strict:
        out = out.unionByName(fallback(some, F.col("_all").contains(query), 3))
        some = out.agg((F.count(F.lit(1)) > 0).alias("_some"))
    if cjk:
        out = out.unionByName(fallback(some, any_char(F.col("_all"), "".join(cjk)), 4))
    return out.select(key, "route", "place")


#: Turns that a reading without an end gives (fixed value).
SPAN = 20


def turn_range(chunks: DataFrame, name: str, first: int | None = None, last: int | None = None, span: int = SPAN) -> DataFrame:
    """Whole turns of the session ``name`` from seq ``first`` (its least) to ``last`` (``span`` from the first), and
    ``total``, the number of its turns. Where no chunk has that session, it is the document of that
    ``source_identity``. Unknown names give no rows."""
    from .splitting import turns_of

    own = chunks.withColumn("_by", F.when(F.col("session_id") == name, 0).when(F.col("source_identity") == name, 1)).filter("_by is not null")
    found = own.groupBy("_by").agg(F.countDistinct("seq", "turn_uuid").alias("total"), F.min("seq").alias("least")).orderBy("_by").limit(1)  # of two rows
    begin = F.col("least") if first is None else F.lit(first)
    end = begin + span - 1 if last is None else F.lit(last)
    kept = own.join(F.broadcast(found), "_by").filter(F.col("seq").between(begin, end))
    return turns_of(kept).crossJoin(F.broadcast(found.select("total")))


#: The state of a shadow that waits for its provider, and of an index entry that waits.
PENDING_SHADOW, HELD_INDEX = "pending_provider", "waiting_durability"


def pending_shadows(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` (1 at least) rows that have waited longest for their shadow, but for those whose index entry is
    held."""
    waits = (F.col("shadow_status") == PENDING_SHADOW) & (F.coalesce("index_status", F.lit("")) != HELD_INDEX)
    return rows.filter(waits).orderBy("updated_at", key).limit(max(1, limit))


def keyset_page(rows: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def equally_spaced(spark: SparkSession, rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` equally spaced ids of ``0..max``, both ends among them."""
    top = rows.agg(F.max(key).alias("m"))
    ids = top.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "m").select(F.floor(F.col("i") * F.col("m") / (n - 1)).alias(key)).distinct()
    return rows.join(ids, key, "left_semi")
