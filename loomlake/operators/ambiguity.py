"""Whether a query's hits call for a second, lexical pass: several of one source, and an identifier that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Hits looked at, characters of a query and of a hit's text, candidates, and the share of CJK signs.
HITS, QUERY_CHARS, TEXT_CHARS, CANDIDATES, SHARE = 6, 160, 8_000, 32, 0.15
#: What an identifier looks like, its length, that of its parts, and parts that tell of a secret.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[A-Za-z][A-Za-z0-9]{1,23}(?:[_-][A-Za-z0-9*]{1,24})+|[A-Za-z]{2,16}[0-9][A-Za-z0-9]{1,15})(?![A-Za-z0-9_])"
SHORTEST, LONGEST, PART = 3, 48, 24
SECRET_PARTS = ("bearer", "cookie", "credential", "credentials", "key", "passwd", "password", "secret", "token")
SECRET_BEGINNINGS = ("ghp", "githubpat", "sk", "xoxb", "xoxp")


def harmless(identifier: Column) -> Column:
    """Whether a lower-cased identifier is no credential by its parts or its length."""
    parts = F.filter(F.split(identifier, "[_-]"), lambda p: p != "")
    secret = F.exists(parts, lambda p: p.isin(*SECRET_PARTS)) | F.coalesce(F.get(parts, 0).isin(*SECRET_BEGINNINGS), F.lit(False))
    return F.char_length(identifier).between(SHORTEST, LONGEST) & ~secret & F.forall(parts, lambda p: F.char_length(p) <= PART)


def source_group(session: Column, parent: Column, path: Column) -> Column:
    """What tells where a hit comes from: the first of the three that isn't blank."""
    named = [F.when(X.trim_unicode(c) != "", F.concat(F.lit(n + ":"), X.trim_unicode(c))) for n, c in (("session_id", session), ("parent_session_id", parent), ("source_path", path))]
    return F.coalesce(*named)


def asks_for_words(raw: Column) -> Column:
    """Whether a query is in CJK signs by a fair share, short, and names no identifier itself."""
    return F.coalesce(raw.rlike(r"[\x{4E00}-\x{9FFF}]") & (X.cjk_ratio(raw) >= SHARE) & (F.char_length(raw) <= QUERY_CHARS) & ~raw.rlike(IDENTIFIER), F.lit(False))


def ambiguous(queries: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """``query_id, ambiguous``, a row for each of ``queries`` (``query_id, raw``; ids differ). ``hits``: ``query_id,
    rank, source_group, text``. True where the query asks for words, and among its first HITS hits two come from one
    source and two share a harmless identifier (of the first CANDIDATES that are seen). A query without hits isn't."""
    window = hits.filter(F.col("rank") <= HITS).join(queries.filter(asks_for_words(F.col("raw"))).select(query), query, "left_semi")
    repeated = window.filter("source_group is not null").groupBy(query, "source_group").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(query).distinct()
    found = window.select(query, "rank", F.posexplode(F.regexp_extract_all(F.left(F.coalesce("text", F.lit("")), F.lit(TEXT_CHARS)), F.lit(IDENTIFIER), F.lit(0))).alias("at", "name"))
    named = found.withColumn("name", F.lower("name")).filter(harmless(F.col("name")))
    seen = named.groupBy(query, "name").agg(F.min(F.struct("rank", "at")).alias("first"), F.countDistinct("rank").alias("hits"))  # at most HITS texts a query
    shared = seen.withColumn("_c", F.row_number().over(Window.partitionBy(query).orderBy("first"))).filter((F.col("_c") <= CANDIDATES) & (F.col("hits") >= 2)).select(query).distinct()
    both = repeated.join(shared, query).select(query, F.lit(True).alias("_both"))
    return queries.select(query).join(both, query, "left").select(query, F.coalesce("_both", F.lit(False)).alias("ambiguous"))
