"""A stored word index whose blocks tell the most that any of their documents can score.

Documents are dealt into ranges of about RANGE by a hash of their key. A block holds a term's documents of one range,
those with the greatest impact first, and the greatest impact; blocks lie in folders by a hash of their term. A question
adds up the bounds of its terms' blocks range by range, scores the ranges with the greatest bounds, and then only those
whose bound reaches the score of the k-th document found there: the others hold none of the best k, so what is left
out changes nothing. No text is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .searching import B, K1, postings, query_terms

#: Documents of a range, about; ranges that a question scores first; folders.
RANGE, FIRST, BUCKETS = 256, 8, 64
#: Scores are compared to nine digits.
DIGITS = 9


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def write_index(rows: DataFrame, key: str, body: str, path: str, range_docs: int = RANGE) -> None:
    """The index of ``rows`` (keys differ) under ``path``: ``blocks``, and of each term ``df`` and the table's numbers.

    A null text has no words but counts as a document. An empty table gives an index in which nothing is found."""
    words = rows.select(key, F.coalesce(text.words(F.col(body)), F.array().cast("array<string>")).alias("_w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("_w").cast("double")), F.lit(0.0)).alias("avgdl")).first()
    ranges = max(1, -(-stats["n"] // range_docs))
    tf = postings(rows, key, body).withColumn("range", F.pmod(F.xxhash64(key), F.lit(ranges)))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl").cast("double") / F.lit(stats["avgdl"] or 1.0)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the only exchange, by some of what the blocks are grouped by; a frequent term's blocks are dealt to several tasks
    dealt = tf.select(_bucket(F.col("term")).alias("bucket"), (F.col("range") % 8).alias("_r"), "term", "range", impact.alias("impact"), F.col(key).alias("key")).repartition(n, "bucket", "_r")
    best = F.sort_array(F.collect_list(F.struct("impact", "key")), asc=False)  # of one range
    blocks = dealt.groupBy("bucket", "_r", "term", "range").agg(best.alias("docs")).select("bucket", "term", "range", F.col("docs")[0]["impact"].alias("most"), "docs")
    blocks.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/blocks")
    found = rows.sparkSession.read.schema(f"bucket int, term string, docs array<struct<impact: double, key: {rows.schema[key].dataType.simpleString()}>>").parquet(f"{path}/blocks")
    terms = found.groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df")).select("term", "bucket", "df", F.lit(stats["n"]).cast("long").alias("n"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")  # a file's statistics tell its terms


def search(spark: SparkSession, path: str, key: str, kind: str, query: str, k: int, first: int = FIRST) -> DataFrame:
    """``key, score``: the k best rows of the index by BM25, equal scores (to nine digits) by key. ``kind``: the key's
    type. Any term matches; a query without words, or with unknown ones only, finds nothing."""
    terms = query_terms(query)
    known = spark.read.schema("term string, bucket int, df long, n long").parquet(f"{path}/terms").filter(F.col("term").isin(terms)).collect() if terms else []  # a row a term
    none = spark.createDataFrame([], f"`{key}` {kind}, score double")
    if not known:
        return none
    idf = F.lit(0.0)
    for r in known:
        idf = F.when(F.col("term") == r["term"], math.log(1 + (r["n"] - r["df"] + 0.5) / (r["df"] + 0.5))).otherwise(idf)
    folders = [f"{path}/blocks/bucket={b}" for b in sorted({r["bucket"] for r in known})]
    schema = f"term string, range long, most double, docs array<struct<impact: double, key: {kind}>>"
    blocks = spark.read.schema(schema).parquet(*folders).filter(F.col("term").isin([r["term"] for r in known]))
    bounds = blocks.groupBy("range").agg(F.sum(idf * F.col("most")).alias("bound"))

    def best(chosen: DataFrame) -> DataFrame:
        scored = blocks.join(chosen.select("range"), "range", "left_semi").select(idf.alias("_i"), F.explode("docs").alias("d")).groupBy(F.col("d.key").alias(key)).agg(F.sum(F.col("_i") * F.col("d.impact")).alias("score"))
        return scored.orderBy(F.desc(F.round("score", DIGITS)), key).limit(k)

    seen = [r["score"] for r in best(F.broadcast(bounds.orderBy(F.desc("bound"), "range").limit(first))).collect()]
    least = min(seen) if len(seen) == k else 0.0
    return best(bounds.filter(F.col("bound") >= least - 10.0**-DIGITS))


_written: dict[tuple, str] = {}


def of_table(spark: SparkSession, table: str, key: str, body: str) -> str:
    """The folder of an index of a Parquet table, written once in a session for each state of the table's files."""
    from ..sources.store import shared_folder

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(conf)
    state = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root)))
    name = (spark.sparkContext.applicationId, table, key, body, state)
    if name not in _written:
        path = shared_folder(spark, "words")
        write_index(spark.read.parquet(table), key, body, path)
        _written[name] = path
    return _written[name]
