"""Exact dedup by a content sort, in DataFrame operations only.

Sampled splitters (``repartitionByRange``) deal the normalised texts out by their beginnings; each partition is sorted
externally by the bytes of the whole normalised text, so that equal texts are neighbours, and neighbours are compared
in full. Splitters are short, as a sample of them goes to the driver: a beginning, and a number that parts the texts
that share it, however many. A copy group of any size is first split by a salt (a hash of id and text) of as many
values as there are partitions; each part sends one leader to a second sort, so no task holds a whole hot group (unless
its rows have no ids and one spelling), and a text travels at most twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Code points of the normalised text that a splitter holds.
PREFIX = 48
_BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts, the row with the most code points in the original text stays, then the smallest id. Null texts are
    empty; empty texts equal each other; a null id sorts last and stays only alone; rows that repeat an id are rows of
    their own in ``group_size``, and one of them is kept. An empty table gives no rows, other columns are ignored.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    norm = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), norm.alias("_norm"), (-F.coalesce(F.char_length(F.col(text)), F.lit(0))).alias("_short"), F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), F.lit(n)).alias("_salt")).select(
        "*", F.substring("_norm", 1, PREFIX).alias("_head"), F.xxhash64("_norm").alias("_mix")
    )
    order = [F.col("_short"), F.col("doc_id").asc_nulls_last()]
    # the sort goes by the whole text first; what the splitters hold follows from it
    part = Window.partitionBy("_norm", "_head", "_mix", "_salt")
    ranked = rows.repartitionByRange(n, "_head", "_mix", "_salt").select(
        "doc_id", "_short", "_head", "_mix", "_norm", "_salt", F.row_number().over(part.orderBy(*order)).alias("_at"), F.count(F.lit(1)).over(part).alias("_n")
    ).withColumn("text_sha256", F.sha2("_norm", 256))
    whole = Window.partitionBy("_norm", "_head", "_mix")
    leaders = (
        ranked.filter("_at = 1")
        .repartitionByRange(n, "_head", "_mix")
        .select(F.col("_salt").alias("_lead_salt"), F.col("text_sha256").alias("_lead_sha"), F.first("doc_id").over(whole.orderBy(*order)).alias("keep_id"), F.sum("_n").over(whole).alias("group_size"), F.row_number().over(whole.orderBy(*order)).alias("_first"))
    )
    # null-safe comparisons add no filters of their own, so that both branches share one exchange
    found = ranked.select("doc_id", "_salt", "text_sha256", "_at").join(leaders, F.col("_salt").eqNullSafe(F.col("_lead_salt")) & F.col("text_sha256").eqNullSafe(F.col("_lead_sha")))
    kept = (F.col("_first") == 1) & (F.col("_at") == 1)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
