"""Cycles of an index service over tables: tails of growing files, budgets, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tails(lines: DataFrame, files: DataFrame, cursors: DataFrame) -> DataFrame:
    """``source, line, mode``: the lines to read of each file. ``lines``: ``source, line, until`` (the offset behind its
    line break; null while the line isn't complete); ``files``: ``source, inode``; ``cursors``: ``source, inode, offset``
    as stored. A known file is read from its offset (``tail``); a new one, or one that another took the place of, from
    its beginning (``full``). Incomplete lines wait."""
    own = files.join(cursors.withColumnRenamed("inode", "_was"), "source", "left").select("source", (F.col("inode") == F.col("_was")).alias("_same"), "offset")
    known = F.coalesce("_same", F.lit(False))
    found = lines.filter(F.col("until").isNotNull()).join(own, "source").filter(~known | (F.col("until") > F.col("offset")))
    return found.select("source", "line", F.when(known, "tail").otherwise("full").alias("mode"))


def gone(stored: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """What a full reading of a source no longer has, to be marked as missing. ``read`` has every source read in full."""
    sources = read.select("source").distinct()
    return stored.join(sources, "source", "left_semi").join(read, ["source", *keys], "left_anti")


def within_budget(rows: DataFrame, group: str, order: list[str], cost: Column, budget: float) -> DataFrame:
    """The rows of each group that are begun before its budget is used up: the one that passes it is still done."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).filter(F.col("_spent") < budget).drop("_spent")


def reconcile(claimed: DataFrame, current: DataFrame, key: str, guards: list[str], invalid: Column, secret: Column) -> DataFrame:
    """``key, status`` of one cycle over claimed rows: ``superseded`` where the row's guards no longer are what was
    claimed (or it is gone), else ``held_secret``, ``held_invalid`` or ``indexed``. Only rows whose guards still agree
    may take their status, so a late cycle changes nothing."""
    now = current.select(key, *[F.col(g).alias(f"_now_{g}") for g in guards], secret.alias("_secret"), invalid.alias("_invalid"))
    same = F.lit(True)
    for g in guards:
        same &= F.col(g).eqNullSafe(F.col(f"_now_{g}"))
    there = F.col("_secret").isNotNull()
    status = F.when(~(there & same), "superseded").when(F.col("_secret"), "held_secret").when(F.col("_invalid"), "held_invalid").otherwise("indexed")
    return claimed.join(now, key, "left").select(key, status.alias("status"))


def settled(current: DataFrame, outcome: DataFrame, key: str, status: str = "status", terminal: tuple[str, ...] = ("indexed", "held_secret", "held_invalid")) -> DataFrame:
    """``current`` with the statuses of a cycle: superseded rows stay as they are, and a terminal status never goes back."""
    new = outcome.filter("status <> 'superseded'").select(key, F.col("status").alias("_new"))
    keep = F.col("_new").isNull() | (F.col(status).isin(*terminal) & ~F.col("_new").isin(*terminal))
    return current.join(new, key, "left").withColumn(status, F.when(keep, F.col(status)).otherwise(F.col("_new"))).drop("_new")
