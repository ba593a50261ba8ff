"""Near-duplicate units of a session by bands of signs, for sessions too long to compare all pairs.

A unit is compared with the units up to WINDOW places before it, and with those of its group that share a band: BITS
signs of the products with fixed directions. Units of a bucket are compared by matrix products, many small buckets in
one group, a larger one (a hub) in blocks, and what comes out is not its pairs but which of its units hang together:
units that are linked to one already aren't compared among themselves. So a hub costs no pair rows, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph

#: Bands and their bits, places of the window, and the similarity of duplicates.
BANDS, BITS, WINDOW, NEAR = 8, 10, 16, 0.97
#: Units of a bucket that is one block, and of a block of a larger one; places of a strip, and buckets of a shelf.
BOUND, BLOCK, STRIP, SHELF = 256, 4096, 1024, 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The public SplitMix64 generator's output for a state."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(dimension: int) -> np.ndarray:
    """BANDS * BITS directions of +1 and -1, the same on every machine."""
    with np.errstate(over="ignore"):
        seed = np.arange(BANDS * BITS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dimension, dtype=np.uint64) + np.uint64(0x6A09E667F3BCC909)
        return np.where(_mixed(seed) & np.uint64(1), 1.0, -1.0)


def band_keys(vector: Column) -> Column:
    """The number that each band's signs make; null for a null vector."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        sizes = np.array([-1 if x is None else len(x) for x in v])
        for n in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == n)
            signs = (np.array([v.iloc[i] for i in at], np.float64).reshape(len(at), n) @ planes(n).T >= 0).reshape(len(at), BANDS, BITS)
            for i, keys in zip(at, (signs << np.arange(BITS)).sum(-1).astype(np.int32), strict=True):
                out[i] = keys
        return pd.Series(out)

    return run(vector)


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    x = np.array(pdf["v"].tolist(), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)  # a vector of zeros is near none


def _to_root(k: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    own = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": k[root[own]], "b": k[own]})


def _window_links(base: DataFrame, least: float, window: int) -> DataFrame:
    """``a, b`` of near units at most ``window`` places apart: strips of places, each with the last ones of the strip
    before it."""
    strip = max(STRIP, window)
    dealt = base.select("g", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / strip), F.floor((F.col("at") + window) / strip)))).alias("s"), "at", "k", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        x, k = _unit(pdf), pdf["k"].to_numpy()
        near = [np.flatnonzero((x[:-o] * x[o:]).sum(1) >= least) for o in range(1, min(window, len(x) - 1) + 1)]
        a = np.concatenate([np.zeros(0, int), *near])
        b = np.concatenate([np.zeros(0, int), *[n + o for o, n in enumerate(near, 1)]])
        return pd.DataFrame({"a": k[a], "b": k[b]})

    kind = base.schema["k"].dataType.simpleString()
    return dealt.groupBy("g", "s").applyInPandas(compare, f"a {kind}, b {kind}")


def _bucket_links(rows: DataFrame, least: float) -> DataFrame:
    """``a, b`` of the rows (``g, band, h, k, v``) of small buckets, SHELF of them in one group: each unit and the least
    one of its bucket that it hangs together with."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k"])
        x, k, h = _unit(pdf), pdf["k"].to_numpy(), pdf["h"].to_numpy()
        root = np.arange(len(x))
        at = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(x)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            if j - i > 1:
                root[i:j] = i + graph.hanging(x[i:j], least)
        return _to_root(k, root)

    kind = rows.schema["k"].dataType.simpleString()
    return rows.groupBy("g", "band", F.floor(F.col("h") / SHELF).alias("shelf")).applyInPandas(compare, f"a {kind}, b {kind}")


def _hub_links(rows: DataFrame, least: float) -> DataFrame:
    """``a, b`` of the rows (``g, band, h, k, v, own, parts``) of large buckets: each unit and the least one of its two
    blocks that it hangs together with there."""
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = rows.withColumn("_p", F.explode(pair)).select("g", "band", "h", "_p.i", "_p.j", "own", "k", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "k"], kind="stable")
        first = int((pdf["own"] == pdf["i"]).sum()) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else 0
        return _to_root(pdf["k"].to_numpy(), graph.hanging(_unit(pdf), least, first))

    kind = rows.schema["k"].dataType.simpleString()
    return dealt.groupBy("g", "band", "h", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def links(rows: DataFrame, group: str, key: str, order: list[str], vector: str, least: float = NEAR, window: int = WINDOW, bound: int = BOUND, block: int = BLOCK) -> DataFrame:
    """``a, b``: enough pairs of duplicates of a group for its classes, each of cosine ``least`` or more or hanging
    together through such. Keys differ; rows without key, group or vector have none; vectors of one group have one
    length. An empty table gives no rows."""
    there = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    base = there.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"), (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).alias("at"))
    banded = there.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"), F.posexplode(band_keys(F.col(vector))).alias("band", "h"))
    sizes = banded.groupBy("g", "band", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = banded.join(sizes, ["g", "band", "h"])
    small = _bucket_links(held.filter(F.col("n") <= bound).drop("n"), least)
    parts = F.ceil(F.col("n") / block).cast("int")
    hubs = held.filter(F.col("n") > bound).select("g", "band", "h", "k", "v", parts.alias("parts"), F.pmod(F.xxhash64("k"), parts).cast("int").alias("own"))
    return _window_links(base, least, window).unionByName(small).unionByName(_hub_links(hubs, least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(rows: DataFrame, group: str, key: str, order: list[str], vector: str, least: float = NEAR) -> DataFrame:
    """``key, root, size`` of every unit with a vector: the least key of its class of duplicates, and how many there
    are; a unit without duplicates is a class of its own."""
    found = graph.components(links(rows, group, key, order, vector, least)).select(F.col("node").alias(key), "root")
    own = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key)
    root = own.join(found, key, "left").withColumn("root", F.coalesce("root", key))
    size = root.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return root.join(size, "root").select(key, "root", "size")
