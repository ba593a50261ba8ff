"""Aggregations over stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def sessions(rows: DataFrame) -> DataFrame:
    """Per session: the earliest stamp, the stamp of its highest seq, distinct turns, provenance of its first row."""
    order = F.struct("seq", "block_idx", "split_idx")
    first = F.min_by(F.struct("harness", "repo"), order)
    return rows.groupBy("session_id").agg(F.min("ts").alias("ts"), F.min_by("ts", F.struct(-F.col("seq"), F.col("block_idx"), F.col("split_idx"))).alias("last_ts"), F.countDistinct("seq", "turn_uuid").alias("turns"), first.alias("_p")).select("session_id", "ts", "last_ts", "turns", "_p.harness", "_p.repo")


def first_prompts(rows: DataFrame, preambles: tuple[str, ...] = ()) -> DataFrame:
    """``session_id, prompt``: the earliest user text that isn't scaffolding; without any user turn, the earliest text;
    where all user texts are scaffolding, none."""
    r = rows.filter((F.col("block_type") == "text") & (F.col("split_idx") == 0))
    at = F.struct("seq", "block_idx")
    spoken = (F.col("role") == "user") & ~text.is_scaffolding(F.col("text"), preambles)
    out = r.groupBy("session_id").agg(F.min_by(F.when(spoken, F.col("text")), F.when(spoken, at)).alias("u"), F.bool_or(F.col("role") == "user").alias("has_user"), F.min_by("text", at).alias("any"))
    return out.select("session_id", F.when(F.col("has_user"), F.col("u")).otherwise(F.col("any")).alias("prompt")).filter("prompt is not null")


def language_shares(counts: DataFrame, lang: str, n: str) -> DataFrame:
    """Whole percentages, rounded half up; languages that round to nothing are left out. ``counts`` has one row a
    language."""
    total = counts.agg(F.sum(n).alias("_t"))
    share = F.floor((F.col(n) * 100 + F.floor(F.col("_t") / 2)) / F.col("_t"))
    return counts.crossJoin(F.broadcast(total)).select(lang, share.alias("share")).filter("share > 0")


def push_coverage(rows: DataFrame, pushed: DataFrame, key: str, session: str) -> DataFrame:
    """One row: sessions in all, complete, pending."""
    p = pushed.select(key).distinct().withColumn("_p", F.lit(True))
    done = rows.select(key, session).join(p, key, "left").groupBy(session).agg(F.bool_and(F.coalesce("_p", F.lit(False))).alias("_all"))
    return done.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("_all").alias("complete"), F.count_if(~F.col("_all")).alias("pending"))


def detector_summary(found: DataFrame, group: str) -> DataFrame:
    """``<detector>×<n>`` by name, comma-joined."""
    counts = found.groupBy(group, "detector").agg(F.count(F.lit(1)).alias("n"))
    named = F.concat("detector", F.lit("×"), F.col("n").cast("string"))
    return counts.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("detector", named.alias("s")))), lambda x: x["s"]), ", ").alias("summary"))


def _framed(rows: DataFrame, column: str) -> Column:
    """A value's kind, the length of its bytes in eight bytes, and its bytes; null is a kind of its own, so that it
    differs from the empty text, as 1 does from '1'."""
    kind = rows.schema[column].dataType
    tag = next((t for k, t in _KINDS if isinstance(kind, k)), None)
    if tag is None:
        raise TypeError(f"{column}: no encoding for {kind.simpleString()}")
    data = F.col(f"`{column}`") if tag == "X" else F.col(f"`{column}`").cast("string").cast("binary")
    framed = F.concat(F.lit(tag).cast("binary"), F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data)
    return F.coalesce(framed, F.unhex(F.lit("4E" + "00" * 8)))


#: One letter for each kind of value; a boolean is no integer.
_KINDS = ((T.StringType, "S"), (T.BooleanType, "B"), (T.IntegralType, "I"), (T.DecimalType, "D"), (T.FractionalType, "F"), (T.BinaryType, "X"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "T"))


def table_digests(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``name, n, digest``: of all columns together (name ``*``) and of each one with the keys, the number of rows and
    the sum of 60 bits of each row's SHA-256. Sums don't depend on the order of rows, and a task sends one row of them;
    two tables whose digests agree for a column have the same values of it under the same keys."""

    def part(names: list[str]) -> Column:
        whole = F.concat(F.lit("R").cast("binary"), *[_framed(rows, c) for c in names])
        return F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("decimal(38,0)")

    named = {"*": columns} | {c: [*keys, c] for c in columns}
    sums = rows.select(*[part(names).alias(f"_{k}") for k, names in enumerate(named.values())]).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0)).cast("string").alias(f"_{k}") for k in range(len(named))])
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.col("n"), F.col(f"_{k}").alias("digest")) for k, name in enumerate(named)])
    return sums.select(F.explode(each).alias("d")).select("d.*")


def fingerprints(rows: DataFrame, group: str, columns: list[str], vector: str | None = None) -> DataFrame:
    """``group, fingerprint``: a hash of all that a group's rows hold, whatever their order, to tell whether something
    made of them still holds. ``vector``: numbers, which count to six digits; a row without one differs from one of
    none. A group's rows are summed up, never collected."""
    named = rows
    if vector is not None:
        digits = F.array_join(F.transform(F.col(vector), lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), " ")
        named = rows.withColumn("_digits", digits)
        columns = [*columns, "_digits"]
    whole = F.concat(F.lit("R").cast("binary"), *[_framed(named, c) for c in columns])
    part = F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    summed = named.select(group, part.alias("_p")).groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").cast("string").alias("_s"))
    return summed.select(group, F.sha2(F.concat_ws(":", F.col("_n").cast("string"), "_s"), 256).alias("fingerprint"))


def differing(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``name``: the columns (``*`` for any) in which two tables differ, in values or in number of rows."""
    a, b = table_digests(left, columns, keys), table_digests(right, columns, keys)
    other = b.select("name", F.col("n").alias("_n"), F.col("digest").alias("_d"))
    return a.join(F.broadcast(other), "name").filter((F.col("n") != F.col("_n")) | (F.col("digest") != F.col("_d"))).select("name")


def quantiles_by_rank(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Nearest-rank quantiles; exact, from the counts of each distinct value."""
    cols = [F.percentile_disc(value, s).alias(f"p{round(s * 100)}") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({s}) within group (order by {value})").alias(f"p{round(s * 100)}") for s in shares]
    return rows.agg(*cols)


def centroid(rows: DataFrame, group: str, vector: str, weight: Column) -> DataFrame:
    """``group, dim, value``: the weighted mean vector by dimension."""
    e = rows.select(group, weight.alias("_w"), F.posexplode(vector).alias("dim", "_x"))
    return e.groupBy(group, "dim").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("value"))


def checkpoint(rows: DataFrame) -> DataFrame:
    """One row of counts by index status and whether nothing is pending."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count(F.lit(1)).alias("eligible"), n("indexed").alias("indexed"), n("held").alias("held"), n("invalid").alias("invalid"), n("pending").alias("pending"), (n("pending") == 0).alias("complete"))


def quality(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k and mean reciprocal rank of ``rank`` (null: not found), to four places."""
    return ranked.agg(*[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
