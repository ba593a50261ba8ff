"""Join-shaped operators. Sides are broadcast only where a query's own limit bounds them; all else is left to the
planner's size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbors(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Chunks of a hit's session within ``window`` of its seq, the hit's own turn left out, in reading order.

    ``hits`` is a cut ranking (at most a few hundred rows). The band is bucketed by ``window + 1`` seqs, so that the
    join is an equality on (session, bucket) and a hot session's turns are spread over its buckets.
    """
    width = window + 1
    h = hits.select(F.col("session_id").alias("h_session"), F.col("seq").alias("h_seq"), F.col("turn_uuid").alias("h_turn"))
    h = h.withColumn("_b", F.explode(F.sequence(F.floor((F.col("h_seq") - window) / width), F.floor((F.col("h_seq") + window) / width))))
    c = chunks.withColumn("_b", F.floor(F.col("seq") / width))
    near = (F.col("h_session") == F.col("session_id")) & (h["_b"] == c["_b"]) & (F.abs(F.col("seq") - F.col("h_seq")) <= window) & (F.col("turn_uuid") != F.col("h_turn"))
    rows = c.join(h, near).select("h_session", "h_seq", "seq", "block_idx", "split_idx", "role", "block_type", "text")
    return rows.groupBy("h_session", "h_seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "block_idx", "split_idx", "role", "block_type", "text"))), lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"), x["block_type"].alias("block_type"), x["text"].alias("text"))).alias("neighbors"))


def first_per(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key, the least by ``order``, by partial minima (no window over a hot key)."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*").select(*rows.columns)


def new_rows(batch: DataFrame, stored: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of a batch whose key is not stored yet; of a key that comes twice, the first."""
    return first_per(batch.join(stored.select(key), key, "left_anti"), key, order)


def delta(candidates: DataFrame, embedded: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Keys that are embedded and wanted and not there yet."""
    return candidates.select(key).join(embedded.select(key), key, "left_semi").join(remote.select(key), key, "left_anti")


def owed(rows: DataFrame, receipt: DataFrame, key: str, session: str) -> DataFrame:
    """Sessions of which any row is not in the receipt."""
    return rows.join(receipt.select(key), key, "left_anti").select(session).distinct()


def overlay(local: DataFrame, remote: DataFrame, owed_sessions: DataFrame, session: str) -> DataFrame:
    """Remote rows of sessions that owe nothing, and local rows of those that do."""
    return remote.join(owed_sessions, session, "left_anti").unionByName(local.join(owed_sessions, session, "left_semi"))


def filled(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` taken from ``values`` where the key matches; nothing is inserted."""
    new = values.select(F.col(key), F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def filled_exactly(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``filled``, but the query fails if a value has no row or comes twice: what was computed for a row must have got
    there. The counts are one row, which every row meets, so none is given before they are known."""
    each = values.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = each.join(rows.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("_found"))
    told = values.agg(F.count(F.lit(1)).alias("_told")).crossJoin(found)
    wrong = F.raise_error(F.concat(F.col("_told").cast("string"), F.lit(" values, but "), F.col("_found").cast("string"), F.lit(" rows for them")))
    out = filled(rows, values, key, column).crossJoin(F.broadcast(told))
    return out.withColumn(column, F.when(F.col("_told") == F.col("_found"), F.col(column)).otherwise(wrong.cast(rows.schema[column].dataType))).drop("_told", "_found")


def replaced(stored: DataFrame, batch: DataFrame, identity: str) -> DataFrame:
    """All rows of the batch's identities give way to the batch's rows."""
    return stored.join(batch.select(identity).distinct(), identity, "left_anti").unionByName(batch)


def revision_state(incoming: DataFrame, stored: DataFrame, identity: str = "source_identity") -> DataFrame:
    """``unchanged``, ``stale`` or ``changed`` for each incoming document against what is stored."""
    order = lambda p: F.struct(F.col(f"{p}updated_at"), F.col(f"{p}source_version"))
    s = stored.select(F.col(identity), F.col("updated_at").alias("s_updated_at"), F.col("source_version").alias("s_source_version"))
    joined = incoming.join(s, identity, "left")
    state = F.when(F.col("s_source_version").isNull(), "changed").when(F.col("source_version") == F.col("s_source_version"), "unchanged").when(order("") < order("s_"), "stale").otherwise("changed")
    return joined.withColumn("state", state).drop("s_updated_at", "s_source_version")


def ordered_lookup(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys with the place at which each key is asked for first; missing keys are left out."""
    place = wanted.groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(place, key)


def presence(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    there = rows.select(key).distinct().withColumn("_there", F.lit(True))
    return wanted.select(key).distinct().join(there, key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("present"))


def table_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, change`` (insert, update, delete): a full outer join, rows compared null-safely."""
    columns = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("_bk"), F.struct(*columns).alias("_b"))
    a = after.select(F.col(key).alias("_ak"), F.struct(*columns).alias("_a"))
    change = F.when(F.col("_bk").isNull(), "insert").when(F.col("_ak").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return b.join(a, b["_bk"] == a["_ak"], "full_outer").select(F.coalesce("_bk", "_ak").alias(key), change.alias("change")).filter("change is not null")


def within_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits that lie in a labelled span of their session (``span_from`` to ``span_to``)."""
    return hits.join(spans, (hits["session_id"] == spans["span_session"]) & hits["seq"].between(spans["span_from"], spans["span_to"]))


def compare_and_set(rows: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` is set only where all of ``keys`` still match."""
    u = updates.select(*keys, F.col(column).alias("_new"))
    return rows.join(u, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def unique_order(order: list, key: str) -> list:
    """Every ranking ends in the unique key, so that ties never move."""
    return [*order, F.col(key)]


def top_per(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


#: Columns that never leave the store (fixed values).
PRIVATE = ("raw_text", "retrieval_text", "vector")


def public_columns(rows: DataFrame) -> DataFrame:
    """Without private columns and those that begin with an underscore."""
    return rows.select(*[c for c in rows.columns if c not in PRIVATE and not c.startswith("_")])
