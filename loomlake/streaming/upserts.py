"""Incremental operators: revision-aware upserts, per-field clocks, tombstones, guards, gates, windows.

Each merge is an order-free maximum where its semantics allow, so that permuted deliveries converge; what depends on
arrival order takes that order as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statuses(rows: DataFrame, identity: str, *arrival: str) -> DataFrame:
    """``status`` of each delivered revision by arrival: created, stale (older than what is stored), deduped (the
    stored content again) or updated. ``arrival`` must order an identity's deliveries without ties: name a key behind a
    clock that may repeat."""
    w = Window.partitionBy(identity).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct("updated_at", "source_version", "content_hash")).over(w)
    out = rows.withColumn("_before", before)
    status = F.when(F.col("_before").isNull(), "created").when(F.col("updated_at") < F.col("_before.updated_at"), "stale").when(F.col("content_hash") == F.col("_before.content_hash"), "deduped").otherwise("updated")
    return out.withColumn("status", status).drop("_before")


def merged(rows: DataFrame, identity: str) -> DataFrame:
    """The stored state after all deliveries, in whatever order they came."""
    rest = [c for c in rows.columns if c not in (identity, "updated_at", "source_version")]
    return rows.groupBy(identity).agg(F.max(F.struct("updated_at", "source_version", *rest)).alias("_r")).select(identity, "_r.*")


def late(rows: DataFrame, identity: str, *arrival: str) -> DataFrame:
    """Deliveries that are older than what was stored when they came."""
    return statuses(rows, identity, *arrival).filter("status = 'stale'").drop("status")


def last_writers(rows: DataFrame, identity: str, fields: list[str], clock: str) -> DataFrame:
    """Each field's value by its own clock: the last writer wins; equal clocks join by the greater value, null least."""
    best = [F.max(F.when(F.col(clock).isNotNull(), F.struct(F.col(clock).alias("c"), F.col(f).alias("v")))).alias(f) for f in fields]
    return rows.groupBy(identity).agg(*best).select(identity, *[F.col(f"{f}.v").alias(f) for f in fields])


def tombstones(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Records that vanished: a new version with ``source_missing`` set."""
    return stored.join(seen.select(key), key, "left_anti").withColumn("source_missing", F.lit(True)).withColumn("version", F.col("version") + 1)


def guarded(current: DataFrame, incoming: DataFrame, key: str, value: str, generation: str) -> DataFrame:
    """Derived fields give way to those of the same or a later generation only."""
    i = incoming.select(F.col(key), F.col(value).alias("_v"), F.col(generation).alias("_g"))
    take = F.col("_g").isNotNull() & (F.col("_g") >= F.col(generation))
    out = current.join(i, key, "left")
    return out.withColumn(value, F.when(take, F.col("_v")).otherwise(F.col(value))).withColumn(generation, F.when(take, F.col("_g")).otherwise(F.col(generation))).drop("_v", "_g")


def monotone(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """The greatest checkpoint of each key."""
    return rows.groupBy(key).agg(F.max(F.struct(*parts)).alias("_c")).select(key, "_c.*")


def held_blocks(rows: DataFrame, block: list[str], secret: Column) -> DataFrame:
    """``rows`` of blocks none of whose rows has a finding; findings are aggregated, not rows."""
    bad = rows.filter(secret).select(*block).distinct()
    return rows.join(bad, block, "left_anti")


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(30) * F.pow(F.lit(2), F.least(attempts, F.lit(6))).cast("int"), F.lit(3600))


def counters(rows: DataFrame, group: str, status: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(status == "indexed").alias("indexed"))


def windows(events: DataFrame, ts: str, size: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type; works on streams (with ``delay``) and on tables alike."""
    e = events.withWatermark(ts, delay) if delay else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_windows(events: DataFrame, ts: str, key: str, gap: str, delay: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, delay) if delay else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(stream: DataFrame, path: str, identity: str, checkpoint: str):  # noqa: ANN201
    """A stream of revisions into versioned snapshots under ``path``: each micro-batch is merged with the snapshot
    before it and written as the next one, named by its batch, so that a batch that is run again overwrites only
    itself. ``snapshot`` reads the last."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        before = snapshot(spark, path, below=number)
        rows = batch if before is None else before.unionByName(batch)
        merged(rows, identity).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def snapshot(spark, path: str, below: int | None = None):  # noqa: ANN001, ANN201
    """The last snapshot (of a batch before ``below``), or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = sorted(n for n in names if n.startswith("batch=") and (below is None or int(n[6:]) < below) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None
