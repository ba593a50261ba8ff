"""Reindexing in bounded, restartable steps.

A control asks that everything of a lesser generation be derived anew. Controls are applied newest first, each over the
rows in the order of their ids, some rows a step. A step writes what it changed, and how far it came, into a folder of
its own; a step that is broken off leaves nothing, and the next run goes on behind the last whole one. The rows
themselves are read together with the changes, the latest of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a step (fixed value).
STEP = 500
#: What a reset shadow has, and the state of an index entry that a reset waits for.
PENDING, HELD = "pending_provider", "waiting_durability"

ROW = "id long, raw_text string, content_type string, provider_eligible boolean, shadow_text string, shadow_status string, shadow_generation long, index_status string, index_generation long, embedding_generation long"
CHANGED = ("shadow_text", "shadow_status", "shadow_generation", "index_status", "index_generation", "embedding_generation")
#: Kinds of content that are not indexed anew.
LOW_VALUE = ("progress", "telemetry", "status")


def reset(rows: DataFrame, generation: Column, scope: Column) -> DataFrame:
    """``rows`` (see ROW) behind a control of a generation, over shadows only (``retrieval``) or ``all``.

    A shadow of a lesser generation takes the new one, and where its text goes to the provider, the raw text and the
    pending state; its index entry is then cleared if that is older too. Under ``all``, older index entries and
    embeddings take the generation and are cleared, unless their content isn't indexed. A held entry is never cleared.
    """
    g = generation.cast("long")
    have = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    free = ~F.col("index_status").eqNullSafe(HELD)
    canonical = ~F.coalesce(F.lower("content_type").isin(*LOW_VALUE), F.lit(False))
    none = F.lit(None).cast("string")
    shadow = g > have("shadow_generation")
    sent = shadow & F.coalesce("provider_eligible", F.lit(False))
    index = sent & (g > have("index_generation"))
    one = rows.withColumns({
        "shadow_text": F.when(sent, F.col("raw_text")).otherwise(F.col("shadow_text")), "shadow_status": F.when(sent, PENDING).otherwise(F.col("shadow_status")), "shadow_generation": F.when(shadow, g).otherwise(have("shadow_generation")),
        "index_status": F.when(index & free, none).otherwise(F.col("index_status")), "index_generation": F.when(index, g).otherwise(have("index_generation")),
    })
    all_ = scope == "all"
    older = all_ & (g > F.col("index_generation"))
    two = one.withColumns({"index_status": F.when(older & canonical & free, none).otherwise(F.col("index_status")), "index_generation": F.when(older, g).otherwise(F.col("index_generation"))})
    stale = all_ & (g > have("embedding_generation"))
    return two.withColumns({"index_status": F.when(stale & canonical & free, none).otherwise(F.col("index_status")), "embedding_generation": F.when(stale, g).otherwise(have("embedding_generation"))})


def with_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``rows`` with the latest change of each (``id, step`` and CHANGED)."""
    last = changes.groupBy("id").agg(F.max_by(F.struct(*CHANGED), "step").alias("_c"))
    out = rows.join(last, "id", "left")
    return out.select(*[F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in CHANGED else F.col(c) for c in rows.columns])


class Reindex:
    """The steps under one folder; ``controls``: (generation, scope) of each, whether applied or not."""

    def __init__(self, spark: SparkSession, path: str, controls: list[tuple[int, str]], step: int = STEP):
        self.spark, self.path, self.step = spark, path, step
        self.controls = sorted(controls, reverse=True)

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(conf)
        whole = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def progress(self) -> list:
        """``step, generation, cursor, applied`` of each whole step, in order; there is one row a step."""
        return self._read("progress", "step long, generation long, cursor long, applied boolean").orderBy("step").collect()

    def current(self, rows: DataFrame) -> DataFrame:
        """``rows`` as all whole steps have left them."""
        last = max((p["step"] for p in self.progress()), default=-1)
        changes = self._read("changes", "step long, id long, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in CHANGED))
        return with_changes(rows, changes.filter(F.col("step") <= last))

    def run_step(self, rows: DataFrame) -> bool:
        """One step; false if nothing is left to do. Its changes are written first, its progress last: without the
        latter it hasn't been."""
        done = self.progress()
        applied = {p["generation"] for p in done if p["applied"]}
        control = next((c for c in self.controls if c[0] not in applied), None)
        if control is None:
            return False
        generation, scope = control
        cursor = max((p["cursor"] for p in done if p["generation"] == generation), default=None)
        number = max((p["step"] for p in done), default=-1) + 1
        ids = rows.select("id") if cursor is None else rows.select("id").filter(F.col("id") > cursor)
        taken = [r["id"] for r in ids.orderBy("id").limit(self.step + 1).collect()]  # of one step
        part, more = taken[: self.step], len(taken) > self.step
        if part:
            own = self.current(rows).filter(F.col("id").between(part[0], part[-1]))
            new = reset(own, F.lit(generation), F.lit(scope))
            kept = own.select("id", *[F.col(c).alias(f"_{c}") for c in CHANGED])
            same = F.lit(True)
            for c in CHANGED:
                same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
            new.join(kept, "id").filter(~same).select(F.lit(number).cast("long").alias("step"), "id", *CHANGED).write.mode("overwrite").parquet(f"{self.path}/changes/{number:09d}")
        here = self.spark.createDataFrame([(number, generation, part[-1] if part else (cursor or 0), not more)], "step long, generation long, cursor long, applied boolean")
        here.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/progress/{number:09d}")
        return True

    def drain(self, rows: DataFrame) -> DataFrame:
        """All steps that are left; gives the rows behind them."""
        while self.run_step(rows):
            pass
        return self.current(rows)

