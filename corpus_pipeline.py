"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes what the one before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from loomlake.llm.common import set_aside, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or like none of the languages that the labelled rows teach; where they teach
    none, only those without letters."""
    learned = language_id.learn(docs)
    if learned.empty:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    there, back = set_aside(docs, ("lang_pred", "score"))
    kept = (F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= language_id.LEAST_SCORE)
    return back(language_id.identify(there, learned).filter(kept))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, and documents of which they leave little; ``n_chars`` follows the text. A document that is
    nothing but passages of a few others is left to the near-duplicates."""
    there, back = set_aside(docs, ("n_lines", "n_dropped", "kept"))
    cut = line_dedup.line_dedup(there, spare=True).filter("kept")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(cut)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates, the one with the least id; rows without ids count too."""
    return near_dedup.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("packed", packed)]

#: SQL can't express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
