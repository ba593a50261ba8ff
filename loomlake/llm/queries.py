"""The queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clustered_index, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, pii, runs, substring_dedup, token_counts, token_store

PLANTED_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PLANTED_CHAT, "conv_id long, turn long, role string, text string"))
    return chat_format.conversation_digests(chat_format.chat_windows(turns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language_id.learn(docs.filter(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), learned).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_store.store_and_read(table(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", "kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted_runs(table(spark, sf_dir, "documents"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_index.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents), c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, coalesce(sum(len(ts)), 0) :: BIGINT AS l FROM d),
t AS (SELECT r, doc_id, len(ts) AS size, unnest(ts) AS term FROM d), tf AS (SELECT r, doc_id, size, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1))) :: BIGINT AS w FROM df, c),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l)))) :: BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), c GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank :: INTEGER AS rank, doc_id, score FROM p WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_near_dedup": op2_near_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_pii": op4_pii,
        "op5_language_id": op5_language_id,
        "op6_token_store": op6_token_store,
        "op7_line_dedup": op7_line_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_token_counts": op12_token_counts,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": _OP10_SQL, "op13_ranked_search": _OP13_SQL}
