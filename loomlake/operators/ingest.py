"""Row-to-row ingest: normalised documents, versions, identities, elision, and the validation of turns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text

BLOCK = T.StructType([T.StructField("block_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tool_name", T.StringType()), T.StructField("tool_use_id", T.StringType())])
TURN = T.StructType(
    [
        T.StructField("format", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("turn_uuid", T.StringType()),
        T.StructField("parent_uuid", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("harness", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
    ]
)
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result")


def valid_turn(block_type: Column | None = None) -> Column:
    """Whether a turn keeps the input contract: format 1, no ``:`` in ids, harness in ``[a-z0-9_-]+``, a UTC stamp, and
    blocks of known types."""
    ok = F.col("format").eqNullSafe(1)
    for name in ("session_id", "turn_uuid"):
        ok &= F.coalesce(F.col(name) != "", F.lit(False)) & ~F.coalesce(F.col(name).contains(":"), F.lit(False))
    ok &= F.col("seq").isNotNull() & F.col("role").isNotNull()
    ok &= F.coalesce(F.col("harness").rlike("^[a-z0-9_-]+$"), F.lit(False))
    ok &= F.coalesce(F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$") & F.try_to_timestamp("ts").isNotNull(), F.lit(False))
    known = F.coalesce(F.forall("blocks", lambda b: F.coalesce(b["block_type"].isin(list(BLOCK_TYPES)), F.lit(False))), F.lit(False))
    return ok & known


def blocks_of_turns(turns: DataFrame) -> DataFrame:
    """One row per block, numbered within its turn before anything is hidden."""
    rows = turns.select("*", F.posexplode("blocks").alias("block_idx", "_b")).drop("blocks")
    return rows.select(*[c for c in turns.columns if c != "blocks"], F.col("block_idx").cast("long").alias("block_idx"), F.col("_b.block_type").alias("block_type"), F.col("_b.text").alias("text"), F.col("_b.tool_name").alias("tool_name")).withColumn("workdir", F.coalesce(text.workdir(F.col("cwd")), F.lit("")))


def tier(block_type: Column) -> Column:
    return F.when(block_type == "tool_use", 2).when(block_type == "tool_result", 3).otherwise(1)


def blank_to_null(c: Column) -> Column:
    plain = text.trim_unicode(c)
    return F.when(plain != "", plain)


def normalized_documents(docs: DataFrame, facets: tuple[str, ...] = ("source_agent", "source_type", "project")) -> DataFrame:
    """Canonical documents: identity and version required and free of NUL, raw text falling back to retrieval text,
    facets falling back to the metadata's. Rows that break the rules carry a reason in ``refused``."""
    bad = F.when(F.coalesce(F.trim("source_identity"), F.lit("")) == "", "source_identity is required").when(F.coalesce(F.trim("source_version"), F.lit("")) == "", "source_version is required")
    bad = F.coalesce(bad, F.when(F.col("source_identity").contains("\0") | F.col("source_version").contains("\0"), "a key holds NUL"))
    raw = F.coalesce(blank_to_null(F.col("raw_text")), blank_to_null(F.col("retrieval_text")))
    bad = F.coalesce(bad, F.when(raw.isNull(), "text is required"))
    out = docs.withColumn("refused", bad).withColumn("raw_text", F.when(text.trim_unicode(F.coalesce("raw_text", F.lit(""))) != "", F.col("raw_text")).otherwise(F.col("retrieval_text")))
    for name in facets:
        out = out.withColumn(name, F.coalesce(blank_to_null(F.col(name)), blank_to_null(F.get_json_object("metadata_json", f"$.{name}"))))
    return out


def latest_documents(docs: DataFrame) -> DataFrame:
    """The greatest revision of each identity, partial maxima before the shuffle."""
    rest = [c for c in docs.columns if c not in ("updated_at", "source_version", "content_hash")]
    best = docs.groupBy("source_identity").agg(F.max(F.struct("updated_at", "source_version", "content_hash", *[c for c in rest if c != "source_identity"])).alias("_d"))
    return best.select("source_identity", "_d.*")


def generation_of(version: Column) -> Column:
    """The generation that a version starts with (``~eg-v1:<20 digits>:<revision>``); null where there is none."""
    return F.regexp_extract(version, r"^~eg-v1:(\d{20}):.+$", 1).try_cast("long")


def source_version(generation: Column, source: Column, content: Column, shadow: Column, shadow_version: Column, retrieval: Column, missing: Column, index_generation: Column, profile: Column) -> Column:
    """What a document's index entry was made of: the SHA-256 of a JSON list of eight texts (nulls are empty or 0), with
    its embedding generation in front, if it has one."""
    text_ = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [text_(source), text_(content), text_(shadow), text_(shadow_version), F.sha2(text_(retrieval), 256), F.when(missing, "1").otherwise("0"), F.coalesce(index_generation, F.lit(0)).cast("string"), text_(profile)]
    digest = F.sha2(F.to_json(F.array(*parts)), 256)
    return F.when(F.coalesce(generation, F.lit(0)) > 0, F.concat(F.lit("~eg-v1:"), F.lpad(generation.cast("string"), 20, "0"), F.lit(":"), digest)).otherwise(digest)


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON with sorted keys, without the raw text; what isn't JSON is a JSON string."""

    def strip(x):  # noqa: ANN001, ANN202
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k != "raw_text"}
        return [strip(v) for v in x] if isinstance(x, list) else x

    def one(s):  # noqa: ANN001, ANN202
        try:
            parsed = json.loads(s) if s is not None else {}
        except ValueError:
            parsed = s
        return json.dumps(strip(parsed), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return value.map(one)


def json_escaped(c: Column) -> Column:
    """How JSON spells a text inside a string, all signs beyond ASCII as code units."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(x: Column) -> Column:
        n = F.ascii(x)
        over = n - 0x10000
        pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00))
        out = F.when(n > 0xFFFF, pair).when((n > 126) | (n < 32), unit(n)).otherwise(x)
        for k, v in short.items():
            out = F.when(x == k, v).otherwise(out)
        return out

    plain = c.rlike(r'^[\x20-\x7e&&[^"\\]]*$')
    return F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def redacted(body: Column, found: Column) -> Column:
    """Found values (``array<struct<detector, raw>>``) replaced by ``[REDACTED:<detector>]``: each value once under its
    first detector, the longest first, of equally long ones the least, as it is and then as JSON spells it."""
    numbered = F.transform(F.filter(found, lambda f: f["raw"] != ""), lambda f, i: F.struct((-F.char_length(f["raw"])).alias("n"), f["raw"].alias("raw"), i.alias("i"), f["detector"].alias("detector")))
    # a value that was found before is replaced already when it comes again
    return F.when(found.isNull(), body).otherwise(
        F.aggregate(F.sort_array(numbered), body, lambda text_, f: _replaced(text_, f["raw"], F.concat(F.lit("[REDACTED:"), f["detector"], F.lit("]"))))
    )


def _replaced(body: Column, raw: Column, mark: Column) -> Column:
    return F.replace(F.replace(body, raw, mark), json_escaped(raw), mark)


#: Detectors of secrets (fixed values): name and pattern.
DETECTORS = {
    "AWS": r"\bAKIA[0-9A-Z]{16}\b",
    "Assignment": r"(?i)\b(?:password|token|secret|api_key)\s*=\s*\"?([0-9a-f]{24,64})\b",
    "PrivateKey": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def findings(body: Column) -> Column:
    """``array<struct<detector, raw>>`` of the built-in detectors, by built-in functions."""

    def of(name: str, pattern: str) -> Column:
        group = 1 if "([" in pattern else 0
        return F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), F.lit(group)), lambda r: F.struct(F.lit(name).alias("detector"), r.alias("raw")))

    return F.concat(*[of(*d) for d in DETECTORS.items()])


#: What a text must hold for a detector to find anything (compared in lower case): cheap to look for.
HINTS = {"AWS": ("akia",), "Assignment": ("password", "token", "secret", "api_key"), "PrivateKey": ("private key-----",)}


def has_secret(body: Column) -> Column:
    low, out = F.lower(body), F.lit(False)
    for name, pattern in DETECTORS.items():
        hint = F.lit(False)
        for x in HINTS[name]:
            hint |= low.contains(x)
        out |= F.coalesce(hint & body.rlike(pattern), F.lit(False))
    return out


def sanitized(blocks: DataFrame) -> DataFrame:
    """Elision first, then redaction (a marker inside a payload would strand the rest of it)."""
    elided = blocks.withColumn("text", text.elide_data_uris(F.coalesce("text", F.lit(""))))
    body = F.col("text")
    return elided.withColumn("text", F.when(has_secret(body), redacted(body, findings(body))).otherwise(body))


def document_rows(docs: DataFrame, pieces: Column) -> DataFrame:
    """Chunk rows of documents with the fallbacks of documents that lack a session, turn, place or role."""
    rows = docs.select("*", F.posexplode(pieces).alias("split_idx", "text"))
    ident = F.col("source_identity")
    return rows.select(
        ids.document_chunk_id(ident, F.col("split_idx")).alias("id"),
        "source_identity",
        F.coalesce("session_id", ident).alias("session_id"),
        ident.alias("turn_uuid"),
        F.coalesce("project", F.lit("")).alias("workdir"),
        F.lit("canonical").alias("harness"),
        F.coalesce("role", F.lit("document")).alias("role"),
        F.col("split_idx").cast("long").alias("split_idx"),
        "text",
    )
