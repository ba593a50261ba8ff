"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(session: Column, turn: Column, block: Column, split: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", session, turn, block.cast("string"), split.cast("string"))), 1, 16)


def document_chunk_id(identity: Column, split: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.lit("canonical\0"), identity, F.lit("\0"), split.cast("string"))), 1, 16)


def opaque(domain: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{domain}\0"), value), 256)


def identity(**c: Column) -> Column:
    """The first identity that a record offers: its own, a place in a source file, then paths and ids, else a hash of
    its attribution and the start of its text."""

    def given(x: Column) -> Column:
        return F.when(x != "", x)

    place = F.when(c["source_path"].isNotNull() & (c["source_path"] != "") & c["chunk"].isNotNull(), F.concat(c["source_path"], F.lit("#chunk:"), c["chunk"]))
    generated = F.concat(F.lit("generated:"), F.sha2(F.concat_ws("\x1f", c["attribution"], F.substring(c["raw"], 1, 256)), 256))
    return F.coalesce(given(c["source_identity"]), place, given(c["source_path"]), given(c["message_id"]), given(c["session_id"]), generated)


def record_version(content_hash: Column, revision: Column) -> Column:
    return F.sha2(F.concat(content_hash, F.to_json(revision)), 256)
