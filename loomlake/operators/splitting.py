"""Splitting rendered blocks into overlapping pieces, and putting them together again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

#: Characters of a piece at most, and those that two pieces share.
PIECE, OVERLAP = 1200, 150


def pieces(body: str | None, most: int = PIECE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``most`` code points. A piece ends at its last line break, else at its last blank, if that
    lies past its half; the next begins ``overlap`` before that end. Pieces are trimmed, empty ones left out."""
    body = (body or "").strip()
    if len(body) <= most:
        return [body] if body else []
    out, start = [], 0
    while True:
        end = min(start + most, len(body))
        if end < len(body):
            for mark in "\n ":
                at = body.rfind(mark, start, end)
                if at > start + most // 2:
                    end = at
                    break
        if piece := body[start:end].strip():
            out.append(piece)
        if end >= len(body):
            return out
        start = max(end - overlap, start + 1)


def joined(left: str, right: str, overlap: int = OVERLAP) -> str:
    """``right`` after ``left``, the longest common end and beginning of at most ``overlap`` once."""
    for k in range(min(len(left), len(right), overlap), 0, -1):
        if left.endswith(right[:k]):
            return left + right[k:]
    return left + right


#: Steps of one run of a fold: a fold copies its whole state at each step, so what the steps give is gathered by runs.
RUN = 128


def _unfolded(steps: Column, first: Column, step) -> Column:  # noqa: ANN001
    """``first, step(first, 1), step(step(first, 1), 2), ...``: ``steps`` of them, all small structs of one type."""
    none = F.filter(F.array(first), lambda _: F.lit(False))

    def one(acc: Column, k: Column) -> Column:
        return F.struct(F.array_append(acc["run"], acc["now"]).alias("run"), step(acc["now"], k).alias("now"))

    def run(acc: Column, r: Column) -> Column:
        own = F.sequence(r * RUN + 1, F.least((r + 1) * RUN, steps))
        ended = F.aggregate(own, F.struct(none.alias("run"), acc["now"].alias("now")), one)
        return _bound(ended, lambda e: F.struct(F.array_append(acc["runs"], e["run"]).alias("runs"), e["now"].alias("now")))

    runs = F.sequence(F.lit(0), F.floor((steps - 1) / RUN).cast("int"))
    start = F.struct(F.filter(F.array(none), lambda _: F.lit(False)).alias("runs"), first.alias("now"))
    return F.aggregate(runs, start, run, lambda acc: F.flatten(acc["runs"]))


def split_text(body: Column) -> Column:
    """``pieces`` by built-in functions, in time that grows with the text: the text is parted once into stretches of
    PIECE characters, and a fold looks for each piece's end in the two stretches that it can lie in."""
    none = F.array().cast("array<string>")

    def whole(t: Column) -> Column:
        size, parts = t["size"], t["parts"]

        def seen(start: Column) -> Column:
            """The PIECE characters from ``start`` on."""
            first = F.floor(start / PIECE).cast("int")
            return F.substr(F.concat(F.get(parts, first), F.coalesce(F.get(parts, first + 1), F.lit(""))), start % PIECE + 1, F.lit(PIECE))

        def piece(start: Column) -> Column:
            # from the end of the longest piece back to its last line break or blank
            def end(back: Column) -> Column:
                line, blank = F.instr(back, "\n"), F.instr(back, " ")
                return F.when(start + PIECE >= size, size).when((line > 0) & (PIECE - line > PIECE // 2), start + PIECE - line).when((blank > 0) & (PIECE - blank > PIECE // 2), start + PIECE - blank).otherwise(start + PIECE)

            return F.struct(start.alias("start"), _bound(F.reverse(seen(start)), end).alias("end"))

        def following(now: Column, _: Column) -> Column:
            return F.when(now["end"] >= size, F.struct(size.alias("start"), size.alias("end"))).otherwise(_bound(F.greatest(now["end"] - OVERLAP, now["start"] + 1), piece))

        steps = F.ceil(size / (PIECE // 2 - OVERLAP)).cast("int")  # a piece is at least half as long as it may be
        cuts = F.filter(_unfolded(steps, piece(F.lit(0)), following), lambda c: c["start"] < c["end"])
        return F.filter(F.transform(cuts, lambda c: text.trim_unicode(F.left(seen(c["start"]), c["end"] - c["start"]))), lambda p: p != "")

    def sized(t: Column) -> Column:
        plain, size = t["plain"], t["size"]
        parted = F.struct(F.regexp_extract_all(plain, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("parts"), size.alias("size"))
        return F.when(size <= PIECE, F.when(size > 0, F.array(plain)).otherwise(none)).otherwise(_bound(parted, whole))

    return _bound(text.trim_unicode(body), lambda p: _bound(F.struct(p.alias("plain"), F.char_length(p).alias("size")), sized))


def stitched(parts: Column, overlap: int = OVERLAP) -> Column:
    """Pieces put together as ``joined`` does, one after the other. Of what stands before a seam only its last
    ``overlap`` characters are looked at, and the text is put together once, at the end."""

    def whole(own: Column) -> Column:
        def seam(now: Column, k: Column) -> Column:
            """What part ``k`` repeats of the tail before it, and the tail behind it."""
            part, tail = F.coalesce(F.get(own, k), F.lit("")), now["tail"]
            same = lambda h: F.get(F.filter(F.sequence(F.least(F.char_length(tail), F.char_length(h)), F.lit(0), F.lit(-1)), lambda n: F.right(tail, n) == F.left(h, n)), 0)
            behind = lambda n: F.right(F.concat(tail, F.right(F.substr(part, n + 1), F.lit(overlap))), F.lit(overlap))
            return _bound(_bound(F.left(part, F.lit(overlap)), same), lambda n: F.struct(n.alias("skip"), behind(n).alias("tail")))

        first = F.struct(F.lit(0).alias("skip"), F.right(F.get(own, 0), F.lit(overlap)).alias("tail"))
        skips = F.transform(_unfolded(F.size(own), first, seam), lambda x: x["skip"])
        return F.array_join(_bound(skips, lambda n: F.transform(own, lambda p, i: F.substr(p, F.get(n, i) + 1))), "")

    return _bound(parts, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(F.lit("")))


def _bound(value: Column, f) -> Column:  # noqa: ANN001
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def chunks(blocks: DataFrame) -> DataFrame:
    """Stored rows of blocks: ``id``, the block's columns with ``text`` a piece, and ``split_idx``.

    ``blocks`` has ``session_id, turn_uuid, block_idx, block_type, tool_name, text``.
    """
    rendered = blocks.withColumn("text", text.render(F.col("block_type"), text.elide_data_uris(F.coalesce("text", F.lit(""))), F.col("tool_name")))
    rows = rendered.withColumn("_pieces", split_text(F.col("text"))).drop("text").select("*", F.posexplode("_pieces").alias("split_idx", "text")).drop("_pieces")
    rows = rows.withColumn("split_idx", F.col("split_idx").cast("long"))
    return rows.withColumn("id", ids.chunk_id(F.col("session_id"), F.col("turn_uuid"), F.col("block_idx"), F.col("split_idx")))


def blocks_of(chunk_rows: DataFrame, keys: tuple[str, ...] = ("session_id", "seq", "turn_uuid", "block_idx"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole blocks from their pieces, in whatever order these come; ``keep``: columns that a block's pieces share."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("split_idx", "text"))), lambda x: x["text"])
    grouped = chunk_rows.groupBy(*keys).agg(pieces.alias("_parts"), *[F.min(c).alias(c) for c in keep])
    return grouped.select(*keys, *keep, F.when(F.size("_parts") == 1, F.col("_parts")[0]).otherwise(stitched(F.col("_parts"))).alias("text"))


def turns_of(chunk_rows: DataFrame) -> DataFrame:
    """``session_id, seq, turn_uuid, role, blocks``: each turn with its whole blocks (``block_idx, block_type, text``)
    in order. Pieces meet by block first, blocks by turn then, so the larger of the two groups is one block's pieces."""
    whole = blocks_of(chunk_rows, keep=("role", "block_type"))
    blocks = F.sort_array(F.collect_list(F.struct("block_idx", "block_type", "text")))
    return whole.groupBy("session_id", "seq", "turn_uuid").agg(F.min("role").alias("role"), blocks.alias("blocks"))


HEADING = re.compile(r"\n(?=\s*#{1,6}\s)")


def sections(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Markdown sections: ``key, section, heading, occurrence, text``; a heading that comes again is numbered."""
    from pyspark.sql import Window

    parts = docs.select(key, F.posexplode(F.split(body, r"\n(?=\s*#{1,6}\s)")).alias("section", "text")).withColumn("text", text.trim_unicode(F.col("text"))).filter("text <> ''")
    head = F.trim(F.regexp_replace(F.regexp_extract("text", r"^#{1,6}[ \t]+([^\n]*)", 1), r"\s+$", ""))
    w = Window.partitionBy(key, "heading").orderBy("section")
    return parts.withColumn("heading", head).withColumn("occurrence", F.row_number().over(w)).select(key, "section", "heading", "occurrence", "text")


def large_parts(body: Column, most: int = 6000) -> Column:
    """Paragraphs of a text, those of more than ``most`` characters cut into pieces of that size."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n[ \t\r\f\x0B\n]*\n"), text.trim_unicode), lambda p: p != "")
    cut = F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / most).cast("int")), lambda i: F.substr(p, i * most + 1, F.lit(most))))
    return F.when(F.char_length(body) <= most, F.array(body)).otherwise(F.flatten(cut))
