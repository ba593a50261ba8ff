"""Scalar text functions as Column expressions (JVM side)."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Ranges of CJK code points, and identifiers made of ASCII signs.
CJK_RANGE = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
ASCII_TERM = r"[A-Za-z0-9_][A-Za-z0-9_.:/@+-]*"

#: Texts of a batch that Python holds at once.
SLICE = 64

WHITE = r"(?U)\s+"


def trim_unicode(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's own ``trim`` takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " "))


def one_line(c: Column, width: int) -> Column:
    """White space collapsed, cut to ``width`` characters with an ellipsis."""
    flat = normalize_text(c)
    return F.when(F.char_length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def excerpt(c: Column, needle: str, around: int) -> Column:
    """The first place of ``needle`` with up to ``around`` characters on either side; null where it is absent."""
    at = F.locate(needle, c)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(c, start, at + len(needle) + around - start))


def fold(c: Column) -> Column:
    return F.lower(c)


def cjk_ratio(c: Column) -> Column:
    """Share of CJK characters among those that aren't white space."""
    dense = F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, "")
    return (F.char_length(dense) - F.char_length(F.regexp_replace(dense, f"[{CJK_RANGE}]", ""))) / F.greatest(F.char_length(dense), F.lit(1))


def ascii_terms(c: Column, most: int) -> Column:
    """The first ``most`` identifiers, each once by its folded form, in the order they are seen first.

    An ordered distinct has no built-in form that is linear (a lambda would extract the terms anew for each one), so
    this is an Arrow function. It makes Python strings of SLICE texts at a time, whatever a batch holds.
    """

    def one(text: str | None) -> list[str]:
        seen: dict[str, str] = {}
        for m in re.finditer(ASCII_TERM, text or ""):
            if m.group().lower() not in seen:
                seen[m.group().lower()] = m.group()
                if len(seen) == most:
                    break
        return list(seen.values())

    @F.arrow_udf(ArrayType(StringType()))
    def terms(body: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return pa.concat_arrays([pa.array([], kind), *(pa.array([one(t.as_py()) for t in body.slice(i, SLICE)], kind) for i in range(0, len(body), SLICE))])

    return terms(c)


def or_query(terms: Column, most: int = 12) -> Column:
    """The first ``most`` terms, quoted and joined by OR."""
    return F.array_join(F.transform(F.slice(terms, 1, most), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def cjk_grams(c: Column, most: int = 24) -> Column:
    """Array of the distinct grams of three, then two signs of the CJK runs of a query, at most ``most``."""
    runs = F.regexp_extract_all(c, F.lit(f"[{CJK_RANGE}]+"), F.lit(0))

    def grams(n: int) -> Column:
        each = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(runs, lambda r: F.char_length(r) >= n), each))

    return F.slice(F.array_distinct(F.concat(grams(3), grams(2))), 1, most)


def shadow_query(c: Column, phrases: dict[str, str], default: str, share: float = 0.0) -> Column:
    """An ASCII form of a query whose CJK share reaches ``share``, for stores that know no CJK words: what the phrases
    it has stand for, in their order, then its identifiers as they are; ``default`` where there are neither."""
    known = F.filter(F.array(*[F.when(c.contains(k), F.lit(v)) for k, v in phrases.items()]), lambda x: x.isNotNull())
    own = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_.*:/-]+"), F.lit(0))
    parts = F.array_distinct(F.filter(F.array(F.array_join(known, " "), F.array_join(own, " ")), lambda x: x != ""))
    return F.when(cjk_ratio(c) < share, c).otherwise(F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.lit(default)))


#: What a rewritten query must keep (addresses, paths, words of ASCII letters), and numbers.
KEPT_TERM, NUMBER = r"https?://\S+|(?:[~/]|\.{1,2}/)[^\s]+|[A-Za-z][A-Za-z0-9_.*:/-]*", r"\d+(?:\.\d+)*"


def valid_rewrite(raw: Column, new: Column) -> Column:
    """Whether a rewritten query keeps every ASCII term and exactly the numbers of the raw one, and isn't longer than
    six times its dense length (256 at least)."""
    dense = F.char_length(F.regexp_replace(raw, WHITE, ""))
    own = F.regexp_extract_all(raw, F.lit(KEPT_TERM), F.lit(0))
    numbers = lambda x: F.sort_array(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)))
    return (F.char_length(new) <= F.greatest(F.lit(256), 6 * dense)) & F.forall(own, lambda e: new.contains(e)) & (numbers(raw) == numbers(new))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def is_scaffolding(c: Column, preambles: tuple[str, ...] = ()) -> Column:
    """Whether a text opens like markup, a heading or one of the given preambles."""
    head = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+", "")
    return reduce(lambda a, b: a | b, [head.startswith(p) for p in ("<", "#", *preambles)])


def elide_data_uris(c: Column) -> Column:
    """Base64 payloads of ``data:`` URIs become ``[elided]``; the scheme must not end a longer word, and what follows
    it up to the payload must be a media type."""
    return F.regexp_replace(c, r"""(?<![A-Za-z0-9+.-])(data:(?:(?!data:)[^\s,"'])*?;base64,)[A-Za-z0-9+/=]+""", "$1[elided]")


def render(block_type: Column, text: Column, tool_name: Column) -> Column:
    """The text of a block as it is stored: tool calls and results are labelled."""
    use = F.concat(F.lit("[tool_use "), F.coalesce(tool_name, F.lit("None")), F.lit("] "), text)
    result = F.concat(F.lit("[tool_result"), F.coalesce(F.concat(F.lit(" "), tool_name), F.lit("")), F.lit("] "), text)
    return F.when(block_type == "tool_use", trim_unicode(use)).when(block_type == "tool_result", trim_unicode(result)).otherwise(text)


def workdir(cwd: Column) -> Column:
    """A path as one name: everything but letters and digits is a dash; null where nothing else is left."""
    name = F.regexp_replace(F.trim(cwd), "[^A-Za-z0-9]", "-")
    return F.when(name.rlike("[^-]"), name)


def repo_identity(url: Column) -> Column:
    """``owner/name`` of an ssh or https remote."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-z+]+://", ""), r"(\.git)?/*$", "")
    parts = F.filter(F.split(F.regexp_replace(path, ":", "/"), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.slice(parts, -2, 2)))


def prose(c: Column) -> Column:
    """A text without its fenced code."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)```.*?(```|$)", "")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    pad = F.repeat(F.lit("="), (F.lit(4) - F.char_length(c) % 4) % 4)
    return F.unbase64(F.concat(F.translate(c, "-_", "+/"), pad)).cast("string")


def nul_encoded(c: Column) -> Column:
    """Reversible code for stores that refuse NUL."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\0"), F.lit("\\0"))


def nul_decoded(c: Column) -> Column:
    """The inverse of ``nul_encoded``: a pair of backslashes is one, a backslash and 0 is NUL. Pairs are told from the
    rest by parting at them first."""
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda p: F.replace(p, F.lit("\\0"), F.lit("\0"))), "\\")


def sort_key(c: Column) -> Column:
    """The bytes of the encoded text: their order is the same in every store, whatever its collation."""
    return nul_encoded(c).cast("binary")


def day(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def epoch_seconds(n: Column) -> Column:
    """Seconds of a number that is milliseconds when it is greater than 1e11."""
    return F.when(n > F.lit(1e11), n / 1000.0).otherwise(n)


def age(then: Column, now: Column) -> Column:
    """How long ago in the coarsest unit that fits."""
    s = now.cast("long") - then.cast("long")

    def unit(size: int, name: str) -> Column:
        n = F.floor(s / size)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(s < 60, F.lit("just now")).when(s < 3600, unit(60, "minute")).when(s < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
