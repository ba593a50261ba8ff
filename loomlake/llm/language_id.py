"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (n = 1 to 3) of words padded with a blank, in order of their
frequency. A document gets the language whose profile is the least out of place with its own: the sum, over the
document's n-grams, of how far each stands from its rank in the language's profile; one that the profile lacks costs
the most. The score is the share of the greatest possible distance that is not used up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, sliced, tidy, with_fields

#: n-grams of a language's profile and of a document's.
PROFILE, OWN, LONGEST = 400, 300, 3
UNDECIDED = "und"
#: Labelled documents of a language that its profile is learned from.
LEARN_DOCS = 5_000
#: A text whose score is lower is like none of the languages learned (by the review, random letters
#: reach 0.23 and the documents of sf0.01 0.475 or more).
LEAST_SCORE = 0.35
SLICE = 1 << 19

_BITS = np.uint64(21)
_LENGTH = (np.uint64(1) << _BITS) - np.uint64(1)


#: No letter has a greater code point.
_LAST = 0x3FFFF


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(_LAST + 1)), bool, _LAST + 1)


_LETTERS: list[np.ndarray] = []


#: Where a long text may be parted: none of these is a letter, and no n-gram has another character inside a word.
_BETWEEN = re.compile(r"[\s.,;:!?\u3001\u3002]")


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``slice_ngrams``; a text longer than SLICE characters is counted in pieces of whole words, and the counts are
    added, so that it needs the memory of one piece."""
    if len(texts) != 1 or not texts[0].is_valid or len(whole := texts[0].as_py()) <= SLICE:
        return slice_ngrams(texts)
    key, count, start = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    while start < len(whole):
        cut = _BETWEEN.search(whole, start + SLICE)
        end = cut.start() if cut else len(whole)
        _, more, n = slice_ngrams(pa.array([whole[start:end]], pa.large_string()))
        key, count = np.concatenate([key, more]), np.concatenate([count, n])
        short = key >> np.uint64(63) == 1  # of n-grams shorter than the longest the key tells the length
        order = np.lexsort((key, np.where(short, key & _LENGTH, np.uint64(LONGEST))))
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        key, count = key[first], np.add.reduceat(count, first) if len(first) else count
        start = end
    return np.zeros(len(key), np.int64), key, count


def slice_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, count) of the distinct n-grams of lower-cased letters, by text, the shorter ones first.

    A word is a run of letters with a blank before and after it. A key is three code points, the blank being 0; of a
    shorter n-gram the last one is its length, and the highest bit is set.
    """
    if not _LETTERS:
        _LETTERS.append(_letters())
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    size = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    # every text gets a blank before and after it: no word reaches into the next text
    text = np.repeat(np.arange(len(size)), size + 2)
    spaced = np.zeros(len(text), np.uint32)
    inner = np.ones(len(text), bool)
    ends = np.cumsum(size + 2)
    inner[ends - 1] = inner[ends - size - 2] = False
    spaced[inner] = np.where(_LETTERS[0][np.minimum(code, _LAST)], code, 0)
    # of a run of other characters one blank is left (of two texts: their own)
    keep = spaced != 0
    keep[1:] |= (spaced[:-1] != 0) | (text[1:] != text[:-1])
    keep[:1] = True
    c, t = spaced[keep], text[keep].astype(np.uint64)
    # letters as numbers of few bits, so that text, length and letters are one number to sort
    used = np.flatnonzero(np.bincount(c, minlength=1))
    number = np.zeros(len(used) and int(used[-1]) + 1, np.uint64)
    number[used] = np.arange(len(used), dtype=np.uint64)
    bits = max(1, int(len(used) - 1).bit_length()) if len(used) else 1
    if 3 * bits + 2 + len(size).bit_length() > 64:  # more letters than that: by halves
        half = len(texts) // 2
        if not half:
            raise ValueError("more than 2 ** 20 different letters")
        left, right = slice_ngrams(texts[:half]), slice_ngrams(texts[half:])
        return np.concatenate([left[0], right[0] + half]), np.concatenate([left[1], right[1]]), np.concatenate([left[2], right[2]])
    x = number[c] if len(c) else np.zeros(0, np.uint64)
    bits, parts = np.uint64(bits), []
    blank = c == 0
    for n in range(1, LONGEST + 1):
        m = len(x) - n + 1
        if m <= 0:
            continue
        code_ = t[:m] << np.uint64(2) | np.uint64(n)
        for k in range(LONGEST):
            code_ = code_ << bits | (x[k : k + m] if k < n else np.uint64(0))
        ok = t[:m] == t[n - 1 :]
        if n > 2:  # a blank inside parts two words
            for k in range(1, n - 1):
                ok &= ~blank[k : k + m]
        else:
            ok &= ~(blank[:m] & blank[n - 1 :])
        parts.append(code_[ok])
    whole = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.diff(whole, prepend=~whole[:1])) if len(whole) else np.zeros(0, np.int64)
    found = whole[at]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    n = found >> (bits * np.uint64(LONGEST)) & np.uint64(3)
    own = (found >> (bits * np.uint64(LONGEST) + np.uint64(2))).astype(np.int64)
    key = (n < LONGEST).astype(np.uint64)
    for k in range(LONGEST):
        letter = used.astype(np.uint64)[(found >> (bits * np.uint64(LONGEST - 1 - k)) & mask).astype(np.int64)]
        key = key << _BITS | (letter if k < LONGEST - 1 else np.where(n < LONGEST, n, letter))
    return own, key, np.diff(np.append(at, len(whole)))


def _ranked(own: np.ndarray, key: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, rank) of each text's most frequent n-grams; of equally frequent ones the one that ``ngrams`` gives
    first comes first."""
    order = np.argsort(own * (1 << 32) + ((1 << 32) - 1 - np.minimum(count, (1 << 32) - 1)), kind="stable")
    own, key = own[order], key[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    top = rank < most
    return own[top], key[top], rank[top]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = PROFILE, most: int = LEARN_DOCS) -> pd.DataFrame:
    """Profiles (``lang, key, rank``) from about ``most`` rows of each language (all, where it has fewer), chosen by a
    hash of their ids and texts. Counts are summed in each slice and again before the shuffle; what comes to the driver is
    ``size`` n-grams a language."""
    bounded_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 20)).alias("h"))
    each = labelled.groupBy("lang").count().collect()  # one row a language
    share = F.create_map(*[F.lit(v) for r in each for v in (r["lang"], max(1, round((1 << 20) * min(1.0, most / r["count"]))))]) if each else F.create_map().cast("map<string,int>")
    rows = labelled.filter(F.col("h") < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                own, key, n = ngrams(part.column(1))
                names = part.column(0).dictionary_encode()
                name = names.indices.to_numpy()[own].astype(np.int64)
                order = np.lexsort((key, name))
                name, key, n = name[order], key[order], n[order]
                new = np.ones(len(key), bool)
                new[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                if len(at):
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(name[at])), pa.array(key[at].view(np.int64)), pa.array(np.add.reduceat(n, at))], ["lang", "key", "n"])

    counts = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # the greatest counts of each part of the keys, then of these the greatest: no task ranks a whole language's keys
    part = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "key")
    some = counts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("at", F.row_number().over(part)).filter(F.col("at") <= size)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key")) - 1).filter(F.col("rank") < size)
    return top.select("lang", "key", "rank").toPandas().sort_values(["lang", "rank"], ignore_index=True)


class Profiles:
    """Ranks of all profiles' n-grams as one sorted table."""

    def __init__(self, learned: pd.DataFrame):
        self.langs = sorted(set(learned["lang"]))
        key = learned["key"].to_numpy(np.int64).view(np.uint64)
        self.keys = np.unique(key)
        self.absent = max(PROFILE, OWN)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        at = np.searchsorted(self.keys, key)
        self.ranks[at, [self.langs.index(x) for x in learned["lang"]]] = learned["rank"]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ties go to the language that comes first by name."""
        n = len(texts)
        langs, scores = [UNDECIDED] * n, np.zeros(n)
        if not self.langs or not n:
            return langs, scores
        own, key, rank = _ranked(*ngrams(texts), OWN)
        if not len(own):
            return langs, scores
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        theirs = self.ranks[np.where(self.keys[at] == key, at, len(self.keys))]
        cost = np.where(theirs < 0, self.absent, np.abs(theirs - rank[:, None]))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        total = np.add.reduceat(cost, first, axis=0)
        most = np.diff(np.append(first, len(own))) * self.absent
        best = total.argmin(axis=1)
        for i, j in zip(own[first], best, strict=True):
            langs[i] = self.langs[j]
        scores[own[first]] = 1 - total[np.arange(len(first)), best] / most
        return langs, np.clip(scores, 0, 1)


def identify(docs: DataFrame, learned: pd.DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (all its columns) plus ``lang_pred, score``.

    A text that is null or has no letter gets ``und`` and 0; so does every text when nothing was learned. Columns of
    ``docs`` named like the new ones are replaced. Rows are independent of each other: repeated ones get the same
    result. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("lang_pred", "score")
    names = [*base.columns, "lang_pred", "score"]
    at = names.index(text)
    profiles = docs.sparkSession.sparkContext.broadcast(Profiles(learned))  # PROFILE n-grams a language

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text, SLICE):
                langs, scores = profiles.value.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names)
                tidy()

    return base.mapInArrow(f, with_fields(base.schema, lang_pred="string", score="double"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
