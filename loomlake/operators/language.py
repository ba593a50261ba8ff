"""The language of a text: multinomial Bayes over letter trigrams, by joins and sums.

The model is a small table, learned from labelled documents: the most frequent trigrams of each language, with how
likely each is in every language. A text's trigrams meet it in a broadcast join, and what they say is summed by text;
scores are whole thousandths, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Trigrams of each language in the model, and labelled documents that it is learned from at most, about.
GRAMS, LEARN_DOCS = 300, 2_000
#: A label holds if every other language is at least nine times less likely: 1000 * ln(9).
MARGIN = 2197


def trigrams(body: Column) -> Column:
    """All runs of three of a text's letters and the blanks around its words, as often as they occur."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.regexp_extract_all(words, F.lit(r"(?s)(?=(.{3}))"), F.lit(1))


def _number(body: Column) -> Column:
    """A number below 2 ** 28 out of a text, the same in any engine."""
    return F.conv(F.left(F.md5(body.cast("binary")), F.lit(7)), 16, 10).cast("long")


def learn(docs: DataFrame, body: str = "text", lang: str = "lang", grams: int = GRAMS, most: int = LEARN_DOCS) -> DataFrame:
    """``gram, lang, score``: a row for each trigram of the model and language. Learned from about ``most`` documents
    of each language (all, where it has fewer), chosen by a hash of their texts; documents without a label are left
    out."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(body).isNotNull()).select(F.col(lang).alias("lang"), F.col(body).alias("body"))
    each = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))  # one row a language
    some = known.join(F.broadcast(each), "lang").filter(_number(F.col("body")) % F.col("_n") < most)
    counts = some.select("lang", F.explode(trigrams(F.col("body"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_r") <= grams)
    chosen = frequent.select("gram").distinct()
    langs = each.select("lang")
    full = chosen.crossJoin(F.broadcast(langs)).join(counts, ["gram", "lang"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_lang = Window.partitionBy("lang")  # GRAMS rows for each language at most
    likely = (F.col("n") + 1) / (F.sum("n").over(of_lang) + F.count(F.lit(1)).over(of_lang))
    return full.select("gram", "lang", F.round(1000 * F.log(likely)).cast("long").alias("score"))


def languages(rows: DataFrame, keys: list[str], body: str, model: DataFrame) -> DataFrame:
    """``keys, lang``: the language of each row's text; null where it has no trigram of the model, or where the model
    doesn't tell it from another language. Rows that share their keys count as one text. ``model`` is broadcast: it has
    GRAMS rows for each pair of languages at most."""
    grams = rows.select(*keys, F.explode_outer(trigrams(F.col(body))).alias("gram"))
    told = grams.join(F.broadcast(model), "gram", "left").groupBy(*keys, "lang").agg(F.sum("score").alias("score"))
    best = F.reverse(F.array_sort(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("score", "lang")))))  # one for each language
    ranked = told.groupBy(*keys).agg(best.alias("_b"))
    clear = (F.size("_b") > 0) & ((F.size("_b") == 1) | (F.get("_b", 0)["score"] - F.get("_b", 1)["score"] >= MARGIN))
    return ranked.select(*keys, F.when(clear, F.get("_b", 0)["lang"]).alias("lang"))


def block_languages(chunks: DataFrame, model: DataFrame, scaffold: Column) -> DataFrame:
    """``id, lang`` of chunks: only the first piece of a text block of a user or an assistant has a language, and not
    where ``scaffold`` says that a user's text isn't theirs; code between fences is left out."""
    own = F.col("block_type").eqNullSafe("text") & (F.col("split_idx") == 0) & F.col("role").isin("user", "assistant") & ~F.coalesce((F.col("role") == "user") & scaffold, F.lit(False))
    found = languages(chunks.filter(own).select("id", X.prose(F.col("text")).alias("_prose")), ["id"], "_prose", model)
    return chunks.select("id").join(found, "id", "left")
