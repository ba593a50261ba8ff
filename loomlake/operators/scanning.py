"""The seam for secret scanners: any function over texts, failing closed, and what is done with its findings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import DETECTORS

#: (detector, secret, decoder) of each finding. PLAIN: the secret stands in the text as it is.
Finding = tuple[str, str, str]
Scanner = Callable[[list[str]], list[list[Finding]]]
PLAIN = "PLAIN"

_FINDING = T.StructType([T.StructField("detector", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("decoder", T.StringType())])


class ScanError(RuntimeError):
    """A scan that can't be relied on."""


def pattern_scanner(texts: list[str]) -> list[list[Finding]]:
    """The built-in detectors as a scanner."""
    out: list[list[Finding]] = []
    for t in texts:
        found = []
        for name, pattern in DETECTORS.items():
            found += [(name, m.group(m.lastindex or 0), PLAIN) for m in re.finditer(pattern, t)]
        out.append(found)
    return out


def scan(body: Column, scanner: Scanner) -> Column:
    """``array<struct<detector, raw, decoder>>`` of each text. A text must be a whole block, so that no secret is cut
    in two. What the scanner raises ends the job, and so does an answer for fewer or more texts than were given, or
    one that is no list of findings: a text that wasn't scanned never passes as clean. Null texts are empty."""

    @F.pandas_udf(T.ArrayType(_FINDING))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.fillna("").tolist()
            found = scanner(texts)
            if found is None or len(found) != len(texts):
                raise ScanError(f"the scanner answered for {len(found or ())} texts but was given {len(texts)}; they don't count as clean")
            if any(f is None or any(len(x) != 3 or not x[1] for x in f) for f in found):
                raise ScanError("the scanner gave something that is no list of findings")
            yield pd.Series([[{"detector": d, "raw": r, "decoder": c} for d, r, c in f] for f in found], index=b.index)

    return run(body)


def excised(rows: DataFrame, body: str, findings: str = "findings") -> DataFrame:
    """``rows`` with ``body`` without its secrets, ``removed`` (the detectors of the different secrets taken out, by
    secret) and ``held``: whether a secret is left, because it isn't there as it was found, or was found under an
    encoding. Held rows have a null ``body`` and must not be shown. The longest secrets are taken out first, so that
    one that is a part of another leaves nothing behind."""
    distinct = F.array_distinct(F.coalesce(F.col(findings), F.array().cast("array<struct<detector:string,raw:string,decoder:string>>")))
    text = F.coalesce(F.col(body), F.lit(""))
    plain = F.filter("_found", lambda f: (f["decoder"] == PLAIN) & text.contains(f["raw"]))
    longest = F.array_sort("_plain", lambda a, b: F.when(F.char_length(a["raw"]) != F.char_length(b["raw"]), F.char_length(b["raw"]) - F.char_length(a["raw"])).when(a["raw"] < b["raw"], -1).when(a["raw"] > b["raw"], 1).when(a["detector"] < b["detector"], -1).when(a["detector"] > b["detector"], 1).otherwise(0))
    out = F.aggregate("_plain", text, lambda t, f: F.replace(t, f["raw"], F.concat(F.lit("[REDACTED:"), f["detector"], F.lit("]"))))
    held = F.size("_plain") < F.size("_found")
    steps = rows.withColumn("_found", distinct).withColumn("_plain", plain).withColumn("_plain", longest)
    # of a secret that two detectors found the first counts
    one = F.filter("_plain", lambda f, i: (i == 0) | (F.get("_plain", i - 1)["raw"] != f["raw"]))
    steps = steps.withColumn("held", held).withColumn("_plain", one)
    done = steps.withColumn("removed", F.transform("_plain", lambda f: f["detector"])).withColumn("_out", F.when(~F.col("held"), out))
    return done.withColumn(body, F.col("_out")).drop("_found", "_plain", "_out")
