"""A session's digest: which of its units show best what it was about, without a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import duplicates, graph

#: Weights of block types (fixed values).
WEIGHTS = {"text": 1.0, "tool_use": 0.35, "tool_result": 0.2}
#: Lengths that count as nothing; units of a session whose pairs are all compared (fixed values).
EPSILON, EXACT_UNITS = 1e-7, 3_000
#: Characters that a shown unit costs beside its text; the least a unit may show; what a tool result may (fixed values).
FRAME, LEAST_SHOWN, RESULT_SHOWN = 96, 240, 2000
#: Stands where a shown text was shortened.
SHORTENED = "\n\n[… shortened …]\n\n"


def unit_weight(block_type: Column) -> Column:
    return F.when(block_type == "text", WEIGHTS["text"]).when(block_type == "tool_use", WEIGHTS["tool_use"]).otherwise(WEIGHTS["tool_result"])


def unit_quality(block_type: Column, body: Column) -> Column:
    return unit_weight(block_type) * F.least(F.greatest(F.sqrt(F.char_length(body) / 200.0), F.lit(0.25)), F.lit(1.0))


def display(body: Column, block_type: Column, units: int, budget: int) -> Column:
    """A unit's text as it is shown: its first seven tenths and its last three, with a mark between, where it is longer
    than an even share of the budget (a tool result: than the lesser of that and its own bound)."""
    cap = max(budget // max(units, 1), LEAST_SHOWN)
    limit = F.when(block_type == "tool_result", min(cap, RESULT_SHOWN)).otherwise(cap)
    kept = limit - len(SHORTENED)
    head = F.floor(kept * 7 / 10).cast("int")
    return F.when(F.char_length(body) > limit, F.concat(F.left(body, head), F.lit(SHORTENED), F.right(body, (kept - head).cast("int")))).otherwise(body)


#: Units and characters that a digest may have (fixed values).
MOST_UNITS, CHARS = 40, (1_000, 40_000)


def clamped(units: Column, chars: Column) -> Column:
    """``struct<units, chars, units_changed, chars_changed>``: what is asked for within bounds (no more units than the
    characters can show), and the new numbers where they differ from what was asked."""
    c = F.least(F.greatest(chars, F.lit(CHARS[0])), F.lit(CHARS[1]))
    u = F.least(F.greatest(units, F.lit(1)), F.lit(MOST_UNITS), F.greatest(F.floor(c / LEAST_SHOWN), F.lit(1)))
    return F.struct(u.cast("long").alias("units"), c.cast("long").alias("chars"), F.when(u != units, u).cast("long").alias("units_changed"), F.when(c != chars, c).cast("long").alias("chars_changed"))


def _unit(v: np.ndarray) -> np.ndarray | None:
    size = float(np.linalg.norm(v))
    return v / size if size > EPSILON else None


def _first_best(score: np.ndarray) -> int | None:
    return int(score.argmax()) if len(score) else None


def _middle(v: np.ndarray, has: np.ndarray, mass: np.ndarray) -> np.ndarray | None:
    """The mean of the units that have a vector, by mass."""
    if not has.any():
        return None
    total = float(mass[has].sum())
    return (mass[has, None] * v[has]).sum(0) / (total if total > 0 else 1.0)


def anchors(kind: np.ndarray, role: np.ndarray, v: np.ndarray, has: np.ndarray, mass: np.ndarray, quality: np.ndarray) -> dict[str, int]:
    """Units that a digest always has: the first text of the user (else of anyone), the last of the assistant, and the
    text nearest to what the session is about on the whole. The first two need no vector."""
    out: dict[str, int] = {}
    texts = np.flatnonzero(kind == "text")
    asked = texts[role[texts] == "user"]
    if len(texts):
        out["opening"] = int(asked[0] if len(asked) else texts[0])
    if len(said := texts[role[texts] == "assistant"]):
        out["closing"] = int(said[-1])
    middle = _middle(v, has, mass)
    near = texts[has[texts]]
    if middle is not None and len(near) and (way := _unit(middle)) is not None:
        out["medoid"] = int(near[_first_best(quality[near] * np.maximum(v[near] @ way, 0))])
    return out


def axes(v: np.ndarray, has: np.ndarray, mass: np.ndarray, quality: np.ndarray, most: int) -> list[int]:
    """Both extremes of up to ``most`` directions in which the units differ most from their centre; each direction is
    that of the unit with the greatest quality times what the directions before leave of it."""
    own = np.flatnonzero(has)
    middle = _middle(v, has, mass)
    if middle is None:
        return []
    away, quality, out = v[own] - middle, quality[own], []
    left = away.copy()
    for _ in range(most):
        score = quality * np.linalg.norm(left, axis=1)
        best = _first_best(score)
        if not score[best] > EPSILON or (way := _unit(left[best])) is None:
            break
        along = away @ way
        for side in (along, -along):
            reach = quality * np.maximum(side, 0)
            if reach[k := _first_best(reach)] > 0:
                out.append(int(own[k]))
        left = left - np.outer(left @ way, way)
    return out


def turn_vectors(turn: np.ndarray, v: np.ndarray, has: np.ndarray, mass: np.ndarray) -> list[np.ndarray | None]:
    """The direction of each turn: the mean of its units by mass; none where no unit has a vector."""
    n = int(turn[-1]) + 1 if len(turn) else 0
    sums, weight, units = np.zeros((n, v.shape[1])), np.bincount(turn[has], mass[has], n), np.bincount(turn[has], minlength=n)
    np.add.at(sums, turn[has], mass[has, None] * v[has])
    return [_unit(sums[t] / (weight[t] if weight[t] > 0 else 1.0)) if units[t] else None for t in range(n)]


def pivots(turns: list[np.ndarray | None], most: int) -> list[tuple[int, float]]:
    """(turn before, distance) of the boundaries at which the two turns before and the two after differ most, none
    within two of a stronger one. Turns without a vector don't count; a side with none is no boundary."""

    def side(some: list[np.ndarray | None]) -> np.ndarray | None:
        there = [x for x in some if x is not None]
        return _unit(np.mean(there, axis=0)) if there else None

    found = []
    for at in range(len(turns) - 1):
        left, right = side(turns[max(at - 1, 0) : at + 1]), side(turns[at + 1 : at + 3])
        if left is not None and right is not None:
            found.append((max(0.0, 1 - float(left @ right)), at))
    out: list[tuple[int, float]] = []
    for far, at in sorted(found, key=lambda x: (-x[0], x[1])):
        if len(out) < most and all(abs(at - o) > 2 for o, _ in out):
            out.append((at, far))
    return out


def shown_chars(kind: np.ndarray, chars: np.ndarray, units: int, budget: int) -> np.ndarray:
    cap = max(budget // max(units, 1), LEAST_SHOWN)
    return np.minimum(chars, np.where(kind == "tool_result", min(cap, RESULT_SHOWN), cap)) + FRAME


def chosen_units(kind: np.ndarray, role: np.ndarray, turn: np.ndarray, v: np.ndarray, has: np.ndarray, mass: np.ndarray, quality: np.ndarray, chars: np.ndarray, units: int, budget: int) -> list[int]:
    """The digest's units in the order they are chosen: the anchors, then of the extremes and the sides of the pivots
    the one that covers most mass for its length, a pivot's strength added, while the number of units and the
    characters allow it and the best gain is a quarter of an even share of the whole mass.

    ``turn`` numbers the units' turns from 0, ascending; ``v`` is 0 for units without a vector (``has`` tells them
    apart), which can be anchors but cover nothing and add to the whole mass only."""
    must = list(dict.fromkeys(anchors(kind, role, v, has, mass, quality).values()))
    pool = must + [i for i in axes(v, has, mass, quality, min(6, max(1, max(units - len(must), 0) // 2))) if i not in must]
    strength: dict[int, float] = {}
    texts = np.flatnonzero(kind == "text")
    for at, far in pivots(turn_vectors(turn, v, has, mass), min(6, max(1, units // 2))):
        for side in (texts[turn[texts] <= at][-1:], texts[turn[texts] > at][:1]):
            for i in side.tolist():
                pool.append(i)
                strength[i] = max(strength.get(i, 0.0), far)
    pool, out = list(dict.fromkeys(pool)), must.copy()
    cost = shown_chars(kind, chars, units, budget)
    near = np.maximum(v[pool] @ v.T, 0) if pool else np.zeros((0, len(v)))  # a few dozen rows
    covered = near[: len(must)].max(0, initial=0.0)
    spent, share, top = int(cost[out].sum()), float(mass.sum()) / max(units, 1), max(strength.values(), default=0.0)
    while len(out) < units:
        best = None
        for k, i in enumerate(pool):
            if i in out or not has[i] or spent + cost[i] > budget:
                continue
            gain = float((mass * np.maximum(near[k] - covered, 0)).sum()) + (0.5 * share * strength.get(i, 0.0) / top if top else 0.0)
            score = gain / np.sqrt(1 + cost[i] / 4000.0)
            if best is None or score > best[0]:
                best = (score, gain, k)
        if best is None or best[1] < 0.25 * share:
            break
        out.append(pool[best[2]])
        spent += int(cost[out[-1]])
        covered = np.maximum(covered, near[best[2]])
    return out


def with_mass(rows: DataFrame, key: str = "unit_id", exact: int = EXACT_UNITS) -> DataFrame:
    """``rows`` (``session_id, block_type, text_hash, vector`` and ``key``, which no two share) with ``mass``: the
    weight of the unit's type, shared by the units that say the same: equal texts, and vectors of cosine 0.97 or more.

    All pairs of a session of at most ``exact`` units are compared, in blocks; of a longer one those by window and
    bands. What comes out of the comparison is joined by key, so that no session's pairs meet in one task."""
    there = rows.filter("vector is not null").select("session_id", key, "vector")
    sizes = there.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = there.join(sizes, "session_id")
    short, long = sized.filter(F.col("_n") <= exact).drop("_n"), sized.filter(F.col("_n") > exact).drop("_n")
    unit = lambda df: df.withColumn("vector", _normalized(F.col("vector")))
    pairs = graph.similar_pairs(unit(short), "session_id", key, "vector", duplicates.NEAR).select("a", "b")
    far = duplicates.links(long, "session_id", key, [key], "vector")
    first = rows.groupBy("session_id", "text_hash").agg(F.min(key).alias("a"))
    equal = rows.join(first, ["session_id", "text_hash"]).filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))
    found = graph.components(pairs.unionByName(far).unionByName(equal)).select(F.col("node").alias(key), "root")
    size = found.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    shared = found.join(size, "root").select(key, "_size")
    return rows.join(shared, key, "left").withColumn("mass", unit_weight(F.col("block_type")) / F.coalesce("_size", F.lit(1))).drop("_size")


def _normalized(vector: Column) -> Column:
    from ..functions import vectors as V

    return V.normalized(vector)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn numbers, vectors of length 1 (0 where there is none) and whether there is one, of units in order."""
    has = pdf["vector"].notna().to_numpy()
    size = len(pdf["vector"][has].iloc[0]) if has.any() else 1
    v = np.zeros((len(pdf), size))
    if has.any():
        v[has] = np.array(pdf["vector"][has].tolist(), np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    has &= norm[:, 0] > EPSILON
    seq, turn = pdf["seq"].to_numpy(), pdf["turn_uuid"].fillna("").to_numpy()
    new = np.ones(len(pdf), bool)
    new[1:] = (seq[1:] != seq[:-1]) | (turn[1:] != turn[:-1])
    return np.cumsum(new) - 1, v / np.maximum(norm, 1e-300) * has[:, None], has


_ORDER = ["seq", "turn_uuid", "unit_id"]


def digest(rows: DataFrame, units: int = 8, budget: int = 12_000) -> DataFrame:
    """``session_id, unit_id, seq, place`` of the chosen units, ``place`` in the order of choice. ``rows``: ``session_id,
    seq, turn_uuid, unit_id, role, block_type, text_hash, vector, quality, chars``, one per unit; units of a turn are
    ordered by ``unit_id``. Mass is counted over all sessions at once (``with_mass``); then a session is one task's
    work: units times candidates, of which there are a few dozen however long it is. Units without a vector take part
    as anchors. An empty table gives no rows."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ORDER, kind="stable", na_position="first")
        turn, v, has = _arrays(pdf)
        own = chosen_units(pdf["block_type"].to_numpy(), pdf["role"].to_numpy(), turn, v, has, pdf["mass"].to_numpy(), pdf["quality"].to_numpy(), pdf["chars"].to_numpy(), units, budget)
        return pdf.iloc[own][["session_id", "unit_id", "seq"]].assign(place=range(len(own)))

    base = with_mass(rows).select("session_id", F.col("seq").cast("long").alias("seq"), "turn_uuid", "unit_id", "role", "block_type", F.col("vector").cast("array<double>").alias("vector"), "mass", F.col("quality").cast("double").alias("quality"), F.col("chars").cast("long").alias("chars"))
    kind = base.schema["unit_id"].dataType.simpleString()
    return base.groupBy("session_id").applyInPandas(choose, f"session_id string, unit_id {kind}, seq long, place int")


def session_anchors(rows: DataFrame) -> DataFrame:
    """``session_id, opening, closing, medoid``: the units that a digest of the session always has (a unit may be
    several of them). ``rows`` as for ``digest``, with ``mass``."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ORDER, kind="stable", na_position="first")
        _, v, has = _arrays(pdf)
        named = anchors(pdf["block_type"].to_numpy(), pdf["role"].to_numpy(), v, has, pdf["mass"].to_numpy(), pdf["quality"].to_numpy())
        own = pdf["unit_id"].tolist()
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[:1].tolist()} | {n: pd.Series([own[named[n]] if n in named else None], dtype=object) for n in ("opening", "closing", "medoid")})

    kind = rows.schema["unit_id"].dataType.simpleString()
    return rows.select("session_id", "seq", "turn_uuid", "unit_id", "role", "block_type", F.col("vector").cast("array<double>").alias("vector"), "mass", "quality").groupBy("session_id").applyInPandas(find, f"session_id string, opening {kind}, closing {kind}, medoid {kind}")


def transitions(rows: DataFrame, most: int = 6) -> DataFrame:
    """``session_id, seq, distance``: the turns (by their ``seq``) behind which a session changes most: where the two
    turns before and the two after differ, none within two of a stronger one. ``rows`` as for ``digest``, with
    ``mass``; a turn may have several units. A session of one turn has none."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ORDER, kind="stable", na_position="first")
        turn, v, has = _arrays(pdf)
        found = pivots(turn_vectors(turn, v, has, pdf["mass"].to_numpy()), most)
        first = np.searchsorted(turn, [at for at, _ in found])
        seq = pdf["seq"].to_numpy()
        return pd.DataFrame({"session_id": pd.Series([pdf["session_id"].iloc[0]] * len(found), dtype=object), "seq": pd.Series(seq[first] if len(found) else [], dtype="int64"), "distance": pd.Series([far for _, far in found], dtype="float64")})

    base = rows.select("session_id", F.col("seq").cast("long").alias("seq"), "turn_uuid", "unit_id", F.col("vector").cast("array<double>").alias("vector"), F.col("mass").cast("double").alias("mass"))
    return base.groupBy("session_id").applyInPandas(find, "session_id string, seq long, distance double")
