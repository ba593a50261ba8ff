"""Personal data: rule spans, and a skip-chain conditional random field that makes labels consistent in a document.

Rules find e-mail addresses, IP addresses, card and phone numbers; their spans stay. Further candidates (number-like
strings and spelled-out addresses that no rule takes) are nodes of a conditional random field, together with the rule
spans, whose labels are observed. Its potentials: a log-linear one of each node's features, one of the labels of
neighbouring nodes, and a skip potential between nodes whose identifying part is the same, wherever they stand.
A group of such nodes is joined through one hub, so its messages are linear in its size. Loopy belief propagation gives
each candidate's label; a label other than none that is sure enough adds a span.

The weights are learned from a bounded sample of documents (``TRAIN_DOCS``), from rule spans with some of their telling
features hidden, against the number-like strings that no rule takes.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, with_fields

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents whose candidates are learned from, about; and how sure an added label must be.
TRAIN_DOCS, SURE = 20_000, 0.9
ROUNDS, DAMPING = 20, 0.3
#: Least and greatest reward of equal labels of nodes that are joined.
SKIP = (6.0, 9.0)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_SPELLED = re.compile(r"\b([A-Za-z0-9._%+-]{1,64}) ?(?:\(at\)|\[at\]) ?([A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,6})")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, each text position read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) and at > last:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    label: int  # observed; 0 where it isn't
    features: tuple[int, ...]
    keys: tuple[str, ...]  # nodes that share one are joined


def _features(s: str, digits: str, at_sign: bool) -> tuple[int, ...]:
    """Discrete features: number of digits, how they are grouped, what else there is."""
    n = min(len(digits), 20)
    dots, groups = min(s.count("."), 4), min(len(re.findall("[0-9]+", s)), 6)
    return (n, 21 + dots, 26 + groups, 33 + ("(" in s), 35 + (" " in s or "-" in s), 37 + (16 <= len(digits) <= 19 and luhn(digits)), 39 + at_sign, 41 + s.startswith("+"))


FEATURES = 43
#: Features that tell a rule span from the rest; learning hides them from half of the spans.
_TELLING = {41, 42}


def nodes(text: str) -> list[Node]:
    """Rule spans and candidates in the order of the text."""
    found = []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    for kind, a, b in base:
        s = text[a:b]
        digits = "".join(c for c in s if "0" <= c <= "9")
        keys = (f"a{s.lower()}",) if kind == "email" else (f"d{kind == 'ip' and s or digits[-9:]}",)
        found.append(Node(a, b, LABELS.index(kind), _features(s, digits, kind == "email"), keys))

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (a, a))
        return not (i < len(taken) and taken[i][0] < b) and not (i and taken[i - 1][1] > a)

    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            digits = "".join(c for c in m.group() if "0" <= c <= "9")
            if 7 <= len(digits) <= 40 and free(*m.span()):
                found.append(Node(*m.span(), 0, _features(m.group(), digits, False), (f"d{digits[-9:]}",) if len(digits) >= 9 else ()))
    if "at)" in text or "at]" in text:
        for m in _SPELLED.finditer(text):
            if free(*m.span()):
                plain = re.sub(r" ?(?:\(dot\)|\[dot\]) ?", ".", m.group(2))
                found.append(Node(*m.span(), 0, _features("", "", True), (f"a{m.group(1)}@{plain}".lower(),)))
    return sorted(found, key=lambda x: (x.start, x.end, x.label))


@dataclass
class Model:
    unary: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels
    skip: float  # reward of equal labels in a group

    def marginals(self, own: list[Node]) -> np.ndarray:
        """Loopy belief propagation, all messages at once, damped; observed labels are fixed."""
        n, k = len(own), len(LABELS)
        local = np.stack([self.unary[list(x.features)].sum(0) for x in own])
        for i, x in enumerate(own):
            if x.label:
                local[i] = -50.0
                local[i, x.label] = 0.0
        hubs: dict[str, int] = {}
        pairs = [(i, hubs.setdefault(key, len(hubs))) for i, x in enumerate(own) for key in x.keys]
        size = np.bincount([h for _, h in pairs], minlength=len(hubs)) if pairs else np.zeros(0, int)
        pairs = [(i, h) for i, h in pairs if size[h] > 1]
        left, right = np.zeros((n, k)), np.zeros((n, k))  # messages to a node from its left, right neighbour
        node = np.array([i for i, _ in pairs], int)
        hub = np.array([h for _, h in pairs], int)
        to_node, to_hub = np.zeros((len(pairs), k)), np.zeros((len(pairs), k))
        agree = self.skip * np.eye(k)
        for _ in range(ROUNDS):
            belief = local + left + right
            np.add.at(belief, node, to_node)
            new_left, new_right = np.zeros_like(left), np.zeros_like(right)
            if n > 1:
                new_left[1:] = _through(belief[:-1] - right[:-1], self.chain)
                new_right[:-1] = _through(belief[1:] - left[1:], self.chain.T)
            if len(pairs):
                new_hub = _through(belief[node] - to_node, agree)
                total = np.zeros((len(hubs), k))
                np.add.at(total, hub, new_hub)
                new_node = _through(total[hub] - new_hub, agree)
                new_node = DAMPING * to_node + (1 - DAMPING) * new_node
                moved = max(np.abs(new_hub - to_hub).max(), np.abs(new_node - to_node).max())
                to_hub, to_node = new_hub, new_node
            else:
                moved = 0.0
            moved = max(moved, np.abs(new_left - left).max(), np.abs(new_right - right).max())
            left, right = new_left, new_right
            if moved < 1e-4:
                break
        belief = local + left + right
        np.add.at(belief, node, to_node)
        belief -= belief.max(1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(rule spans, all spans), each by kind, then start."""
        if not text:
            return [], []
        own = nodes(text)
        base = base_spans(text)
        if all(x.label for x in own):
            return base, base
        p = self.marginals(own)
        added = []
        for x, q in zip(own, p, strict=True):
            if not x.label and (best := int(q.argmax())) and q[best] >= SURE:
                added.append((LABELS[best], x.start, x.end))
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _through(message: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """log sum over the sender's labels of exp(message + potential), scaled."""
    x = message[:, :, None] + potential[None]
    top = x.max(1, keepdims=True)
    out = (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
    return out - out.max(1, keepdims=True)


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """The model of a sample of about ``train_docs`` documents, chosen by a hash of their ids; counts of feature and
    label combinations come to the driver, at most a few thousand rows."""
    bounded_batches(docs.sparkSession)
    step = max(1, docs.count() // train_docs)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, a, b, n = [], [], [], []
        seen: Counter = Counter()
        for x in batch.column(0).to_pylist():
            own = nodes(x) if x else []
            last: dict[str, int] = {}
            named = {key for node in own if node.label for key in node.keys}
            # a candidate that repeats a rule span is neither an example of none nor of the span's label
            own = [node for node in own if node.label or named.isdisjoint(node.keys)]
            for i, node in enumerate(own):
                seen["node", ",".join(map(str, node.features)), node.label] += 1
                if i:
                    seen["chain", str(own[i - 1].label), node.label] += 1
                for key in node.keys:
                    if key in last:
                        seen["skip", str(int(last[key] == node.label)), 0] += 1
                    last[key] = node.label
        for (x, y, z), c in seen.items():
            kind.append(x)
            a.append(y)
            b.append(z)
            n.append(c)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

    rows = docs.filter(F.pmod(F.xxhash64(doc_id, text), F.lit(step)) == 0).select(F.col(text).alias("text"))
    counts = rows.mapInArrow(by_slices(f, "text"), "kind string, a string, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    k = len(LABELS)
    chain = np.ones((k, k))
    agree = [1.0, 1.0]
    examples: list[tuple[tuple[int, ...], int, float]] = []
    for kind, a, b, n in sorted(map(tuple, counts)):
        if kind == "chain":
            chain[int(a), b] += n
        elif kind == "skip":
            agree[int(a)] += n
        else:
            own = tuple(map(int, a.split(",")))
            if b:  # half as it is, half without what the rule goes by
                examples += [(own, b, n / 2), (tuple(x for x in own if x not in _TELLING), b, n / 2)]
            else:
                examples.append((own, 0, float(n)))
    # labels of neighbours: their ratio to chance, held near 0
    joint = chain / chain.sum()
    chance = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    ratio = np.clip(np.log(joint / chance), -1, 1)
    return Model(_fit(examples), ratio, float(np.clip(np.log(agree[1] / agree[0]), *SKIP)))


def _fit(examples: list[tuple[tuple[int, ...], int, float]], steps: int = 400) -> np.ndarray:
    """Multinomial logistic regression on discrete features, by gradient steps with a quadratic penalty."""
    k = len(LABELS)
    weights = np.zeros((FEATURES, k))
    if not examples:
        weights[:, 0] = 0.5
        return weights
    x = np.zeros((len(examples), FEATURES))
    for i, (own, _, _) in enumerate(examples):
        x[i, list(own)] = 1
    y = np.eye(k)[[b for _, b, _ in examples]]
    n = np.array([c for _, _, c in examples])
    n = np.sqrt(n) / np.sqrt(n).sum()  # a frequent shape doesn't drown the others
    for _ in range(steps):
        z = x @ weights
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        weights -= 1.0 * (x.T @ ((p - y) * n[:, None]) + 1e-3 * weights)
    return weights


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` (all its columns) plus ``base_spans, spans`` (strings ``kind:start:end``, comma-joined, by kind, then
    start; code points, end exclusive) and ``n_email, n_ip, n_card, n_phone`` (rule spans).

    Null and empty texts have none; rows are independent of each other; columns named like the new ones are replaced.
    An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    new = {"base_spans": "string", "spans": "string", **{f"n_{k}": "long" for k in KINDS}}
    base = docs.drop(*new)
    names = [*base.columns, *new]
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, all_, n = [], [], {k: [] for k in KINDS}
        for x in batch.column(at).to_pylist():
            a, b = shared.value.spans(x)
            own.append(joined_spans(a))
            all_.append(joined_spans(b))
            for k in KINDS:
                n[k].append(sum(s[0] == k for s in a))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string()), pa.array(all_, pa.string()), *(pa.array(n[k], pa.int64()) for k in KINDS)], names)

    return base.mapInArrow(by_slices(f, text), with_fields(base.schema, **new))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest one counts."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
            last = b
    return "".join([*out, text[last:]])

