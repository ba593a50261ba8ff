"""The registered queries over the smallest tables: against their SQL, or against the tables read plainly."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest

from loomlake.llm import queries as Q

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    import pyarrow.dataset as ds

    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text", "lang"]).sort_by("doc_id")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)), dict(zip(t.column("doc_id").to_pylist(), t.column("lang").to_pylist(), strict=True))


def run(spark, name):
    return Q.queries()[name](spark, SF).collect()


def ids(texts):
    from tokenizers import Tokenizer

    from loomlake.llm.tok import default_path

    return [e.ids for e in Tokenizer.from_file(default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_one_query_for_each_operator():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(Q.oracle_sql()[name]).fetchdf()
    got = Q.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[columns].astype(str).to_numpy().tolist()))


def test_op1(spark, docs):
    got = collections.defaultdict(list)
    for r in run(spark, "op1_packing"):
        got[r["doc_id"]].append(r)
    for i, x in zip(docs[0], ids(docs[0].values()), strict=True):
        x = [*x, 2]
        assert sum(r["length"] for r in got[i]) == len(x)
        for r in got[i]:
            assert r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(x)


def test_op3_has_the_planted_conversation(spark):
    r = next(r for r in run(spark, "op3_chat_format") if r["conv_id"] == -7)
    text = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text))
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_op5(spark, docs):
    got = run(spark, "op5_language_id")
    assert len(got) == len(docs[0])
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[1][r["doc_id"]] for r in held]) > 0.95


def test_op6(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op6_token_store")}
    start = 0
    for i, x in zip(docs[0], ids(docs[0].values()), strict=True):
        x = [*x, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(x), crc(x))
        start += len(x)


def test_op9(spark, docs):
    from loomlake.llm.substring_dedup import brute_force

    want = brute_force([(t or "").encode() for t in docs[0].values()], 200)
    assert sorted(map(tuple, run(spark, "op9_substring_dedup"))) == sorted((i, *w) for i, w in zip(docs[0], want, strict=True))


@pytest.mark.parametrize("name", ["op2_near_dedup", "op4_pii", "op7_line_dedup"])
def test_a_row_for_each_document(spark, docs, name):
    assert sorted(r["doc_id"] for r in run(spark, name)) == sorted(docs[0])


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_op4_equals_the_plain_patterns(spark, docs):
    import re

    got = {r["doc_id"]: r for r in run(spark, "op4_pii")}
    assert sorted(got) == sorted(docs[0])
    some = 0
    for i, text in docs[0].items():
        spans = [(k, m.start(), m.end()) for k, pattern in KINDS for m in re.finditer(pattern, text or "") if holds(k, m[0])]
        some += len(spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), i
        assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(s[0] == k for s in spans) for k, _ in KINDS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))  # the method adds, it takes none away
    assert some > 20


def test_op8_equals_every_interval_at_every_placing(spark, docs):
    """The best overlap of each document and item; placings with too few words in place are told by a product."""
    import pyarrow.parquet as pq

    least, most = 0.8, 13
    blank = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    number = {}
    words = lambda t: np.array([number.setdefault(w, len(number)) for w in (t or "").lower().translate(blank).split(" ") if w], np.int64)
    items = {r["item_id"]: words(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    want = []
    for i, text in docs[0].items():
        w = words(text)
        for j, v in items.items():
            if not len(v) or not len(w):
                continue
            at, k = np.nonzero(w[:, None] == v[None, :])
            hits = np.bincount(at - k + len(v), minlength=1)
            found, short = [], min(most, len(v))
            for d in (np.flatnonzero(hits >= least * short - 1e-9) - len(v)).tolist():
                own = [0 <= d + x < len(w) and w[d + x] == v[x] for x in range(len(v))]
                runs = [(b - a, -a) for a in range(len(v)) for b in range(a + short, len(v) + 1) if sum(own[a:b]) >= least * (b - a) - 1e-6]
                if runs:
                    n, a = max(runs)
                    found.append((sum(own[-a : -a + n]), n, -d, -a))
            if found:
                m, n, d, a = max(found)
                want.append((i, j, -d, m, len(v), a, n))
    got = [tuple(r[c] for c in ("doc_id", "item_id", "place", "n_match", "n_words", "start", "length")) for r in run(spark, "op8_decontaminate")]
    assert sorted(got) == sorted(want) and len(want) >= 3
