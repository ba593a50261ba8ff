import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from loomlake.llm import queries as Q
from loomlake.llm import token_counts as C

ODD = ["", None, " ", "   ", "\n", "\n \nx", "a  b", "</s> x <s>", "▁a▁▁b", "日本語 テスト。ok", "a\x00b", "\r\r\n);\r\nx", "👍🏽.b", "a" * 3000, "日本語" * 500, "é" * 700 + "x", "x y　z", "▁", "<0x0A>", "a\tb\t\tc", "  lead and trail  ", "�", "ññ"]
SIGNS = ["a", "b", " ", "  ", "\n", "\r", "\t", ".", ",", "(", "é", "日", "▁", "0", "12", ");", "the ", "​", "👍"]


def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choices(SIGNS, k=r.randint(0, 60))) for _ in range(800)]


@pytest.fixture(scope="module")
def own():
    return C.PieceCounter(C.default_path())


def lengths(own, words):
    words = words.filter(pc.less_equal(pc.binary_length(words), C.CACHED_BYTES))
    return C.LengthTable(words, np.array(own.words(words.to_pylist()), np.int64))


def test_counts_are_the_librarys(own):
    tx = texts()
    want = [len(own.model.encode(t or "")) for t in tx]
    words = pc.unique(own.parts(pa.array(tx))[0])
    assert own.by_parts
    for table in (None, lengths(own, words), lengths(own, words[::2]), lengths(own, words[:0])):
        assert own.count(pa.array(tx), table).tolist() == want
    assert own.count(pa.array([], pa.string())).tolist() == [] and own.count(pa.array([None, ""])).tolist() == [0, 0]


def test_parts_put_together_are_the_texts(own):
    tx = [t for t in texts() if t and "▁" not in t]
    words, first = own.parts(pa.array(tx))
    words = words.to_pylist()
    assert ["".join(words[a:b]) for a, b in zip(first, first[1:], strict=False)] == [" " + t for t in tx]


def test_table_compares_bytes(own, monkeypatch):
    """Where all hashes are equal, the bytes decide alone."""
    monkeypatch.setattr(C, "hashes", lambda data, off: np.full(len(off) - 1, 7, np.uint64))
    r = random.Random(2)
    words = sorted({"".join(r.choices("abé", k=r.randint(1, 6))) for _ in range(60)})
    table = C.LengthTable(pa.array(words[::2]), np.arange(len(words[::2])))
    data, off = C.text_buffer(pa.array(words))
    assert table.find(data, off).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(words))]


def test_caches_are_bounded_and_change_nothing(own, monkeypatch):
    monkeypatch.setattr(C, "CACHED", 10)
    fresh = C.PieceCounter(C.default_path())
    tx = texts()
    for i in range(0, len(tx), 50):
        part = pa.array(tx[i : i + 50])
        assert fresh.count(part).tolist() == own.count(part).tolist()
    assert not any(len(w) > C.CACHED_BYTES for w in fresh.known)


def test_other_models_get_whole_texts(own, monkeypatch):
    fresh = C.PieceCounter(C.default_path())
    fresh.by_parts = False
    tx = texts()
    assert fresh.count(pa.array(tx)).tolist() == own.count(pa.array(tx)).tolist()


def test_rows(spark):
    rows = [(i, t, "clash", 2) for i, t in enumerate(texts()[:120])] + [(None, "a b", "x", 1), (3, "a", "x", 1), (3, "a", "x", 1)]
    got = C.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int"), limit=50).collect()
    model = C.counter(C.default_path()).model
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 50) for i, t, _, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_equals_the_library(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    model = C.counter(C.default_path()).model
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in table]
    assert sorted(map(tuple, Q.op12_token_counts(spark, sf).collect())) == sorted(want)
