import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomlake.llm import clustered_index as X
from loomlake.llm import queries as Q
from loomlake.llm.common import new_path


def plain_search(docs, items, k=20):
    """Every document scored for every item: [(item, rank, doc_id, score)]."""
    counted = [(i, Counter(X.terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, body in items:
        asked, scores = X.terms_of(body), []
        for (doc, c), size in zip(counted, sizes, strict=True):
            m = 100 - 25 + (25 * size * n) // max(words, 1)
            score = sum(X.weight(n, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(r, n):
    topics = [[f"{c}{i}é" for i in range(40)] for c in "abcd"]
    common = [f"w{i}" for i in range(30)]
    return [" ".join(r.choices(r.choice(topics) + common, k=r.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


@pytest.fixture(params=[(256, 4096), (4, 50)])
def sizes(request, monkeypatch):
    if request.param[0] == 4:
        monkeypatch.setattr(X, "TASK_BYTES", 20_000)
        monkeypatch.setattr(X, "BLOCK_WORDS", 60)
    return request.param


def test_search_equals_brute_force(spark, sizes):
    r = random.Random(1)
    texts = [*corpus(r, 150), None, "", "...", "W1 w1-W1_w1 Éa0é", "w1\x00w2\x7fw3"] + ["a1é b1é w1 w1"] * 90  # equal scores
    docs = [(i, t, i, "clash") for i, t in enumerate(texts)] + [(None, "a1é b1é w1 w1", 0, "x"), (7, "w3 w4", 0, "x"), (7, "w3 w4", 0, "x")]
    items = [(i, t) for i, t in enumerate(corpus(r, 12))] + [(50, None), (51, "nowhere at all"), (52, "w1 w1 w1 a1é"), (52, "w2"), (53, "?"), (None, "c3é w5")]
    got = X.ranked_search(spark.createDataFrame(docs, "doc_id long, text string, size long, terms string"), spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string"), 20, *sizes)
    want = plain_search([d[:2] for d in docs], items)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert X.ranked_search(none, items).collect() == []
    assert X.ranked_search(some.filter("doc_id = 2"), items).collect() == []
    assert X.ranked_search(some, items.filter("false")).collect() == []
    assert [tuple(r)[:3] for r in X.ranked_search(some, items).collect()] == [("x", 1, 1)]


def test_every_row_is_in_the_index_once(spark, sizes):
    r = random.Random(2)
    docs = list(enumerate([*corpus(r, 120), None, ""]))
    path = new_path(spark, "test")
    X.build_index(spark.createDataFrame(docs, "doc_id long, text string"), path, *sizes)
    rows = spark.read.parquet(path).collect()
    assert sorted(i for c in rows for i in c["doc_ids"]) == [i for i, _ in docs]
    assert len({c["cluster"] for c in rows}) == len(rows) and max(len(c["doc_ids"]) for c in rows) <= sizes[0]
    held = Counter()
    for c in rows:
        df, tf, place = np.frombuffer(c["df"], "<u2"), np.frombuffer(c["tfs"], "<u4"), np.frombuffer(c["places"], np.uint8)
        at = 0
        for t, n in zip(c["terms"].split(), df.tolist(), strict=True):
            for j in range(at, at + n):
                held[c["doc_ids"][place[j]], t] += int(tf[j])
            at += n
        assert at == len(tf)
    assert held == Counter((i, t) for i, text in docs for t in X.terms_of(text))


def test_far_clusters_are_left_out(spark, monkeypatch):
    """Topics that share no terms: a query's first clusters hold its best documents, the others are not scored."""
    seen = []
    visit = X._visit
    monkeypatch.setattr(X, "_visit", lambda q, batch, row, own, asked, visited, *a: (seen.extend((batch.column("cluster")[row].as_py(), i) for i in visited), visit(q, batch, row, own, asked, visited, *a)))
    r = random.Random(3)
    texts = [" ".join([f"t{i % 16}x{r.randrange(12)}" for _ in range(30)] + ["all"]) for i in range(512)]
    held = X.counts_of(pa.array(texts))
    tables = pa.record_batch({"doc_id": pa.array(range(512)), "size": held.size, "terms": [" ".join(sorted(set(t.split()))) for t in texts], "tf": [np.array([t.split().count(w) for w in sorted(set(t.split()))], "<u4").tobytes() for t in texts]})
    index = X._shard([tables], 0, 16)
    q = X.Queries.of([(0, "t3x1 t3x2 all")])
    q.n, q.words, q.least = 512, int(held.size.sum()), np.zeros(1, np.int64)
    q.weights = np.array([X.weight(512, sum(t in set(x.split()) for x in texts)) for t in q.terms.to_pylist()])
    best = {}
    matched = q.matched(index)
    bounds = [q.bounds(index, row, *m) for row, m in enumerate(matched)]
    for row in sorted(range(len(bounds)), key=lambda i: -bounds[i][0]):
        if bounds[row][0] >= max(q.least[0], 1):
            X._visit(q, index, row, *matched[row], [0], best, q.least, 20)
    assert [(-s, d) for s, _, d in best[0]] == [(s, d) for _, _, d, s in plain_search(list(enumerate(texts)), [(0, "t3x1 t3x2 all")])]
    assert len(seen) < index.num_rows / 4


def test_bisection_puts_like_documents_together():
    r = random.Random(4)
    kinds = [i % 4 for i in range(256)]
    r.shuffle(kinds)
    docs = [sorted({k * 50 + r.randrange(50) for _ in range(20)}) for k in kinds]
    order, seen = X.bisect(np.concatenate([np.array(d) for d in docs]), np.cumsum([0, *map(len, docs)]), 64)
    assert sorted(order.tolist()) == list(range(256)) and len(seen) == 2
    for a in range(0, 256, 64):
        assert max(Counter(kinds[i] for i in order[a : a + 64]).values()) >= 60
    assert X.bisect(np.zeros(0, np.int64), np.zeros(6, np.int64), 2)[0].tolist() == [0, 1, 2, 3, 4]


def test_the_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], r["text"]) for r in pq.read_table(f"{sf}/{name}.parquet", columns=[key, "text"]).to_pylist()]
    assert sorted(map(tuple, Q.op13_ranked_search(spark, sf).collect())) == sorted(plain_search(read("documents", "doc_id"), read("benchmark", "item_id")))
