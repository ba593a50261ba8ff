import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomlake.llm import packing, token_store
from loomlake.llm.common import new_path
from loomlake.llm.tok import default_path, encoder

ODD = ["", "He's here,we're ok... 'tis", "a.b.c!?;:", "<|endoftext|> x<|startoftext|>.", "É́.,x", "İSTANBUL.", "x.'s, don't.'re", "1.5,6 7;8", " a b.", "日本語。ok.", "👍🏽.b", "a" * 3000 + ".", "A.́b", "ß.ẞ", "\x00a.b", "ends,", ".starts", "ÀÉÎ.õ,ÿª", "Ärger\tÜber\nŁódź\r\nŽ", "ȺȾ\u0130x", "a\u00a0b\u2003c", "ŉ ǅ ß ſ", "Σας ΑΣ"]
SCHEMA = "doc_id long, text string, length string"


def plain(texts):
    t = Tokenizer.from_file(default_path())
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def texts():
    r = random.Random(5)
    words = "the of Énd und. ciónarmente, x's 12.5 (a) a.b; [c]! ñ \n\n".split(" ")
    return ODD + [" ".join(r.choices(words, k=r.choice([1, 5, 100, 3000, 9000]))) for _ in range(60)]


def test_encoder_gives_the_librarys_ids():
    tx = texts()
    ids, at = encoder(default_path()).encode(pa.array(tx))
    for i, ref in enumerate(plain(tx)):
        assert ids[at[i] : at[i + 1]].tolist() == ref, tx[i][:50]
    assert len(encoder(default_path()).encode(pa.array([None, ""]))[0]) == 0
    assert len(encoder(default_path()).encode(pa.array([], pa.string()))[1]) == 1


def test_packing_places_every_id_once(spark):
    tx = [*texts(), None]
    got = packing.pack_documents(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(tx)], SCHEMA)).collect()
    ids = [x + [2] for x in plain([t or "" for t in tx])]
    for i, ref in enumerate(ids):
        mine = sorted((r["start"], r) for r in got if r["doc_id"] == i)
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for _, r in mine]).tolist() == ref
        assert {r["doc_tokens"] for _, r in mine} == {len(ref)}
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= 1.03 * sum(map(len, ids)) / 4096 + 1


def test_best_fit_decreasing_matches_a_linear_scan():
    r = random.Random(3)
    for _ in range(30):
        lengths = np.array([r.randint(1, 64) for _ in range(r.randint(0, 200))], np.int64)
        windows = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [w for w in windows if w[0] >= n]
            if fit:
                min(fit, key=lambda w: w[0])[0] -= n
            else:
                windows.append([64 - n])
        got, offset = packing.best_fit_decreasing(lengths, 64)
        rooms = sorted(64 - sum(lengths[got == w].tolist()) for w in set(got.tolist()))
        assert rooms == sorted(w[0] for w in windows)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store_round_trip(spark):
    tx = [*texts(), None, *texts()[20:40]]
    df = spark.createDataFrame([(i * 3, t, "clash") for i, t in enumerate(tx)], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in token_store.store_and_read(df).collect()}
    start = 0
    for i, ref in enumerate(plain([t or "" for t in tx])):
        ref = [*ref, 1]
        r = got[i * 3]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ref and r["start"] == start and r["n_tokens"] == len(ref)
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(ref, "<u4").tobytes())
        start += len(ref)


def test_store_holds_a_chunk_once_and_finds_damage(spark):
    text = " ".join(texts()[-30:])
    path = new_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([(i, text, "") for i in range(6)], SCHEMA).repartition(3), path)
    pool = spark.read.parquet(f"{path}/pool")
    assert pool.filter("kind = 'chunk'").count() == pool.select("address").distinct().count()
    assert pool.filter("kind = 'use'").count() == 6 * pool.filter("kind = 'chunk'").count()
    bad = new_path(spark, "bad-store")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    pool.selectExpr("address", "row", "doc_id", "at", "n", "shared", "case when kind = 'chunk' then concat(substring(ids, 1, length(ids) - 1), X'77') end as ids", "kind").write.partitionBy("kind").parquet(f"{bad}/pool")
    with pytest.raises(Exception, match="CorruptStore"):
        token_store.read_store(spark, bad).collect()
    with pytest.raises(token_store.CorruptStore):
        spark.read.parquet(f"{path}/recipes").filter("doc_id > 0").write.mode("overwrite").parquet(f"{bad}/recipes")
        token_store.read_store(spark, bad).collect()


def test_store_finds_changed_recipes_and_swapped_documents(spark):
    tx = [t for t in texts() if t][-12:]
    path = new_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([(i, t, "") for i, t in enumerate(tx)], SCHEMA), path)
    recipes, pool = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/pool")

    def fails(changed, uses=pool):
        bad = new_path(spark, "bad-store")
        changed.write.parquet(f"{bad}/recipes")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{bad}/manifest")
        uses.write.partitionBy("kind").parquet(f"{bad}/pool")
        with pytest.raises(Exception, match="CorruptStore|don.t match"):
            token_store.read_store(spark, bad).collect()

    assert token_store.read_store(spark, path).count() == len(tx)
    fails(recipes.selectExpr("part", "doc_id + 100 as doc_id", "row", "copies", "start", "n_tokens", "chunks", "root"))
    fails(recipes.selectExpr("part", "doc_id", "row", "copies", "start + 7 as start", "n_tokens", "chunks", "root"))
    fails(recipes.selectExpr("part", "doc_id", "row", "copies + 1 as copies", "start", "n_tokens", "chunks", "root"))
    # two documents of as many tokens under each other's id, everywhere but in the roots
    rows = recipes.collect()
    a, b = next((x, y) for x in rows for y in rows if x["n_tokens"] == y["n_tokens"] and x["doc_id"] < y["doc_id"]) if len({r["n_tokens"] for r in rows}) < len(rows) else (rows[0], rows[1])
    swap = {bytes(a["row"]): b, bytes(b["row"]): a}
    changed = [(*r[:5], swap[bytes(r["row"])]["n_tokens"], swap[bytes(r["row"])]["chunks"], r["root"]) if bytes(r["row"]) in swap else tuple(r) for r in rows]
    used = [(*r[:1], swap[bytes(r["row"])]["row"], *r[2:]) if bytes(r["row"]) in swap else tuple(r) for r in pool.collect()]
    fails(spark.createDataFrame(changed, recipes.schema), spark.createDataFrame(used, pool.schema))


def test_store_collects_copies_once(spark):
    """Rows equal in id and text: each chunk of their recipe comes to the reader once."""
    text = " ".join(texts()[-30:])
    path = new_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([(5, text, "")] * 40, SCHEMA).repartition(4), path)
    recipe = spark.read.parquet(f"{path}/recipes").collect()
    assert len(recipe) == 1 and recipe[0]["copies"] == 40 and len(recipe[0]["chunks"]) == len(set(map(bytes, recipe[0]["chunks"])))
    got = token_store.read_store(spark, path).collect()
    assert len(got) == 40 and sorted(r["start"] for r in got) == [k * recipe[0]["n_tokens"] for k in range(40)]


def test_packing_keeps_large_and_null_ids(spark):
    rows = [((1 << 53) + 1, "a b", ""), ((1 << 53) + 3, "c d e", ""), (None, "f", ""), (None, "f", "")] + [(None, f"w{i}", "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(df).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (r[0] for r in rows)))
    pieces = packing.token_pieces(df)
    shards = [r["sequence_id"] >> 32 for r in packing.pack(pieces, 8).collect() if r["doc_id"] is None]
    assert len(set(shards)) == 8  # rows without ids are dealt out too


def test_store_with_repeated_and_null_ids(spark):
    tx = texts()
    long = " ".join(tx[-30:])
    rows = [(1, tx[3]), (1, tx[4]), (None, tx[5]), (None, tx[5]), (1, tx[3]), (0, long), (None, None), (0, long), (2, long), (-4, ""), (None, long)]
    df = spark.createDataFrame([(*x, "") for x in rows], SCHEMA).repartition(3)
    got = token_store.store_and_read(df).orderBy("start").collect()
    want = [(i, [*x, 1]) for (i, _), x in zip(rows, plain([t or "" for _, t in rows]), strict=True)]
    assert sorted(map(str, ((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got))) == sorted(map(str, want))
    assert [r["doc_id"] for r in got] == [-4, 0, 0, 1, 1, 1, 2, None, None, None, None]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_other_tokenizer_files_get_whole_texts(spark, tmp_path):
    """A file that joins words is not encoded word by word."""
    import json

    from loomlake.llm.tok import default_path

    with open(default_path(), encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(said, f)
    from tokenizers import Tokenizer

    tx = ["One two, three.", "", "a b"]
    got = token_store.store_and_read(spark.createDataFrame([(i, t, "") for i, t in enumerate(tx)], SCHEMA), tokenizer=path).orderBy("doc_id").collect()
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(tx, add_special_tokens=False)]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want


def test_store_of_nothing(spark):
    assert token_store.store_and_read(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuts_depend_on_content_only():
    r = np.random.default_rng(1)
    a = r.integers(0, 49000, 30000).astype("<u2")
    b = np.concatenate([r.integers(0, 49000, 777).astype("<u2"), a])
    cut = lambda x: {x[s:e].tobytes() for s, e in zip([0, *token_store.cut_points(x)[:-1]], token_store.cut_points(x))}
    assert len(cut(a) & cut(b)) > 0.9 * len(cut(a))
    sizes = np.diff([0, *token_store.cut_points(a)])
    assert sizes.max() <= token_store.MAX and sizes.sum() == len(a)
