"""Language ID, line dedup, near-dedup, decontamination and the pipeline against plain versions."""

import collections
import itertools
import random

import numpy as np
import pytest

from loomlake.llm import decontaminate, language_id, line_dedup, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, langs=None, more=""):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in more.split():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(r, vocabulary, n):
    return " ".join(r.choices(vocabulary, k=n))


def vocabulary(seed, syllables, n=400):
    r = random.Random(seed)
    return ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]


EN = vocabulary(1, ["the", "ing", "ed", "er", "th", "on", "an"])
FR = vocabulary(2, ["é", "que", "eau", "ion", "oi", "les", "un"])


# ---- language


def plain_profile(text, n=(1, 2, 3)):
    count = collections.Counter()
    word = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in word:
        count.update(w)
    joined = " " + " ".join(word) + " "
    for a, b in itertools.pairwise(joined):
        count[a + b] += 1
    for g in zip(joined, joined[1:], joined[2:]):
        if g[1] != " ":
            count["".join(g)] += 1
    return count if word else collections.Counter()


def test_ngrams_match_counting():
    import pyarrow as pa

    texts = ["", "a", "Ab, c!", "É é 日本", "12", " x ", None, "l'eau d'or"]
    own, key, n = language_id.ngrams(pa.array(texts))

    def name(k):
        letters = [int(k) >> 21 * i & 0x1FFFFF for i in (2, 1, 0)]
        letters = letters[: letters[2]] if int(k) >> 63 else letters
        return "".join(chr(x) if x else " " for x in letters)

    for i, t in enumerate(texts):
        assert {name(k): c for o, k, c in zip(own, key, n, strict=True) if o == i} == dict(plain_profile(t or "")), t


def test_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    import random

    r = random.Random(3)
    long = "".join(r.choice(["der ", "Straße", "\n", "1x2", "é, ", "日本", "。", " a", "b.", "''"]) for _ in range(4000))
    whole = language_id.slice_ngrams(pa.array([long]))
    for size in (1, 50, 3000, 10**6):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(language_id.ngrams(pa.array([long])), whole, strict=True))


def test_language_is_found(spark):
    r = random.Random(3)
    texts = [prose(r, EN if i % 2 else FR, r.choice([3, 10, 200])) for i in range(200)] + [None, "", "12 34 --", "日本語"]
    langs = ["en" if i % 2 else "fr" for i in range(200)] + [None, None, None, None]
    df = frame(spark, texts, langs, "score lang_pred")
    got = {x["doc_id"]: x for x in language_id.identify(df, language_id.learn(df.filter("doc_id < 100"))).collect()}
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in range(100, 200)]) > 0.97
    for i in (200, 201, 202):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[203]["score"] < 0.1 and all(0 <= x["score"] <= 1 for x in got.values())
    empty = df.filter("doc_id < 0")
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert {x["lang_pred"] for x in language_id.identify(df, language_id.learn(empty)).collect()} == {"und"}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_pipeline_drops_what_is_no_language(spark):
    import base64

    import corpus_pipeline

    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text rlike '\\\\p{L}'")
    junk = [base64.b64encode(r.randbytes(3000)).decode(), r.randbytes(3000).hex(), " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(400))]
    more = frame(spark, junk).selectExpr("-1 - doc_id doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    both = docs.select(*more.columns).unionByName(more)
    kept = {x["doc_id"] for x in corpus_pipeline.language(spark, both, "").select("doc_id").collect()}
    assert kept == {x["doc_id"] for x in docs.select("doc_id").collect()}
    unlabelled = frame(spark, ["some words", "12 34", None]).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    assert [x["doc_id"] for x in corpus_pipeline.language(spark, unlabelled, "").collect()] == [0]


# ---- lines


def plain_templates(lines, agree=0.8):
    """(members, template) of lines in order: each line in turn joins the template that the first line left started,
    if enough of its places agree, and those that don't become variable (None)."""
    left, out = list(lines), []
    while left:
        template, members, rest = list(left[0]), [left[0]], []
        for x in left[1:]:
            same = [a is not None and a == b for a, b in zip(template, x, strict=True)]
            if np.sum(same) / len(x) >= agree:
                template = [a if ok else None for a, ok in zip(template, same, strict=True)]
                members.append(x)
            else:
                rest.append(x)
        out.append((members, tuple(template)))
        left = rest
    return out


def plain_groups(lines, agree=0.8):
    """The lines of a leaf, merged in parts and then as a whole."""
    key = lambda x: line_dedup._hash(list(x))
    parts = collections.defaultdict(list)
    for x in sorted(lines, key=key):
        parts[key(x) % line_dedup.PARTS].append(x)
    first = sorted((key(m[0]), k, m, t) for k, own in parts.items() for m, t in plain_templates(own, agree))
    seconds, of = plain_templates([t for *_, t in first], agree), {}
    for _, _, m, t in first:
        of.setdefault(t, []).append(m)
    out = []
    for members, _ in seconds:
        out.append([x for t in members for x in of[t].pop(0)])
    return out


def plain_lines(texts, depth=4, agree=0.8, least=10, kept=0.0):
    where = collections.defaultdict(dict)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if tokens := line_dedup.line_tokens(line):
                where[len(tokens), tuple(tokens[:depth])].setdefault(tuple(tokens), []).append((i, k))
    gone = collections.defaultdict(set)
    for lines in where.values():
        if len({texts[i] for uses in lines.values() for i, _ in uses}) < least:
            continue
        for group in plain_groups(lines, agree):
            uses = [u for x in group for u in lines[x]]
            if len({texts[i] for i, _ in uses}) >= least:
                first = min(i for i, _ in uses)
                for i, k in uses:
                    if i != first:
                        gone[i].add(k)
    out = []
    for i, t in enumerate(texts):
        parts = t.split("\n") if t else []
        left = "\n".join(p for k, p in enumerate(parts) if k not in gone[i])
        out.append((i, len(parts), len(gone[i]), left if gone[i] else t, not gone[i] or (len(left.split()) >= kept * len(t.split()) and bool(left.strip()))))
    return out


def test_recurring_lines_go(spark):
    r = random.Random(5)
    texts = []
    for i in range(60):
        lines = [prose(r, EN, r.randint(1, 12)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), f"page {i} of {i * 7} visited at 12:0{i % 10}")
        if i % 4 == 0:
            lines.append("all rights reserved by " + r.choice(["us", "them", "you", "no"]) + " and the heirs of the house")
        if i % 5 == 0:
            lines.append("x1 y2 z3")
        texts.append("\n".join(lines))
    texts += [texts[1]] * 15 + ["page 5 of 6 visited at 7", "", None, " \n\n ", "all rights reserved by us and the heirs of the house\nok"]
    got = line_dedup.line_dedup(frame(spark, texts, more="kept n_lines _gone _cut_doc").repartition(3)).collect()
    assert sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"], x["kept"]) for x in got) == plain_lines(texts)
    assert sum(x["n_dropped"] for x in got) > 30 and not all(x["kept"] for x in got)
    got = line_dedup.line_dedup(frame(spark, texts), min_kept=0.2).collect()
    assert sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"], x["kept"]) for x in got) == plain_lines(texts, kept=0.2)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_lines_of_rows_without_ids_or_under_one_id(spark):
    line = "read more on our site today"
    rows = [(5, "mine a\nkeep me one"), (5, "other\nkeep me second"), (None, f"{line}\nx"), (None, f"y\n{line}")]
    rows += [(i, f"{line}\nz{'abcdefghij'[i]}") for i in range(8)] + [(5, f"mine b\n{line}"), (0, f"{line}\nza"), (None, None)]
    got = sorted((str(x["doc_id"]), str(x["text"])) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # the least row has it first; the two equal rows of id 0 both keep it
    assert got == sorted((str(i), str(t if i == 0 or t is None else "\n".join(x for x in t.split("\n") if x != line))) for i, t in rows)


def test_templates_merge_line_by_line(monkeypatch):
    """With bands as without, and as told by the plain version: of lines like a few patterns, of unlike ones, and of
    one template with any name in it; a merged field doesn't count as agreeing."""
    r = np.random.default_rng(2)

    def parts(tokens, agree, leaf):
        monkeypatch.setattr(line_dedup, "LEAF", leaf)
        group, found = line_dedup.templates(tokens, agree)
        return sorted((np.flatnonzero(group == g).tolist(), found[g].tolist()) for g in set(group.tolist()))

    for width in (5, 6, 9, 10, 23):
        like = r.integers(1, 9, (6, width))[r.integers(0, 6, 400)]
        like = np.where(r.random(like.shape) < 0.15, r.integers(0, 50, like.shape), like)
        tokens = np.unique(np.concatenate([like, r.integers(1, 4, (200, width))]), axis=0).astype("<u4")
        tokens[:, :4] = 7
        for agree in (0.6, 0.8, 1.0):
            got = parts(tokens, agree, 1 << 20)
            assert parts(tokens, agree, 4) == got
            whole = tokens[(tokens != line_dedup.MERGED).all(axis=1)]
            plain = [(len(m), [line_dedup.MERGED if x is None else x for x in t]) for m, t in plain_templates([tuple(x) for x in whole.tolist()], agree)]
            assert sorted((len(m), t) for m, t in parts(whole, agree, 1 << 20)) == sorted(plain)
    names = np.full((5000, 11), 3, "<u4")
    names[:, 4] = np.arange(5000)
    (members, template), = parts(names[1:], 0.8, 4096)
    assert members == list(range(4999)) and template == [3, 3, 3, 3, 0, 3, 3, 3, 3, 3, 3]


def test_parts_of_a_leaf_meet(spark, monkeypatch):
    """Lines that differ in one word are one template, however many parts they were dealt to."""
    texts = [f"all rights reserved by {''.join(chr(97 + int(d)) for d in str(i))} and the heirs of the house\nown {chr(97 + i % 26)}" for i in range(60)]
    for n in (1, 3, 256):
        monkeypatch.setattr(line_dedup, "PARTS", n)
        got = line_dedup.line_dedup(frame(spark, texts)).collect()
        assert sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"], x["kept"]) for x in got) == plain_lines(texts)
        assert sum(x["n_dropped"] for x in got) >= 59


def test_long_lines_go_from_the_second_text_on(spark):
    """Twenty words in two texts go from the second one; nineteen stay, as do those that only copies of one text have."""
    r = random.Random(6)
    long, short, alone = prose(r, EN, 20), prose(r, EN, 19), prose(r, EN, 60)
    almost = " ".join([*long.split()[:-1], "else"])
    own = [prose(r, FR, 30) for _ in range(7)]
    texts = [f"{long}\n{own[0]}", f"{own[1]}\n{long}", f"{own[2]}\n{almost}", f"{short}\n{own[3]}", f"{own[4]}\n{short}", f"{own[5]}\n{alone}", own[6], own[6], alone]
    df = frame(spark, texts)
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(df).collect()}
    assert [got[i]["n_dropped"] for i in range(9)] == [0, 1, 1, 0, 0, 0, 0, 0, 1]
    assert (got[1]["text"], got[2]["text"], got[8]["text"], got[8]["kept"]) == (own[1], own[2], "", False)
    spared = {x["doc_id"]: x for x in line_dedup.line_dedup(df, spare=True).collect()}
    assert (spared[8]["text"], spared[8]["n_dropped"], spared[8]["kept"], spared[1]["text"]) == (alone, 0, True, own[1])


# ---- near-duplicates


def plain_classes(texts, least=0.8):
    blank = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    sets = []
    for t in texts:
        w = (t or "").lower().translate(blank).split(" ")
        w = [x for x in w if x]
        sets.append((tuple(w), collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()))
    df = collections.Counter(s for _, c in sets for s in c)
    n = len(texts)
    level = lambda d: min(255, round(near_dedup.STEPS * np.log2(d)))
    idf = {s: 1 + 0.5 * min(1, max(0, np.log((n + 1) / (2 ** (level(d) / near_dedup.STEPS) + 1)) / np.log(n + 1))) for s, d in df.items()}
    w = [{s: k * idf[s] for s, k in c.items()} for _, c in sets]
    parent = list(range(n))
    links = collections.defaultdict(set)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        same = sets[a][0] == sets[b][0]
        if not same and w[a] and w[b]:
            m = sum(min(x, w[b].get(s, 0)) for s, x in w[a].items())
            same = m / (sum(w[a].values()) + sum(w[b].values()) - m) >= least
            if same:  # another text
                links[sets[a][0]].add(sets[b][0])
                links[sets[b][0]].add(sets[a][0])
        if same:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)], [len(links[s]) for s, _ in sets]


def near_texts():
    r = random.Random(9)
    texts = [prose(r, EN, r.choice([1, 4, 5, 40, 300])) for _ in range(40)]
    for i in range(40):
        words = texts[i].split()
        for share in (0, 0.01, 0.03, 0.1):
            copy = [r.choice(FR) if r.random() < share else x for x in words]
            texts.append(r.choice([" ", "  ", ", "]).join(copy).upper() if share == 0 else " ".join(copy))
    return texts + ["", None, " .", "one", "One!"] + [texts[3]] * 30


@pytest.mark.parametrize("members", [4096, 3])
def test_near_classes_match_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 10_000)
    texts = near_texts()
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(frame(spark, texts, more="cluster block").repartition(3)).collect()}
    classes, links = plain_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == classes
    assert [got[i]["n_links"] for i in range(len(texts))] == links


def test_near_of_nothing(spark):
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    assert near_dedup.deduplicated(frame(spark, [])).count() == 0


def test_near_rows_without_ids_or_under_one_id(spark):
    r = random.Random(21)
    a, b, c = (prose(r, x, 80) for x in (EN, FR, EN))
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c + " more"), (None, None), (7, c), (None, prose(r, FR, 50)), (9, a), (9, a)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _block int").repartition(3)
    got = near_dedup.near_dedup(df)
    assert got.columns == ["doc_id", "class_id", "n_links", "kept"]
    found = sorted((str(x["doc_id"]), str(x["class_id"]), x["kept"]) for x in got.collect())
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 7, False), (None, 7, False), (None, None, True), (7, 7, True), (None, None, True), (9, 1, False), (9, 1, False)]
    assert found == sorted((str(i), str(k), x) for i, k, x in want)
    out = near_dedup.deduplicated(df)
    assert out.schema == df.schema
    assert sorted(x["_block"] for x in out.collect()) == [0, 1, 6, 7, 8]


def test_near_pairs_of_the_queries_are_found(spark):
    """Recall over the smallest tables: every row whose id is divisible by 100 against all rows."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(path).select("doc_id", "text").collect()}
    ids = sorted(docs)
    classes = {x["doc_id"]: x["class_id"] for x in near_dedup.near_dedup(spark.read.parquet(path)).collect()}
    sets, blank = {}, str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    for i in ids:
        w = [x for x in (docs[i] or "").lower().translate(blank).split(" ") if x]
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    df, n = collections.Counter(s for c in sets.values() for s in c), len(ids)
    idf = {s: 1 + 0.5 * min(1, max(0, np.log((n + 1) / (d + 1)) / np.log(n + 1))) for s, d in df.items()}
    total = {i: sum(k * idf[s] for s, k in sets[i].items()) for i in ids}
    found = missed = 0
    for i in (x for x in ids if x % 100 == 0):
        for j in ids:
            if i != j and min(total[i], total[j]) >= 0.8 * max(total[i], total[j]) > 0:
                m = sum(min(k, sets[j].get(s, 0)) * idf[s] for s, k in sets[i].items())
                if m >= 0.805 * (total[i] + total[j] - m):  # frequencies are kept in steps: the border is left out
                    found += classes[i] == classes[j]
                    missed += classes[i] != classes[j]
    print("near pairs found, missed", found, missed)
    assert found >= 0.9 * (found + missed)


def test_samples_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(3)
    pool = r.integers(1, 1 << 63, 3000).astype(np.uint64)
    wa, wb = r.uniform(1, 3, 3000).astype(np.float32), r.uniform(1, 3, 3000).astype(np.float32)
    a, b = np.arange(0, 2400), np.arange(300, 2700)
    w = lambda i, x: dict(zip(i.tolist(), x[i].tolist(), strict=True))
    A, B = w(a, wa), w(b, wb)
    m = sum(min(v, B.get(k, 0)) for k, v in A.items())
    truth = m / (sum(A.values()) + sum(B.values()) - m)
    hits = []
    for _ in range(30):
        salt = r.integers(1, 1 << 63, 1).astype(np.uint64)
        s = near_dedup.icws(np.concatenate([pool[a], pool[b]]) ^ salt, np.concatenate([wa[a], wb[b]]), np.array([0, len(a), len(a) + len(b)]))
        hits += (s[0] == s[1]).tolist()
    assert abs(np.mean(hits) - truth) < 0.05


# ---- decontamination


def test_masks_leave_a_hit_for_every_fifth_word():
    for n in range(5, 23):
        fits = [sum(1 << p + k for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n // 5):
            bits = sum(1 << g for g in gone)
            assert any(not f & bits for f in fits)


def plain_overlaps(texts, items, least=0.8, run=13):
    """Every interval of every item at every placing."""
    blank = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    words = lambda t: [w for w in (t or "").lower().translate(blank).split(" ") if w]
    out = []
    for i, t in enumerate(texts):
        w = words(t)
        for j, item in enumerate(items):
            v = words(item)
            found = []
            for d in range(-len(v) + 1, len(w)):
                own = [0 <= d + k < len(w) and w[d + k] == x for k, x in enumerate(v)]
                if sum(own) < least * min(run, len(v)) - 1e-9:
                    continue
                runs = [(b - a, -a) for a in range(len(v)) for b in range(a + min(run, len(v)), len(v) + 1) if sum(own[a:b]) >= least * (b - a) - 1e-6]
                if runs:
                    n, a = max(runs)
                    found.append((sum(own[-a : -a + n]), n, -d, -a))
            if found:
                m, n, d, a = max(found)
                out.append((i, j, -d, m, len(v), a, n))
    return out


def test_overlaps_match_brute_force(spark, monkeypatch):
    r = random.Random(11)
    items = [prose(r, EN, n) for n in (1, 2, 3, 4, 5, 9, 15, 20, 40)] + ["", None]
    texts = [prose(r, FR, r.randint(0, 60)) for _ in range(20)] + [None, ""]
    for item in items[:9]:
        for share in (0, 0.1, 0.19, 0.3):
            v = [r.choice(FR) if r.random() < share else x for x in item.split()]
            texts.append(prose(r, FR, r.randint(0, 30)) + "\n" + ", ".join(v).upper() + ". " + prose(r, FR, r.randint(0, 30)))
        texts.append(" ".join(item.split()[len(item.split()) // 8 :]))
    v = items[8].split()
    texts += [" ".join(v[:14]), " ".join(v[20:32]), " ".join([*v[:19], "put", "in", *v[19:]]), " ".join([*v[:15], *v[16:]]), " ".join(v[:13]) + " " + " ".join(v[25:])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, texts, more="place item_id").repartition(3)
    assert len(decontaminate.longest_run(np.array([True] * 3 + [False] + [True] * 8), 0.8)) == 2
    want = plain_overlaps(texts, items)
    assert sorted(map(tuple, decontaminate.overlaps(df, bench).collect())) == want
    clean = decontaminate.decontaminated(df, bench)
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(set(range(len(texts))) - {w[0] for w in want}) and clean.columns == df.columns
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)  # many blocks
    assert sorted(map(tuple, decontaminate.overlaps(df, bench).collect())) == want
    assert sorted(x["doc_id"] for x in decontaminate.decontaminated(df, bench).collect()) == sorted(x["doc_id"] for x in clean.collect())
    assert decontaminate.overlaps(df.filter("doc_id < 0"), bench).count() == 0
    assert decontaminate.overlaps(df, bench.filter("item_id < 0")).count() == 0
    same = spark.createDataFrame([(None, items[6]), (-1, items[6]), (None, None)], "item_id long, text string")
    twice = spark.createDataFrame([(None, items[6]), (1, items[6]), (1, items[6])], "doc_id long, text string")
    assert sorted(map(str, (x[:2] for x in decontaminate.overlaps(twice, same).collect()))) == sorted(map(str, [(d, i) for d in (None, 1, 1) for i in (None, -1)]))


# ---- the pipeline


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(13)
    texts = [prose(r, EN if i % 2 else FR, 60) for i in range(40)] + ["1 2 3", None, ""]
    texts += [texts[2] + " tail", texts[4]]
    for i in range(12):
        texts[i] += "\nread more on our site today 7"
    items = [prose(r, FR, 20)]
    texts.append(prose(r, EN, 30) + " " + items[0])
    frame(spark, texts, ["en" if i % 2 else "fr" for i in range(len(texts))]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({x["doc_id"]: x["text"] for x in docs.collect()})
    assert set(range(len(texts))) - set(kept[0]) == {40, 41, 42}
    assert set(kept[1]) == set(kept[0]) and sum("read more" in t for t in kept[1].values()) == 1
    assert set(kept[1]) - set(kept[2]) == {43, 44}
    assert set(kept[2]) - set(kept[3]) == {45}
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(kept[3])


def test_out_of_place_distance_matches_the_plain_one(spark):
    """Every text's distance to every profile, n-gram by n-gram; a long text among them."""
    import pyarrow as pa

    r = random.Random(17)
    texts = [prose(r, x, n) for x in (EN, FR) for n in (1, 3, 30, 200)] + ["1 2", "", None, "ab " * 40_000]
    langs = ["en"] * 4 + ["fr"] * 4 + [None] * 4
    learned = language_id.learn(frame(spark, texts, langs))
    profiles = {x: dict(zip(g["key"], g["rank"], strict=True)) for x, g in learned.groupby("lang")}
    got = language_id.Profiles(learned).predict(pa.array(texts, pa.string()))
    most = max(language_id.PROFILE, language_id.OWN)
    for i, t in enumerate(texts):
        _, key, count = language_id.ngrams(pa.array([t], pa.string()))
        own = [k for _, _, k in sorted((-c, n, k) for n, (k, c) in enumerate(zip(key.view(np.int64).tolist(), count.tolist(), strict=True)))][: language_id.OWN]
        if not own:
            assert (got[0][i], got[1][i]) == ("und", 0)
            continue
        cost = {x: sum(abs(p[k] - n) if k in p else most for n, k in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[0][i] == best and abs(got[1][i] - max(0, 1 - cost[best] / (len(own) * most))) < 1e-12
