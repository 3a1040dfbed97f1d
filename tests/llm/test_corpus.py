"""Operators over a corpus against brute force: top-k, passages, near-duplicates, lines, benchmark, pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tagmill.llm import common, decontaminate, exact_topk, line_dedup, order_minhash, prefixes, substring_dedup, wordtape

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def words_text(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- top-k


def brute_topk(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_topk_with_ties_and_bad_vectors(spark, block):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(230)]
    rows += [(i, [0.5, 0.5, -0.25, 0.0, 1.0, -1.0]) for i in range(230, 330)]  # one common vector
    rows += [(400, None), (401, [None, 1.0] * 3), (402, [math.nan] * 6), (450, [math.inf] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("rank", F.lit(0))
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in exact_topk.topk(df, vector_block=block, query_block=3).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(exact)


def test_topk_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert exact_topk.topk(spark.createDataFrame([], schema)).count() == 0
    assert exact_topk.topk(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], schema)
    assert [tuple(r) for r in exact_topk.topk(three).orderBy("rank").select("vec_id", "score").collect()] == [(1, 131072), (2, -196608)]


def test_topk_of_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    run = lambda rows: [tuple(r) for r in exact_topk.topk(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()]
    assert run([(0, [1.0]), (1, [9e6]), (2, [9.5e6])]) == [(0, 1, 2, 622592000000), (0, 2, 1, 589824000000)]
    # scores far below zero, the query's own row among the candidates' block
    low = [(0, [-1e6]), *[(i, [1e6 + i]) for i in range(1, 40)]]
    assert run(low) == [(0, i, i, -256000000 * 256 * (10**6 + i)) for i in range(1, 6)]
    # beyond 2**53, where doubles are no longer exact, and at the least of 64 bits
    big = [(0, [2.0**22, 2.0**-8]), (1, [2.0**24, 0.0]), (2, [2.0**24, 2.0**-8]), (3, [-(2.0**25), 0.0])]
    assert run(big) == [(0, 1, 2, 2**62 + 1), (0, 2, 1, 2**62), (0, 3, 3, -(2**63))]
    with pytest.raises(Exception, match="64 bits"):
        run([(0, [2.0**40]), (1, [2.0**40])])


def test_topk_of_repeated_ids_and_clashing_columns(spark):
    rows = [(50, [1.0, 2.0]), (50, None), (50, [None, 1.0]), (50, [3.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [9.0, 9.0]), (8, [5.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("qblock", "slot", "qgroup", "rank", "score", "query_id", "ids"):
        df = df.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in exact_topk.topk(df).orderBy("rank").collect()]
    assert got == [(50, 1, 8, 5 * 65536), (50, 2, 7, 3 * 65536), (50, 3, 7, 3 * 65536), (50, 4, 9, 0)]


# ---- passages


def brute_passages(rows, size):
    seen = Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        for p in range(len(w) - size + 1):
            seen[tuple(w[p : p + size])] += 1
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                gone.update(range(p, p + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [35, 8])
def test_passages(spark, size):
    rng = random.Random(size)
    shared, other = words_text(rng, 60), words_text(rng, 36)
    rows = [(i, words_text(rng, rng.randrange(120))) for i in range(40)]
    rows += [(100 + i, f"{words_text(rng, 20)} {shared} {words_text(rng, rng.randrange(30))}") for i in range(10)]
    rows += [(200, other), (201, f"{other} tail"), (202, "a " * 100), (203, words_text(rng, 9000, 3)), (204, None), (205, ""), (206, " \t\n"), (None, shared), (207, "x y " * 40), (208, "z" * 100_000)]
    rows += [(300, words_text(rng, 50))] * 3 + [(301, rows[0][1]), (300, words_text(rng, 50))]
    df = spark.createDataFrame(rows, DOC).repartition(4).withColumn("rk", F.lit(1)).withColumn("h", F.lit("x"))
    got = substring_dedup.substring_dedup(df, size).drop("kept_text").collect()
    assert Counter(tuple(r) for r in got) == brute_passages(rows, size)


def test_passages_of_an_empty_table(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOC)).count() == 0


def test_tape_splits_like_bytes():
    texts = ["a b", "", None, "é\x0bß  c\r\n", " lead", "x" * 10_000, "x" * 9_999 + "y"]
    for piece in (1, 5, 10**6):
        counts, seen = [], []
        for t, data in wordtape.tapes(wordtape.pa.array(texts), piece):
            counts += np.diff(t.first).tolist()
            seen += [bytes(data[a:b]) for a, b in zip(t.starts, t.ends, strict=True)]
        assert seen == [w for x in texts for w in (x or "").encode().split()]
        assert counts == [len((x or "").encode().split()) for x in texts]


# ---- near-duplicates


def plain_words(t):
    return re.sub(r"[\x00-/:-@\[-`{-\x7f]", " ", (t or "").lower()).split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_classes(rows, similarity=0.8):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    w = [plain_words(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            long = max(len(w[a]), len(w[b]))
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or (long and abs(len(w[a]) - len(w[b])) <= 0.2 * long and set(w[a]) & set(w[b]) and distance(w[a], w[b]) <= (1 - similarity) * long + 1e-9):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted(sorted(g) for g in groups.values())


def test_near_classes(spark):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = words_text(rng, rng.choice([30, 80, 200])).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(len(w) // 20):
                k = rng.randrange(len(w))
                if rng.random() < 0.6:
                    w[k] = f"new{rng.randrange(10**6)}"
                elif rng.random() < 0.5:
                    del w[k]
                else:
                    w.insert(k, "more")
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate([rows[0][1], rows[0][1].upper() + "!", "", None, "one two", "one two", "three"])]
    df = spark.createDataFrame(rows, DOC).withColumn("node", F.lit(1))
    got = order_minhash.near_classes(df).collect()
    classes = defaultdict(list)
    for r in got:
        classes[r["class_id"]].append(r["doc_id"])
    assert sorted(sorted(g) for g in classes.values()) == brute_classes(rows)
    assert all(min(g) == c for c, g in classes.items())
    assert Counter(r["class_id"] for r in got if r["kept"]) == Counter(classes.keys())


@pytest.mark.parametrize("n", [7, 10, 40, 120])
def test_near_classes_lose_no_pair(spark, n):
    """Star families: a base and variants of similarity 0.8 to it, below 0.8 among themselves."""
    rng = random.Random(n)
    rows = []
    for _ in range(4):
        base = words_text(rng, n, 100_000).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(8):
            w = list(base)
            for k in rng.sample(range(n), n // 5):
                w[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    classes = defaultdict(list)
    for r in order_minhash.near_classes(spark.createDataFrame(rows, DOC)).collect():
        classes[r["class_id"]].append(r["doc_id"])
    assert sorted(sorted(g) for g in classes.values()) == [list(range(9 * k, 9 * k + 9)) for k in range(4)]


def test_few_unrelated_texts_are_compared(spark):
    """Long texts over one small vocabulary, and pairs of similarity 0.8: all of these are candidates, and few others."""
    rng = random.Random(8)
    texts = [words_text(rng, n, 2000).split() for n in [400] * 150 + [60] * 150]
    for k in range(0, 300, 10):
        w = list(texts[k])
        for i in rng.sample(range(len(w)), len(w) // 5):
            w[i] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "_th long, text string")
    ranks = prefixes.frequencies(docs, order_minhash.plain, 0.8)
    told = docs.mapInArrow(order_minhash._told(4, 0.8, ranks), "node long, n int, keys binary, buckets array<long>")
    got = {(r["a"], r["b"]) for r in prefixes.pairs(told.withColumn("root", F.col("node")), 0.8).collect()}
    assert got >= {(10 * k, 300 + k) for k in range(30)}
    assert len(got) < 300


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_candidates_lose_no_pair(spark, similarity):
    """Repeated words, insertions and deletions, lengths from one word on."""
    rng = random.Random(9)
    texts = []
    for n in [*range(1, 40), 90, 200]:
        base = [f"w{rng.randrange(8)}" for _ in range(n)]
        texts.append(base)
        for _ in range(4):
            w = list(base)
            for _ in range(math.floor(n * (1 - similarity) + 1e-9)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = [f"w{rng.randrange(8)}"] * rng.randrange(2)
            texts.append(w)
    texts = sorted({tuple(w) for w in texts if w})
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "_th long, text string").repartition(3)
    ranks = prefixes.frequencies(docs, order_minhash.plain, similarity)
    told = docs.mapInArrow(order_minhash._told(4, similarity, ranks), "node long, n int, keys binary, buckets array<long>")
    got = {(r["a"], r["b"]) for r in prefixes.pairs(told.withColumn("root", F.col("node")), similarity).collect()}
    near = {(a, b) for b in range(len(texts)) for a in range(b) if distance(texts[a], texts[b]) <= (1 - similarity) * max(len(texts[a]), len(texts[b])) + 1e-9}
    assert len(near) > 100 and got >= near


def test_a_crowd_is_counted_in_few_rows(spark, monkeypatch):
    """Long texts around one base, not all in one class: they share most keys, and a pair is not told once for each part of the keys."""
    rng = random.Random(12)
    base = words_text(rng, 400, 100_000).split()
    texts = [list(base) for _ in range(60)]
    for w in texts:
        for k in rng.sample(range(400), 60):
            w[k] = f"x{rng.randrange(10**9)}"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "_th long, text string")
    ranks = prefixes.frequencies(docs, order_minhash.plain, 0.8)
    told = docs.mapInArrow(order_minhash._told(4, 0.8, ranks), "node long, n int, keys binary, buckets array<long>").withColumn("root", F.when(F.col("node") < 40, 0).otherwise(F.col("node")))
    rows, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: (rows.append(df), stored(df))[1])
    got = {(r["a"], r["b"]) for r in prefixes.pairs(told, 0.8).collect()}
    assert len(got) > 500
    met = rows[0].where("hub is null").count()
    crowds = rows[0].where("hub is not null").select("hub", "lists").repartition(4, "hub").mapInArrow(prefixes._crowds(0.8), "a long, b long, c long, least long").count()
    assert met + crowds < 1.5 * len(got), (met, crowds, len(got))


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_signs_turn_away_no_similar_pair(spark, similarity):
    rng = random.Random(13)
    texts = []
    for n in [*range(1, 30), 63, 64, 65, 127, 129, 300]:
        base = words_text(rng, n, 1000).split()
        other = list(base)
        for _ in range(math.floor(n * (1 - similarity) + 1e-9)):
            i = rng.randrange(len(other) + 1)
            other[i : i + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
        texts += [base, other or base]
    [(t, _)] = list(wordtape.tapes(order_minhash.plain(pa.array([" ".join(w) for w in texts]))))
    signed = spark.createDataFrame([(i, len(w), x) for i, (w, x) in enumerate(zip(texts, prefixes.signs(t), strict=True))], "node long, n int, signs binary")
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    got = {(r["a"], r["b"]) for r in prefixes.likely(spark.createDataFrame(pairs, "a long, b long"), signed, similarity).collect()}
    near = {(a, b) for a, b in pairs if distance(texts[a], texts[b]) <= (1 - similarity) * max(len(texts[a]), len(texts[b])) + 1e-9}
    assert len(near) >= 30 and got >= near and len(got) < len(pairs) // 2


def test_order_counts(spark):
    """The same shingles in another order are not a near-duplicate."""
    rng = random.Random(2)
    parts = [words_text(rng, 12) for _ in range(10)]
    rows = [(1, " ".join(parts)), (2, " ".join(reversed(parts)))]
    assert {r["class_id"] for r in order_minhash.near_classes(spark.createDataFrame(rows, DOC)).collect()} == {1, 2}


def test_near_classes_of_an_empty_table(spark):
    assert order_minhash.near_classes(spark.createDataFrame([], DOC)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    other = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain + star + other, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(51)} == {100}
    assert all(got[a] == got[b] for a, b in other if a != b)
    assert all(r <= n for n, r in got.items())


# ---- lines


def test_lines(spark):
    rng = random.Random(5)
    line = words_text(rng, 30)
    fuzzy = line.split()
    fuzzy[7] = "changed"
    rows = [
        (1, f"{line}\nshort one\n{words_text(rng, 12)}"),
        (2, f"{line.upper()}!\nshort one"),
        (3, " ".join(fuzzy)),
        (4, f"{words_text(rng, 20)}\n\n{line}"),
        (5, None),
        (6, ""),
        (7, "same words here again now\nsame words here again now"),
        (8, "same words here again now"),
        (8, "same words here again now"),
        (9, words_text(rng, 70_000, 50)),
    ]
    df = spark.createDataFrame(rows, DOC).withColumn("n_chars", F.lit(1))
    got = line_dedup.line_dedup(df).collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1] == rows[0][1] and text[9] == rows[-1][1]
    assert text[2] == "short one"
    assert text[3] == ""
    assert text[4] == rows[3][1].rsplit("\n", 1)[0]
    assert text[5] is None and text[6] == ""
    assert text[7] == "same words here again now" and text[8] == ""
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1, 8: 1, 9: 0}


@pytest.mark.parametrize("n", [5, 6, 125, 127, 200, 16383, 16384])
def test_simhash_is_the_majority(spark, n):
    words = words_text(random.Random(n), n, max(3, n // 3)).split()
    got = line_dedup.lines(spark.createDataFrame([(1, " ".join(words))], DOC)).first()["_sim"]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64)
    bits = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    want = sum(1 << k for k in range(64) if 2 * int(bits[k]) > n)
    assert got is None if n > 16383 else got % 2**64 == want


@pytest.mark.parametrize("vocabulary", [100_000, 60])
def test_line_classes_are_those_of_brute_force(spark, vocabulary):
    """Pairs of 80 to 100 % similarity, words frequent and rare, repeated words; no pair may be lost."""
    rng = random.Random(vocabulary)
    rows = []
    for n in [5, 6, 9, 10, 15, 30, 60, 180, 199, 201, 240]:
        for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.2, 0.2):
            base = words_text(rng, n, vocabulary).split()
            other = list(base)
            for k in rng.sample(range(n), int(n * share + 1e-9)):
                other[k] = f"x{rng.randrange(10**6)}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, DOC)
    at = line_dedup.lines(docs)
    root = {r["node"]: r["root"] for r in line_dedup.classes(at, docs).collect()}
    key = {r["_id"]: r["_key"] for r in at.collect()}
    got = defaultdict(list)
    for i, _ in rows:
        got[root.get(key[i], key[i])].append(i)
    want = brute_classes(rows)
    # two words share a code once in 94, so lines may be joined that brute force keeps apart, but none be lost
    where = {i: g for g, ids in enumerate(got.values()) for i in ids}
    assert [g for g in want if len({where[i] for i in g}) > 1] == []
    assert len(got) >= len(want) - 5


def test_a_crowded_bucket_is_compared_whole(spark):
    """All lines share ten words; pairs that resemble each other, and no hub, are found."""
    rng = random.Random(8)
    stem = [f"s{k}" for k in range(10)]
    rows = []
    for _ in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(6)]
        other = [*own[:3], *[f"o{rng.randrange(10**6)}" for _ in range(3)]]
        rows += [(len(rows), " ".join(stem + own)), (len(rows) + 1, " ".join(stem + other))]
    docs = spark.createDataFrame(rows, DOC)
    at = line_dedup.lines(docs)
    root = {r["node"]: r["root"] for r in line_dedup.classes(at, docs).collect()}
    key = {r["_id"]: r["_key"] for r in at.collect()}
    assert all(key[i] in root and root[key[i]] == root.get(key[i + 1]) for i in range(0, 300, 2))
    assert len(set(root.values())) == 150


def test_no_line_pair_is_lost_to_chance(spark):
    """Every fifth word changed, so that few runs of words are left: all of 600 pairs are found, none by luck of a hash."""
    rng = random.Random(31)
    rows = []
    for k in range(600):
        base = words_text(rng, 15 + 5 * (k % 10), 100_000).split()
        other = [f"x{rng.randrange(10**6)}" if i % 5 == 2 else w for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, DOC)
    at = line_dedup.lines(docs)
    root = {r["node"]: r["root"] for r in line_dedup.classes(at, docs).collect()}
    key = {r["_id"]: r["_key"] for r in at.collect()}
    assert [i for i in range(0, 1200, 2) if key[i] not in root or root[key[i]] != root.get(key[i + 1])] == []


def test_the_search_lets_go_of_what_it_has_read(spark, monkeypatch):
    """The table of all buckets is gone before lines are compared, the table of shared buckets before classes are joined."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = words_text(rng, 20, 40).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:18], f"x{k}", f"y{k}"]))]
    docs = spark.createDataFrame(rows, DOC)
    events, discard, verified, mixed = [], common.discard, line_dedup._verified, line_dedup._mixed
    monkeypatch.setattr(common, "discard", lambda df: (events.append(tuple(df.columns)), discard(df))[1])
    monkeypatch.setattr(line_dedup, "_verified", lambda *a: (events.append("verify"), verified(*a))[1])
    monkeypatch.setattr(line_dedup, "_mixed", lambda *a: (events.append("mixed"), mixed(*a))[1])
    line_dedup.line_dedup(docs).count()
    wide = next(k for k, e in enumerate(events) if "_buckets" in e and "_id" in e and k > 0)
    assert wide < events.index("verify")
    assert events.index(("bucket", "node", "_f")) == events.index("mixed") + 1


def test_hot_buckets_are_compared_whole(spark, monkeypatch):
    """Buckets above the share of hot ones are not sorted in one task, and lose no pair."""
    monkeypatch.setattr(line_dedup, "CROWD", 20)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 10**9)
    rng = random.Random(9)
    stem, rows = [f"s{k}" for k in range(10)], []
    for _ in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(6)]
        rows += [(len(rows), " ".join(stem + own)), (len(rows) + 1, " ".join([*stem, *own[:3], *[f"o{rng.randrange(10**6)}" for _ in range(3)]]))]
    docs = spark.createDataFrame(rows, DOC)
    at = line_dedup.lines(docs)
    root = {r["node"]: r["root"] for r in line_dedup.classes(at, docs).collect()}
    key = {r["_id"]: r["_key"] for r in at.collect()}
    assert all(key[i] in root and root[key[i]] == root.get(key[i + 1]) for i in range(0, 80, 2))
    assert len(set(root.values())) == 40


def test_buckets_in_parts_give_the_same_classes(spark, monkeypatch):
    """Each part of the buckets is let go of before the next one is dealt, hot buckets too, and no pair is lost between parts."""
    rng = random.Random(17)
    stem, rows = [f"s{k}" for k in range(10)], []
    for k in range(40):
        own, base = [f"o{rng.randrange(10**6)}" for _ in range(6)], words_text(rng, 15 + k, 60).split()
        other = [f"x{rng.randrange(10**6)}" if i % 5 == 2 else w for i, w in enumerate(base)]
        for w in (stem + own, [*stem, *own[:3], *[f"o{rng.randrange(10**6)}" for _ in range(3)]], base, other):
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, DOC)
    at = line_dedup.lines(docs)
    whole = {r["node"]: r["root"] for r in line_dedup.classes(at, docs).collect()}
    monkeypatch.setattr(line_dedup, "PART", 100)
    monkeypatch.setattr(line_dedup, "CROWD", 20)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 10**9)
    alive, most, stored, discard = set(), [], common.stored, common.discard
    monkeypatch.setattr(common, "stored", lambda df: (lambda out: (alive.add((out.stored_at, *out.columns)), most.append(sum("major" in x for x in alive)), out)[2])(stored(df)))
    monkeypatch.setattr(common, "discard", lambda df: (alive.discard((df.stored_at, *df.columns)), discard(df))[1])
    assert {r["node"]: r["root"] for r in line_dedup.classes(at, docs).collect()} == whole
    assert most[-1] <= 2 < max(most) <= line_dedup.PARTS + 1 and not any("bucket" in x for x in alive)


def shared_rows(spark, monkeypatch, rows):
    """How many rows of buckets are left to work on, and the classes."""
    docs, counts, members = spark.createDataFrame(rows, DOC), [], line_dedup._members
    monkeypatch.setattr(line_dedup, "_members", lambda *a: (lambda out: (counts.append(out.count()), out)[1])(members(*a)))
    roots = line_dedup.classes(line_dedup.lines(docs), docs).collect()
    monkeypatch.setattr(line_dedup, "_members", members)
    return sum(counts), {r["node"]: r["root"] for r in roots}


def test_unrelated_lines_share_few_buckets(spark, monkeypatch):
    """Pairs of frequent words meet by chance, the more the larger the table; what is dealt on must not grow with that."""
    rng = random.Random(41)
    n, roots = shared_rows(spark, monkeypatch, [(k, words_text(rng, 20, 300)) for k in range(1600)])
    assert n <= 160 and roots == {}


def test_lines_of_other_lengths_leave_a_bucket(spark, monkeypatch):
    """One passage in lines of 12, 40, 140 and 480 words, of which none can be similar to another; then one more that is."""
    rng = random.Random(43)
    passage = words_text(rng, 12, 10**6)
    rows = [(k, f"{passage} {words_text(rng, more, 10**6)}".strip()) for k, more in enumerate((0, 28, 128, 468))]
    assert shared_rows(spark, monkeypatch, rows) == (0, {})
    n, roots = shared_rows(spark, monkeypatch, [*rows, (9, f"{rows[1][1]} more"), (10, f"{passage} less")])
    assert n > 0 and len(roots) == 4 and len(set(roots.values())) == 2


def test_repeats_of_a_key_count_once_in_a_bucket(spark, monkeypatch):
    """Places of one key, many or few, are one line to the search; a key with a share of all rows is cut down first."""
    rng = random.Random(47)
    base = [words_text(rng, 20, 10**6) for _ in range(4)]
    rows = [(k, "\n".join([base[0], base[1] if k % 9 == 0 else words_text(rng, 20, 10**6)])) for k in range(60)]
    assert shared_rows(spark, monkeypatch, rows) == (0, {})
    rows += [(100, f"{base[0]} more"), (101, f"{base[1]} more")]
    n, roots = shared_rows(spark, monkeypatch, rows)
    assert len(roots) == 4 and len(set(roots.values())) == 2
    monkeypatch.setattr(line_dedup, "CROWD", 20)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 10**9)
    assert shared_rows(spark, monkeypatch, rows) == (n, roots)


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "All rights reserved.\n你好世界。\n---\n\n yes no"), (2, "all rights reserved\n你好世界。\n---\n\nyes no!"), (3, "all rights\n\n****\n")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOC), short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 4), 3: (rows[2][1], 0)}
    kept = line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).collect()
    assert all(r["n_dropped"] == 0 for r in kept)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], DOC)).count() == 0


# ---- benchmark

ITEMS = [
    (1, "A train leaves Boston at 9 and travels 120 km in 3 hours; then Maria asks how far it went in the first hour of the trip."),
    (2, "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river"),
    (3, "too short item"),
    (4, None),
    (None, "no id but many words in this item that nobody should ever match at all"),
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"before it. {ITEMS[0][1]} and after", {1}),
        ("A train leaves Dallas at 7 and travels 450 km in 5 hours; then Peter asks how far it went in the first hour of the trip.", {1}),
        (ITEMS[1][1].upper().replace(" ", ", "), {2}),
        (" ".join(ITEMS[1][1].split()[:6]), set()),
        ("the quick brown fox jumps over the lazy cat while eight wise cats watch from the new oak bench near the lake", set()),
        ("too short item", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_templates(spark, text, want):
    docs = spark.createDataFrame([(7, text), (8, "clean words that have nothing to do with any of it")], DOC).withColumn("words", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("w", F.lit(1))
    for portion in (100_000, 10):
        got = decontaminate.found_items(docs, items, portion=portion).collect()
        assert {r["item_id"] for r in got if r["doc_id"] == 7} == want
        assert not [r for r in got if r["doc_id"] == 8]


def test_slots_must_be_consistent(spark):
    item = "if x is 5 then y is 5 and if z is 5 then the sum of it all is 5 and 5"
    docs = [(1, item.replace("5", "8")), (2, "if x is 1 then y is 2 and if z is 3 then the sum of it all is 4 and 6")]
    got = decontaminate.found_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1}


def test_one_altered_slot_costs_its_windows_only(spark):
    item = "when x is 5 we read the long book and then y is 5 so that all of the other pages which come after it are read by the same 5 people on one quiet evening in the old house beside the river"
    docs = [(1, item.replace("y is 5", "y is 7")), (2, "you have 3 apples and 4 pears in the basket")]
    items = [(1, item), (2, "you have 2 apples and 2 pears in the basket")]
    got = decontaminate.found_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1)}
    row = got[0]
    assert row["n_found"] == row["n_windows"] - 5


def test_lists_of_numbers_match_only_when_copied(spark):
    rng = random.Random(5)
    listed = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    item = listed(40)
    docs = [(1, f"numbers {item} end"), (2, listed(20_000)), (3, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)))]
    got = decontaminate.found_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item), (2, listed(3_000))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["share"]) for r in got] == [(1, 1, 1.0)]


def test_leaks_of_the_test_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: re.sub(r"\W+", " ", (t or "").lower()).split()
    held = {r["doc_id"]: " ".join(plain(r["text"])) for r in docs.collect()}
    want = {(d, i["item_id"]) for i in items.collect() for d, t in held.items() if f" {' '.join(plain(i['text']))} " in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.found_items(docs, items).collect()}
    assert want <= got


def test_unspaced_scripts_in_lines_texts_and_items(spark):
    item = "\u706b\u8f66\u4e5d\u70b9\u79bb\u5f00\u6ce2\u58eb\u987f\u4e09\u5c0f\u65f6\u8d70\u4e86\u4e00\u767e\u516c\u91cc"
    rows = [(1, f"{item}\u3002"), (2, item), (3, "\u5b8c\u5168\u4e0d\u540c\u7684\u53e5\u5b50\u6ca1\u6709\u4efb\u4f55\u5173\u7cfb")]
    df = spark.createDataFrame(rows, DOC)
    assert {r["doc_id"] for r in decontaminate.found_items(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1, 2}
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(df).collect()} == {1: 0, 2: 1, 3: 0}


def test_texts_with_too_few_windows_stay_where_they_are(spark):
    """Half an item is in all documents: none of these texts is joined with hits, the one that holds the whole item is."""
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    half = " ".join(item.split()[:8])
    docs = spark.createDataFrame([(k, f"x{k} {half} y{k}") for k in range(200)] + [(200, f"so {item} then")], DOC)
    found = decontaminate.found_items(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["doc_id"] for r in found.collect()] == [200]
    plan = found._jdf.queryExecution().executedPlan().treeString()
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and "_cell" in semi[0]


def test_benchmark_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], DOC), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.found_items(docs.limit(0), items).count() == 0
    assert decontaminate.found_items(docs, items.limit(0)).count() == 0


# ---- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), common.stored(stage(spark, kept, SF))
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before
    assert kept.count() == kept.select("doc_id").distinct().count()
    texts = [r["text"] for r in kept.collect()]
    assert max(Counter(texts).values()) == 1
    mixed = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in mixed.select("doc_id").collect()) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
