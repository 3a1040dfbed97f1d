"""Every operator and stage on tables with clashing names, nulls, empty and very long texts, repeated rows, and no rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagmill.llm import decontaminate, line_dedup, mixing, order_minhash, quality_fm, secret_scan, substring_dedup, surrogates

CLASHING = ["_id", "_th", "_score", "_row", "_h", "_s", "_before", "_map", "_drop", "_key", "root", "node", "slot", "block", "place", "n_lines", "n_dropped", "n_entities", "kept", "words", "score", "bucket", "doc_id_", "a.b"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def rows(rng):
    base, long = sentence(rng, 60), " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    near = base.replace(base.split()[20], "changed", 1)
    texts = [base, base, near, None, "", "", long, long + " more", "Mrs. Clara Jones, clara@x.example.com", f"{base}\n{sentence(rng, 40)}\nAll rights reserved", f"{sentence(rng, 40)}\nall rights reserved!", "one"]
    out = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if k % 3 == 0 else len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[0], out[6], (None, None, None, None, None), (None, base, None, "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, its documents with and without clashing columns, as rows."""
    rng, folder = random.Random(1), str(tmp_path_factory.mktemp("edges"))
    data = rows(rng)
    docs = spark.createDataFrame(data, DOC)
    clashing = docs
    for c in CLASHING:
        clashing = clashing.withColumn(c, F.lit(f"own {c}"))
    item = data[0][1].split()
    spark.createDataFrame([(1, " ".join(item[:30])), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    clashing.write.parquet(f"{folder}/documents.parquet")
    return folder, docs, spark.read.parquet(f"{folder}/documents.parquet")


OPERATORS = {
    "quality": lambda s, d, f: quality_fm.quality(d, s.read.parquet(f"{f}/labels.parquet")),
    "passages": lambda s, d, f: substring_dedup.substring_dedup(d),
    "near": lambda s, d, f: order_minhash.near_classes(d),
    "benchmark": lambda s, d, f: decontaminate.found_items(d, s.read.parquet(f"{f}/benchmark.parquet")),
    "secrets": lambda s, d, f: secret_scan.secret_scan(d),
    "mix": lambda s, d, f: mixing.mix(d, block_rows=2),
    "surrogates": lambda s, d, f: surrogates.pseudonymise(d, "k"),
    "lines": lambda s, d, f: line_dedup.line_dedup(d, short=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_clashing_names(spark, tables, name):
    folder, docs, clashing = tables
    plain, got = OPERATORS[name](spark, docs, folder), OPERATORS[name](spark, clashing, folder)
    assert set(plain.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    values = lambda df: sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in plain.columns]).collect()), key=str)
    assert values(got) == values(plain)
    one = got.first().asDict()
    assert all(one[c] == f"own {c}" for c in CLASHING if c in one and c not in plain.columns)
    assert OPERATORS[name](spark, clashing.limit(0), folder).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_clashing_names(spark, tables, name, stage):
    folder, docs, clashing = tables
    plain, got = stage(spark, docs, folder), stage(spark, clashing, folder)
    if name != "mix":
        assert got.columns == clashing.columns and plain.columns == docs.columns
    values = lambda df: sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in plain.columns]).collect()), key=str)
    assert values(got) == values(plain)
    assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHING if c not in plain.columns)
    assert stage(spark, clashing.limit(0), folder).count() == 0


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def alike(a, b):
    """Edit similarity of word lists of 0.8 or more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1] <= int(max(len(a), len(b)) * 0.2 + 1e-9)


def groups(lists):
    """Numbers of the classes of word lists, by all pairs."""
    root = list(range(len(lists)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(lists)):
        for j in range(i):
            if lists[i] == lists[j] or len(lists[i]) >= 5 and len(lists[j]) >= 5 and alike(lists[i], lists[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(lists))]


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    """Line dedup, near-dedup and decontamination in plain Python, on what the classifier kept."""
    rng = random.Random(9)
    shared, item = sentence(rng, 12), sentence(rng, 25)
    data = []
    for k in range(60):
        lines = [sentence(rng, rng.randrange(6, 25)) for _ in range(rng.randrange(1, 4))]
        if k % 6 == 0:
            lines.insert(0, shared.replace(shared.split()[k % 12], "odd", 1) if k % 4 else shared.upper())
        if k % 10 == 3:
            lines.append(f"before {item} after")
        if k % 7 == 2 and data:
            lines = [*data[-1][1].split("\n")[:1], *lines]
        data.append((k, "\n".join(lines), "en", f"s{k % 3}", 1))
    docs = spark.createDataFrame(data, DOC)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect())
    places = [(i, k, x) for i, t in kept for k, x in enumerate(t.split("\n"))]
    seen, left = set(), defaultdict(list)
    for (i, _, x), g in zip(places, groups([words_of(x) for _, _, x in places]), strict=True):
        if g not in seen:
            left[i].append(x)
        seen.add(g)
    lined = [(i, "\n".join(left[i])) for i, _ in kept]
    first, stay = set(), []
    for (i, t), g in zip(lined, groups([words_of(t) for _, t in lined]), strict=True):
        if g not in first:
            stay.append((i, t))
        first.add(g)
    want = {i: t for i, t in stay if f" {item} " not in f" {t} ".replace("\n", " ")}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert len({(r["slot"], r["place"]) for r in got}) == len(got) and len(got) < len(data)
