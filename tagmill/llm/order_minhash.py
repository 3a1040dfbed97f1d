"""Near-duplicate documents by Order MinHash and banded alignment.

A text's words (lower case, marks dropped) give shingles of five words, each labelled with its occurrence number, so
repeats count. For each of `sketches` hash functions the `ell` smallest labelled shingles are taken and put in text
order; documents that agree in such a tuple are candidates. Because order is kept, agreement follows edit similarity
rather than mere overlap. Candidates are verified by a banded alignment of their words: edit similarity 0.8 or more.

Equal texts are one node (their text hash). A bucket ties its nodes to its smallest and its largest one, never all
pairs. Verification goes in two rounds: every node against the hub it shares most buckets with, then every candidate
pair whose ends are not yet in one class. What the sketches or the hubs miss is found by a third round: all pairs of
texts of different classes that may reach the similarity, by their rarest word pairs (`prefixes`), without loss. Classes are
the connected components of verified pairs and equal texts.

Nothing is gathered by bucket or class; hubs meet their spokes in joins that Spark can split. Whole texts are read in
arrays, long ones too. The alignment runs on one character a word (of 1,856), so two words are mistaken for each other
about once in 1,856.

Null texts count as empty; all empty texts are equal. Texts of fewer than five words are one shingle. Rows with the
same doc_id and text are one document and each gets the row's class. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, prefixes
from .wordtape import Tape, mix, tapes, windows

SHINGLE, SIMILARITY, SKETCHES, ELL = 5, 0.8, 32, 2
_ALPHABET = 1856  # U+00C0 to U+07FF, two bytes each
_UNSPACED, _WIDE = re.compile(common.UNSPACED), re.compile(common.WIDE)
_U = np.uint64
_rng = np.random.default_rng(5)
_ODD = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_TABLE = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))


def plain(column: pa.Array) -> pa.Array:
    """Lower-case texts with marks as spaces, as bytes; letters of unspaced scripts are words."""

    def one(t: str) -> bytes:
        if not t.isascii() and _UNSPACED.search(t):
            t = _UNSPACED.sub(r" \1 ", _WIDE.sub(" ", t))
        return t.lower().encode().translate(_TABLE)

    return pa.array([one(t or "") for t in column.to_pylist()], pa.large_binary())


def labelled(t: Tape) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes with occurrence numbers mixed in, and where each row's shingles begin."""
    n = np.diff(t.first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    w = windows(t.words, SHINGLE)
    start = np.repeat(t.first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    h = w[np.minimum(start, max(len(w) - 1, 0))] if len(w) else np.zeros(len(start), _U)
    first = np.append(0, np.cumsum(count))
    for k in np.flatnonzero((n < SHINGLE) & (n > 0)):
        x = t.words[t.first[k] : t.first[k + 1]]
        h[first[k]] = mix((x * _ODD[: len(x)]).sum(keepdims=True) + _U(len(x)))[0]
    row = np.repeat(np.arange(len(n)), count)
    key = h ^ mix(row.astype(_U))
    order = np.argsort(key, kind="stable")
    same = np.append(False, (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1]))
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    occ = np.empty(len(h), np.int64)
    occ[order] = run
    return mix(h + occ.astype(_U) * _U(0x9E3779B97F4A7C15)), first


def sketches(labels: np.ndarray, first: np.ndarray, number: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and for each `number` hashes of their two smallest labels in text order."""
    rows = np.flatnonzero(np.diff(first))
    if not len(rows):
        return rows, np.zeros((0, number), _U)
    at, size = first[rows], np.diff(first)[rows]
    out = np.empty((len(rows), number), _U)
    top, place = _U(2**64 - 1), np.arange(len(labels))
    for j in range(number):
        v = (labels ^ (labels >> _U(31))) * _ODD[j + 16]
        low = np.minimum.reduceat(v, at)
        is_low = v == np.repeat(low, size)
        v[is_low] = top
        second = np.minimum.reduceat(v, at)
        x = np.flatnonzero(is_low)
        y = np.flatnonzero(v == np.repeat(second, size))
        # one place for each row: the first that holds the value
        px = place[x[np.searchsorted(x, at)]]
        py = place[y[np.minimum(np.searchsorted(y, at), len(y) - 1)]]
        one = size == 1
        a, b = np.where(px <= py, low, second), np.where(px <= py, second, low)
        out[:, j] = mix(np.where(one, low, a) * _U(0x9E3779B97F4A7C15) + np.where(one, _U(1), b) + _U(j))
    return rows, out


def _told(number: int, similarity: float, ranks: tuple[np.ndarray, np.ndarray], signed: bool = False):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of one task are told once; forgotten when large
        for whole in batches:
            for at in range(0, whole.num_rows, prefixes.ROWS):
                b = whole.slice(at, prefixes.ROWS)
                th = b["_th"].to_numpy(zero_copy_only=False)
                if len(seen) > 500_000:
                    seen.clear()
                new = np.array([not (h in seen or seen.add(h)) for h in th.tolist()], bool)
                if not new.any():
                    continue
                th = th[new]
                for t, _ in tapes(plain(b["text"].filter(pa.array(new)))):
                    rows, s = sketches(*labelled(t), number)
                    if len(rows):
                        n = np.diff(t.first)
                        k, first = prefixes.keys(t, ranks, similarity)  # rows without words have no keys
                        buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, number, np.int32)), pa.array(s.reshape(-1).astype(np.int64)))
                        raw = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(6 * first[np.append(rows, len(n))]), pa.py_buffer(prefixes.packed(k))])
                        out = {"node": pa.array(th[rows + t.rows.start]), "n": pa.array(n[rows].astype(np.int32)), "keys": raw.cast(pa.binary()), "buckets": buckets}
                        if signed:
                            out["signs"] = pa.array([x for x, many in zip(prefixes.signs(t), n.tolist(), strict=True) if many], pa.binary())
                        yield pa.RecordBatch.from_pydict(out)

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, _ in tapes(plain(b["text"])):
            points = (t.words % _U(_ALPHABET)).astype(np.uint32) + 0xC0
            out += [points[x:y].astype("<u4").tobytes().decode("utf-32-le") for x, y in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["_th"], pa.array(out, pa.string())], names=["node", "code"])


def _verified(pairs: DataFrame, codes: DataFrame, similarity: float) -> DataFrame:
    one = pairs.join(codes.select(F.col("node").alias("hub"), F.col("code").alias("_x")), "hub")
    both = one.join(codes.select(F.col("node").alias("member"), F.col("code").alias("_y")), "member")
    long = F.greatest(F.length("_x"), F.length("_y"))
    both = both.withColumn("_most", F.floor(long * (1 - similarity) + 1e-9).cast("int")).where(F.abs(F.length("_x") - F.length("_y")) <= F.col("_most"))
    # the band widens: most copies differ in few words
    fits = F.expr("case when levenshtein(_x, _y, least(_most, 4 + _most div 8)) >= 0 then true else levenshtein(_x, _y, _most) >= 0 end")
    return both.where(fits).select(F.col("hub").alias("a"), F.col("member").alias("b"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, number: int = SKETCHES) -> DataFrame:
    """doc_id, class_id, _id, _th for each row of docs (doc_id, text); class_id is the smallest doc_id of the class."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *common.row_key("doc_id", "text"))
    ranks = prefixes.frequencies(keyed.select("_th", "text"), plain, similarity)
    told = common.stored(keyed.select("text", "_th").mapInArrow(_told(number, similarity, ranks, True), "node long, n int, keys binary, buckets array<long>, signs binary"))
    rows = told.select(F.explode("buckets").alias("bucket"), "node")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    ties = rows.join(shared, "bucket").select(F.col("node").alias("member"), F.explode(F.array("low", "high")).alias("hub")).where("member <> hub")
    pairs = common.cut(ties.groupBy("member", "hub").agg(F.count(F.lit(1)).alias("n")))
    leads = keyed.groupBy("_th").agg(F.min("_id").alias("_id"))

    def codes_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select("member").union(pairs.select("hub")).distinct().withColumnRenamed("member", "_th").join(leads, "_th").select("_id", "_th")
        texts = keyed.select("_id", "_th", "text").join(needed, ["_id", "_th"]).select("_th", "text")
        return common.cut(texts.mapInArrow(_codes, "node long, code string").groupBy("node").agg(F.min("code").alias("code")))

    codes = codes_of(pairs)
    best = pairs.groupBy("member").agg(F.max(F.struct("n", "hub")).alias("s")).select("member", "s.hub")
    edges = common.cut(_verified(best, codes, similarity))
    roots = common.components(edges)
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = pairs.select("member", "hub").join(root_of("member"), "member", "left").join(root_of("hub"), "hub", "left")
    apart = apart.where(~F.coalesce(F.col("member_root") == F.col("hub_root"), F.lit(False))).select("member", "hub")
    open_ = apart.select(F.least("member", "hub").alias("member"), F.greatest("member", "hub").alias("hub")).distinct()
    tested = best.select(F.least("member", "hub").alias("member"), F.greatest("member", "hub").alias("hub")).distinct()
    more = common.cut(_verified(open_.join(tested, ["member", "hub"], "left_anti"), codes, similarity))
    if not more.isEmpty():
        edges = edges.union(more)
        roots = common.components(edges)
    # what the sketches missed, without loss: pairs of different classes that may reach the similarity, by rarest word pairs
    listed = told.select("node", "n", "keys").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    signed = told.select("node", "n", "signs").dropDuplicates(["node"])
    missed = common.cut(prefixes.likely(prefixes.pairs(listed, similarity), signed, similarity))
    common.discard(told)
    if not missed.isEmpty():
        missed = missed.select(F.col("a").alias("member"), F.col("b").alias("hub"))
        rest = common.cut(_verified(missed, codes_of(missed), similarity))
        roots = common.components(edges.union(rest))
    ids = keyed.select("doc_id", "_id", "_th")
    rooted = ids.join(roots.select(F.col("node").alias("_th"), "root"), "_th", "left").withColumn("root", F.coalesce("root", "_th"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("_id", "_th")).alias("_keep"), F.count(F.lit(1)).alias("class_size"))
    return rooted.join(first, "root").select("doc_id", "class_id", "class_size", (F.col("_keep") == F.struct("_id", "_th")).alias("kept"), "_id", "_th")
