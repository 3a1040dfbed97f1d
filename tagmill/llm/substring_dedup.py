"""Removal of repeated passages by level-wise doubling.

A window is `size` consecutive words of a text. Every word under a window that also starts anywhere else, in another
text or the same one, is removed; windows are judged on the input.

Levels: s = ceil(size / 4), ceil(size / 2), size (9, 18, 35). Windows repeated at one length alone are extended to
twice that length, until no candidates survive:

1. In each window of full size the s-gram with the smallest hash is its anchor. Equal windows have equal anchors at
   equal places, so only anchors (one word in fourteen) are counted, by an aggregation that is partial before it
   shuffles. Anchors seen once end here, and with them every window they stand for.
2. A surviving anchor is extended to both sides to twice its length; the two extensions are counted in the same way.
   A window survives if each extension that it contains is repeated.
3. Surviving windows are counted at full size and those repeated are joined back to their places.

Rows of equal text are found by their text's hash; one of them takes part in step 3, and all lose all words that a
window covers. Texts cross the network once: the exchange by row key serves step 3 and the removal. No group is
gathered in a task: keys are aggregated partially, or stand in joins that Spark splits when they are hot.

Hashes of windows have 64 bits: among n candidate windows about n**2 / 2**65 pairs meet by chance.

Null texts count as empty; a null or repeated doc_id is told apart by its text. Texts shorter than a window stay whole.
Repeated rows are repeats of each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordtape import extend, sliding_argmin, tapes, windows

SIZE, LISTS = 35, 4096
#: Turns a counted key into one that Spark deals anew, so that both sides of the join can be split when a key is hot.
_TURN = 0x2545F4914F6CDD1D


def _levels(size: int) -> tuple[int, int]:
    half = -(-size // 2)
    return -(-half // 2), half


def _marked(words: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Window starts, the anchor position of each, and hashes at the three lengths."""
    small, half = _levels(size)
    w1 = windows(words, small)
    w2 = extend(w1, half - small)
    w3 = extend(w2, size - half)
    anchor = sliding_argmin(w1, size - small + 1)
    p = np.flatnonzero(left[: len(w3)] >= size)
    return p, anchor[p], w1, w2, w3


def _anchors(size: int):  # noqa: ANN202
    """(h, ext, rk, lp) of each anchor. ext: 32 bits of its right and of its left extension; lp: its place times 4 and
    the sides (1 right, 2 left) that some window of it contains."""
    small, half = _levels(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk = b["rk"].to_numpy(zero_copy_only=False)
            for t, _ in tapes(b["text"]):
                if len(t.words) < size:
                    continue
                p, a, w1, w2, _w3 = _marked(t.words, t.left(), size)
                if not len(p):
                    continue
                # windows of one anchor are consecutive; from the last to the first their anchor stands further right
                head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                tail = np.append(head[1:], len(a)) - 1
                at, far, near = a[head], a[head] - p[head], a[head] - p[tail]  # the anchor's greatest and least offset
                right, left = near <= size - half, far >= half - small
                row = t.row_of()[at]
                r = w2[np.minimum(at, len(w2) - 1)] >> np.uint64(32) << np.uint64(32)
                ext = r | w2[np.maximum(at - (half - small), 0)] >> np.uint64(32)
                place = (at - t.first[row]) * 4 + right + 2 * left
                yield pa.RecordBatch.from_arrays([pa.array(w1[at].astype(np.int64)), pa.array(ext.astype(np.int64)), pa.array(rk[row + t.rows.start]), pa.array(place)], names=["h", "ext", "rk", "lp"])

    return run


def _anchor_lists(size: int):  # noqa: ANN202
    """(g, hs): the anchors' hashes in lists by their last bits; of a task, each hash once, or twice if it is repeated."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        h = np.repeat(u, np.minimum(n, 2))
        g = (h & np.uint64(LISTS - 1)).astype(np.int32)
        h = h[np.argsort(g, kind="stable")].astype(np.int64)
        size_of = np.bincount(g, minlength=LISTS)
        has = np.flatnonzero(size_of)
        return pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size_of[has])).astype(np.int32)), pa.array(h))], names=["g", "hs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for t, _ in tapes(b["text"]):
                if len(t.words) >= size:
                    p, a, w1, _w2, _w3 = _marked(t.words, t.left(), size)
                    if len(p):
                        held.append(w1[a[np.append(True, a[1:] != a[:-1])]])
            if sum(map(len, held)) > 1_000_000:
                yield flush(held)
        if held:
            yield flush(held)

    return run


def _candidates(size: int):  # noqa: ANN202
    """(w, rk, p) of each surviving window of a text with its surviving anchors (packed: place * 4 + sides)."""
    small, half = _levels(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk = b["rk"].to_numpy(zero_copy_only=False)
            kept = b["kept"]
            for t, _ in tapes(b["text"]):
                if len(t.words) < size:
                    continue
                p, a, _w1, _w2, w3 = _marked(t.words, t.left(), size)
                sides = np.zeros(len(t.words), np.int8)
                for k, r in enumerate(t.rows):
                    places = np.asarray(kept[r].values.to_numpy(), np.int64)
                    for side in (1, 2):
                        sides[t.first[k] + (places[places & side > 0] >> 2)] |= side
                s, o = sides[a], a - p
                ok = (s > 0) & ((o > size - half) | (s & 1 > 0)) & ((o < half - small) | (s & 2 > 0))
                p = p[ok]
                if len(p):
                    row = t.row_of()[p]
                    yield pa.RecordBatch.from_arrays([pa.array(w3[p].astype(np.int64)), pa.array(rk[row + t.rows.start]), pa.array((p - t.first[row]).astype(np.int32))], names=["w", "rk", "p"])

    return run


def _removal(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_gone, digest, texts = [], [], [], []
            copied, hits = b["copied"].to_pylist(), b["hits"]
            for t, data in tapes(b["text"]):
                for k, r in enumerate(t.rows):
                    x, y = t.first[k], t.first[k + 1]
                    n = int(y - x)
                    cover = np.zeros(n + 1, np.int64)
                    if copied[r] and n >= size:
                        cover[0] = 1
                    elif hits[r].is_valid and n:
                        at = np.unique(hits[r].values.to_numpy())
                        cover[at] += 1
                        np.add.at(cover, np.minimum(at + size, n), -1)
                    gone = np.cumsum(cover[:n]) > 0
                    keep = np.flatnonzero(~gone) + x
                    raw = b" ".join(data[i:j].tobytes() for i, j in zip(t.starts[keep].tolist(), t.ends[keep].tolist(), strict=True)) if 0 < len(keep) < n else b" ".join(data[t.starts[x] : t.ends[y - 1]].tobytes().split()) if len(keep) else b""
                    n_words.append(n)
                    n_gone.append(int(gone.sum()))
                    digest.append(hashlib.sha256(raw).hexdigest())
                    texts.append(raw)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _turned(c: str) -> Column:
    return F.col(c).bitwiseXOR(F.lit(_TURN)).alias("_k")


def _in_repeated(rows: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """The rows whose key occurs in two rows or more (of counted: key, n)."""
    # counting rk asks for the columns that the join asks for too, so that what lies below is shuffled once for both
    counted = rows.groupBy(key).agg(F.count("rk").alias("n")) if counted is None else counted
    return rows.withColumn("_k", _turned(key)).drop(key).join(counted.where("n > 1").select(_turned(key)), "_k")


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row of docs (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", F.xxhash64(F.coalesce("doc_id", F.lit(-(2**62))), "text"))
    anchors = keyed.select("rk", "text").mapInArrow(_anchors(size), "h long, ext long, rk long, lp long").where("rk is not null")  # never null: said here so that all plans below agree
    lists = keyed.select("text").mapInArrow(_anchor_lists(size), "g int, hs array<long>").repartition("g")
    counted = lists.select("g", F.explode("hs").alias("h")).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).select("h", "n")
    # level 1 to 2: both extensions of the anchors that are repeated
    first = _in_repeated(anchors, "h", counted)
    side = lambda n, bits: F.when(F.col("lp").bitwiseAND(F.lit(n)) > 0, F.struct(F.floor(F.col("lp") / 4).cast("long") * 4 + n, F.xxhash64("_k", F.lit(n), bits)))
    sides = first.select("rk", F.explode(F.array(side(1, F.shiftrightunsigned("ext", 32)), side(2, F.col("ext").bitwiseAND(F.lit(0xFFFFFFFF))))).alias("s")).where("s is not null").select("rk", F.col("s.col1").alias("lp"), F.col("s.col2").alias("e"))
    # level 2 to 3
    kept = _in_repeated(sides, "e").groupBy("rk").agg(F.collect_list("lp").alias("kept"))
    # rows of equal text; a row that is repeated with its doc_id has one key, and its text is repeated all the same
    same = keyed.select("rk", F.xxhash64("text").alias("th"), F.length("text").alias("len"))
    groups = same.groupBy("th", "len").agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("lead")).where("n > 1").select(_turned("th"), "len", "lead")
    copies = same.select("rk", _turned("th"), "len").join(groups, ["_k", "len"]).select("rk", (F.col("rk") != F.col("lead")).alias("follows")).distinct()
    texts = keyed.select("rk", "doc_id", "text")
    once = kept.join(copies.where("follows").select("rk"), "rk", "left_anti")
    tall = texts.join(once, "rk").select("rk", "text", "kept", "doc_id").mapInArrow(_candidates(size), "w long, rk long, p int")
    hits = _in_repeated(tall, "w").groupBy("rk").agg(F.collect_list("p").alias("hits"))
    fate = hits.join(copies.select("rk", F.lit(True).alias("copied")), "rk", "full").select("rk", "hits", F.coalesce("copied", F.lit(False)).alias("copied"))
    told = texts.join(fate, "rk", "left").select("doc_id", "text", "hits", F.coalesce("copied", F.lit(False)).alias("copied"))
    return told.mapInArrow(_removal(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
