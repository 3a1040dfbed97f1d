"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector of hashed word weights, statistics of its structure (punctuation, letter case,
repetition, lengths) and the table's n_chars. The score is logistic(w0 + w.x + pairwise), where the pairwise term
sum_{i<j} <v_i, v_j> x_i x_j is computed in linear time as half of (sum v_i x_i)^2 - sum v_i^2 x_i^2.

The machine is fitted on the driver on at most `max_train` labelled rows (a documented bound; those of the smallest
hash of doc_id, so the sample does not depend on partitions) and then scores every whole text where it lies: one scan,
no shuffle of texts. doc_id serves only to find labels and to hold rows out; doc_id, lang and source are no features.

Null texts count as empty and, like empty texts, get the score of their statistics. Labels that repeat are averaged
(a tie counts as 1), null ones are left out. Without any usable label every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
RANK = 8
MAX_TRAIN = 4000
THRESHOLD = 0.7
_NON_WORD = re.compile(r"[^\w\s]")
N_STATS = 14
N_FEATURES = BUCKETS + N_STATS


_known: dict[str, tuple[int, ...]] = {}
_KNOWN = 100_000  # words whose traits a process remembers; forgotten together when full


def _traits(w: str) -> tuple[int, ...]:
    """Bucket, marks, and whether the word is upper case, ends in two marks, has no letter or digit, has a digit, is capitalised."""
    got = _known.get(w)
    if got is None:
        if len(_known) >= _KNOWN:
            _known.clear()
        bucket = crc32(w.lower().encode("utf-8", "replace")) & (BUCKETS - 1)
        long = len(w) > 1
        got = (bucket, len(_NON_WORD.findall(w)), w.isupper() and long, long and not w[-1].isalnum() and not w[-2].isalnum(), not any(x.isalnum() for x in w), any(x.isdigit() for x in w), w[0].isupper())
        if len(w) <= 40:
            _known[w] = got
    return got


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the vector of a text; words first, then statistics (always all of them)."""
    t = text or ""
    words = t.split()
    n, size = len(words), max(1, len(t))
    counts = Counter(words)
    traits = np.array([_traits(w) for w in counts], np.int64).reshape(-1, 7)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    idx, where = np.unique(traits[:, 0], return_inverse=True)
    val = np.sqrt(np.bincount(where, times, len(idx)).astype(np.float32))
    if n:
        val /= math.sqrt(float((val * val).sum()))
    marks, upper, marked, bare, digits, capital = (times @ traits[:, 1:]).tolist()
    m = max(1, n)
    stats = np.array(
        [
            math.log1p(n) / 8,
            10 * marks / size,
            upper / m,
            marked / m,
            bare / m,
            digits / m,
            len(counts) / math.sqrt(m) / 10,
            (int(times.max()) if n else 0) / m,
            (size - n) / m / 10,
            t.count("\n") / m * 5,
            capital / m,
            0.0 if n else 1.0,
            math.log1p(max(0, n_chars or 0)) / 10,
            1.0 if n_chars is None else 0.0,
        ],
        np.float32,
    )
    return np.concatenate([idx.astype(np.int32), np.arange(BUCKETS, N_FEATURES, dtype=np.int32)]), np.concatenate([val, stats])


class Machine:
    """Weights of a fitted machine; small and of fixed size whatever the corpus."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w.astype(np.float32), v.astype(np.float32)
        self.v2 = self.v**2

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        s = val @ self.v[idx]
        z = self.w0 + float(val @ self.w[idx]) + 0.5 * float(s @ s - (val * val) @ self.v2[idx].sum(1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = 30, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss over mini-batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    n, d = len(rows), N_FEATURES
    w0 = np.zeros(1, np.float32)
    w = np.zeros(d, np.float32)
    v = rng.normal(0, 0.01, (d, rank)).astype(np.float32)
    if not n:
        return Machine(0.0, w, v * 0)
    x = np.zeros((n, d), np.float32)
    for i, (idx, val) in enumerate(rows):
        np.add.at(x[i], idx, val)
    y = labels.astype(np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w0, w, v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            b = x[order[at : at + 128]]
            s, b2 = b @ v, b * b
            z = w0[0] + b @ w + 0.5 * ((s * s).sum(1) - b2 @ (v * v).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[at : at + 128]]) / len(b)
            grads = (np.array([g.sum()], np.float32), b.T @ g + decay * w, b.T @ (g[:, None] * s) - v * (b2.T @ g)[:, None] + decay * v)
            step += 1
            for p, gr, (m1, m2) in zip((w0, w, v), grads, state, strict=True):
                m1 += 0.1 * (gr - m1)
                m2 += 0.001 * (gr * gr - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Machine(float(w0[0]), w, v)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(idx, val, y) of at most max_train labelled rows that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, n) for t, n in zip(b["text"].to_pylist(), b["n_chars"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["y"], pa.array([i.astype(np.int16).tobytes() for i, _ in got], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in got], pa.binary())],
                names=["doc_id", "y", "idx", "val"],
            )

    # at most max_train rows are broadcast, whatever the tables' size
    return docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", "y").mapInArrow(run, "doc_id long, y double, idx binary, val binary")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    # a repeated doc_id of the sample must not lengthen what is fetched
    told = training_rows(docs, labels, max_train).groupBy("doc_id").agg(F.min(F.struct("idx", "val", "y")).alias("x"))
    rows = told.select("doc_id", "x.*").limit(max_train).toArrow().sort_by("doc_id")
    vectors = [(np.frombuffer(i, np.int16).astype(np.int32), np.frombuffer(v, np.float16).astype(np.float32)) for i, v in zip(rows["idx"].to_pylist(), rows["val"].to_pylist(), strict=True)]
    return fit(vectors, np.array([float(y >= 0.5) for y in rows["y"].to_pylist()]))


def with_scores(docs: DataFrame, machine: Machine, column: str = "_score") -> DataFrame:
    """docs with the score of each row's whole text added; the other columns pass unchanged."""
    columns = docs.columns
    # names of any kind, with dots too, are out of the way meanwhile
    names = [c if c in ("text", "n_chars") else f"c{k}" for k, c in enumerate(columns)]
    docs = docs.toDF(*names)
    schema = docs.withColumn("s", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns = b["n_chars"].to_pylist() if "n_chars" in names else [None] * b.num_rows
            got = [machine.score(*features(t, n)) for t, n in zip(b["text"].to_pylist(), ns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*names, "s"])

    return docs.mapInArrow(run, schema).toDF(*columns, column)


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text, n_chars)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    machine = train(docs, labels, max_train)
    got = with_scores(docs, machine, "score")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
