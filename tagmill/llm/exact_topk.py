"""Exact top-k inner-product search by a three-phase uniform threshold.

Components become integers floor(scale * x). The components are dealt to `lists` groups; a group's partial inner
product is that list's score of a vector, and the sum over the lists is the vector's score.

1. Every block of vectors gives, for each query, the first k of each of its local lists, with their whole scores.
   The k-th best of these bounds the answer from below: the safe cutoff tau of the query.
2. The cutoff is sent to all blocks. A vector of score tau or more has a partial score of tau / lists or more in one
   list at least, so the entries that reach this uniform threshold in some list are sufficient.
3. Only what these entries lack is resolved: their whole scores, and of those the best k, by block first, then by query.

The stated query set (ids divisible by `every`) meets all rows in a grid of blocks: queries in blocks of `query_block`,
vectors in blocks of `vector_block`; a cell of the grid is a group of query blocks and a share of the vector blocks, and
a task holds one block of each and their partial scores. Neither side is broadcast or collected. Equal scores rank by
smaller id, also at the cutoff, where only entries that rank before or at it are sent; so large groups of equal vectors
cost k entries a block.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. Vectors of
another length than a query are compared over the components both have (an empty one scores 0). A repeated id keeps each
of its rows as candidates, and is asked once, with its smallest vector that takes part; rows with the query's own id are
not its candidates. Products are exact: in doubles while they stay below 2**53, in integers of any length beyond; a
partial or whole score that does not fit into 64 bits raises OverflowError. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

VECTOR_BLOCK, QUERY_BLOCK, LISTS = 2048, 1024, 4
_ENTRY = "query_id long, qblock long, vec_id long, score long"
_LONG = range(-(1 << 63), 1 << 63)


def _matrix(vectors: list[list[float]], scale: int) -> np.ndarray:
    """Whole numbers, held exactly in doubles; rows are filled up with zeros."""
    m = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for r, v in enumerate(vectors):
        m[r, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
    if not np.isfinite(m).all():
        raise OverflowError("a scaled component exceeds the range of doubles")
    return m


def _pack(df: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of at most `size` whole vectors in order of id, made where the rows lie: no shuffle."""
    names = ["ids", "mat", "n"]

    def block(rows: list[tuple[int, list[float]]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        ids = np.array([i for i, _ in rows], np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([_matrix([v for _, v in rows], scale).tobytes()], pa.binary()), pa.array([len(rows)], pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[float]]] = []
        for b in batches:
            for i, v in zip(b["vec_id"].to_pylist(), b["embedding"].to_pylist(), strict=True):
                held.append((i, v))
                if len(held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return df.mapInArrow(run, "ids binary, mat binary, n int")


def _pack_by(df: DataFrame, scale: int) -> DataFrame:
    """One block for each qblock; the hash that deals queries keeps blocks near the asked size."""
    rows = df.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = np.array([r["vec_id"] for r in row["rows"]], np.int64).tobytes()
            mat = _matrix([r["embedding"] for r in row["rows"]], scale).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row["qblock"]]), pa.array([ids], pa.binary()), pa.array([mat], pa.binary()), pa.array([len(row["rows"])], pa.int32())], names=["qblock", "q_ids", "q_mat", "q_n"])

    return rows.mapInArrow(run, "qblock long, q_ids binary, q_mat binary, q_n int")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """q times v transposed, exactly, as 64-bit integers."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if q.shape[1] * float(np.abs(q).max()) * float(np.abs(v).max()) < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    out = whole(q) @ whole(v).T
    if int(out.min()) not in _LONG or int(out.max()) not in _LONG:
        raise OverflowError("a score does not fit into 64 bits")
    return out.astype(np.int64)


def _local(row: dict, lists: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Query ids, vector ids, the scores of each list, and where a vector has the query's own id."""
    qi, vi = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, v = np.frombuffer(row["q_mat"], np.float64).reshape(len(qi), -1), np.frombuffer(row["mat"], np.float64).reshape(len(vi), -1)
    cuts = np.linspace(0, min(q.shape[1], v.shape[1]), lists + 1).astype(int)
    return qi, vi, [_product(q[:, a:b], v[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], qi[:, None] == vi[None, :]


def _first(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each row are, equal ones by column (columns are in order of id), those in `own` left out."""
    k = min(scores.shape[1], k + int(own.sum(1).max()))
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    equal = scores == kth
    return ((scores > kth) | equal & (np.cumsum(equal, axis=1) <= k)) & ~own


def _resolved(parts: list[np.ndarray], at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The whole scores of entries."""
    got = [p[at] for p in parts]
    if sum(float(np.abs(g).max()) for g in got if len(g)) < 2.0**62:
        return sum(got)
    exact = [sum(map(int, x)) for x in zip(*got, strict=True)]
    if exact and (min(exact) not in _LONG or max(exact) not in _LONG):
        raise OverflowError("a score does not fit into 64 bits")
    return np.array(exact, np.int64)


def _best(r: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of entries (row, column, score), those that are among the k best of their row."""
    order = np.lexsort((c, np.invert(score), r))  # the complement turns the order of integers round and never overflows
    at = np.arange(len(order)) - np.searchsorted(r[order], r[order])
    return order[at < k]


def _entries(row: dict, qi: np.ndarray, vi: np.ndarray, r: np.ndarray, c: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(np.full(len(r), row["qblock"], np.int64)), pa.array(vi[c]), pa.array(score)], names=["query_id", "qblock", "vec_id", "score"])


def _gather(lists: int, k: int):  # noqa: ANN202
    """Phase 1: of each local list the first k, of those the k of the best whole scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            qi, vi, parts, own = _local(row, lists)
            seen = _first(parts[0], own, k)
            for p in parts[1:]:
                seen |= _first(p, own, k)
            r, c = np.nonzero(seen)
            score = _resolved(parts, (r, c))
            best = _best(r, c, score, k)
            yield _entries(row, qi, vi, r[best], c[best], score[best])

    return run


def _resolve(lists: int, k: int):  # noqa: ANN202
    """Phases 2 and 3: entries that reach the uniform threshold in a list; of those the whole scores and the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            qi, vi, parts, own = _local(row, lists)
            cut = {c["query_id"]: (c["tau"], c["last"]) for c in row["cuts"] or []}
            # without a cutoff (fewer than k entries) everything is sufficient
            told = [cut.get(q, (_LONG[0], _LONG[-1])) for q in qi.tolist()]
            least = np.array([-(-tau // lists) for tau, _ in told], np.int64)[:, None]
            enough = parts[0] >= least
            for p in parts[1:]:
                enough |= p >= least
            enough |= np.array([q not in cut for q in qi.tolist()], bool)[:, None]
            r, c = np.nonzero(enough & ~own)
            score = _resolved(parts, (r, c))
            tau, last = (np.array(x, np.int64)[r] for x in zip(*told, strict=True))
            good = np.flatnonzero((score > tau) | (score == tau) & (vi[c] <= last))
            best = good[_best(r[good], c[good], score[good], k)]
            yield _entries(row, qi, vi, r[best], c[best], score[best])

    return run


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    """The first k of each query; Spark prunes to k a query in each task before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _each(column: str, n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(column)


def topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, lists: int = LISTS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query (fewer, if there are fewer)."""
    spark = vectors.sparkSession
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", usable))
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = common.cut(asked)
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_qblocks = -(-n_queries // query_block)
    qb = common.cut(_pack_by(asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(n_qblocks))), scale))
    vb = common.cut(_pack(vectors, vector_block, scale))
    # a grid of about four cells a core, as square as the blocks allow: each vector block is copied once a group of
    # query blocks, each query block once a share of the vector blocks
    cells, n_vblocks = 4 * spark.sparkContext.defaultParallelism, vb.count()
    groups = max(1, min(n_qblocks, round(math.sqrt(cells * n_qblocks / max(1, n_vblocks)))))
    slots = max(1, min(n_vblocks, -(-cells // groups)))
    grid_v = vb.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots))).select("*", _each("qgroup", groups))
    grid_q = lambda q: q.withColumn("qgroup", F.pmod("qblock", F.lit(groups))).select("*", _each("slot", slots))
    gathered = grid_v.join(grid_q(qb), ["qgroup", "slot"]).mapInArrow(_gather(lists, k), _ENTRY)
    # the k-th best so far; a query has none where fewer than k were found
    kth = _ranked(gathered, k).where(F.col("rank") == k)
    cuts = kth.groupBy("qblock").agg(F.collect_list(F.struct("query_id", F.col("score").alias("tau"), F.col("vec_id").alias("last"))).alias("cuts"))
    told = qb.join(common.cut(cuts), "qblock", "left")
    found = grid_v.join(grid_q(told), ["qgroup", "slot"]).mapInArrow(_resolve(lists, k), _ENTRY)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
