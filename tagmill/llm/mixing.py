"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are dealt into blocks of `block_rows`. With weight w, the i-th block of a source is released
at slot floor(i / w) and due at ceil((i + 1) / w); each slot takes the released block that is due first. So at any
slot a source has had its weight's share of the slots to within less than one block.

Weights are taken exactly as given, as ratios of integers, so the deviation does not grow with the data. The slots are
computed on the driver, one step and eight bytes a block. When a source runs out, its weight goes to the others in
proportion and a new phase begins; every row appears exactly once, none is dropped or repeated, and within each phase
the deviation stays below one block.

Rows are numbered within their source without gathering a source: they fall into hash buckets of about a thousand rows,
are numbered in each bucket, and the buckets' counts (at most 65,536 a source) are summed up. Blocks meet
their slots in a broadcast join, above `broadcast_entries` blocks in an ordinary one.

`weights` maps sources to positive numbers, the shares wanted; tempered() makes them from the sources' sizes, with
exponent 1/2 where none are given. A source that
`weights` does not name, or names with nothing, comes after the named ones are used up. A null source is a source of its
own. Repeated rows are rows of their own. Texts of any length are only hashed. Empty tables give an empty result. A column
with the name of an output (block, slot, place) is replaced by it; others pass unchanged. At most `max_sources` sources are allowed
(the table of sources is read by the driver); more raise an error.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS, PERIOD, MAX_SOURCES, BROADCAST_ENTRIES, PIECE = 16, 1000, 2000, 1_000_000, 1_000_000


def quotas(weights: dict[int, float], period: int = PERIOD) -> dict[int, int]:
    """Integers of at least 1 in proportion to the weights, by largest remainders; their sum is the period."""
    total, period = sum(weights.values()), max(period, 4 * len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: max(0, period - sum(out.values()))]:
        out[s] += 1
    return out


def whole(weights: dict[int, float], period: int = PERIOD) -> dict[int, int]:
    """Integers in exactly the proportion of the weights: small ones that sum to the period where there are such."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    small, total = quotas(weights, period), sum(exact.values())
    if all(small[s] * total == exact[s] * sum(small.values()) for s in exact):
        return small
    scale = math.lcm(*[x.denominator for x in exact.values()])
    return {s: int(x * scale) for s, x in exact.items()}


def pfair(quota: dict[int, int], left: dict[int, int]) -> dict[int, array]:
    """The slots of each source's blocks until a source has had its `left` blocks: earliest deadline first among the released."""
    length = sum(quota.values())
    waiting = [(0, s, 0) for s in quota]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # by deadline
    slots = {s: array("q") for s in quota}
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * length // quota[s]), s, i))
        # the weights sum to one, so some block is always released
        _, s, i = heapq.heappop(ready)
        slots[s].append(t)
        t += 1
        if i + 1 == left[s]:
            return slots
        heapq.heappush(waiting, ((i + 1) * length // quota[s], s, i + 1))


def pfair_period(quota: dict[int, int]) -> dict[int, list[int]]:
    """The slots of each source's blocks in one period of sum(quota) slots."""
    slots: dict[int, list[int]] = {s: [] for s in quota}
    run = pfair(quota, {s: 2 * n + 2 for s, n in quota.items()})
    for s, ts in run.items():
        slots[s] = [t for t in ts if t < sum(quota.values())]
    return slots


def phases(blocks: dict[int, int], weights: dict[int, float], period: int = PERIOD) -> dict[int, array]:
    """The slot of each block of each source, over all phases."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out = {s: array("q") for s in blocks}
    base = 0
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1.0)
        run = pfair(whole(active, period), left)
        for s, ts in run.items():
            out[s].extend(base + t for t in ts)
            left[s] -= len(ts)
        left = {s: n for s, n in left.items() if n > 0}
        base += sum(map(len, run.values()))
    return out


def _table(spark: SparkSession, plan: dict[int, array]) -> DataFrame:
    """(_k, block, slot) of a plan; long plans go to the shared folder in pieces."""
    pieces = [(s, at) for s, ts in plan.items() for at in range(0, len(ts), PIECE)]
    schema = "_k int, block long, slot long"
    frames, batch = [], []

    def flush() -> None:
        if batch:
            df = spark.createDataFrame(pa.concat_tables(batch), schema)
            frames.append(df if len(pieces) == len(batch) and sum(map(len, batch)) <= PIECE else common.stored(df))
            batch.clear()

    for s, at in pieces:
        part = plan[s][at : at + PIECE]
        batch.append(pa.table({"_k": pa.array(np.full(len(part), s, np.int32)), "block": np.arange(at, at + len(part)), "slot": np.frombuffer(part, np.int64)}))
        if sum(map(len, batch)) >= PIECE:
            flush()
    flush()
    return reduce(DataFrame.union, frames) if frames else spark.createDataFrame([], schema)


def _sizes(docs: DataFrame, max_sources: int) -> list[Row]:
    sizes = docs.groupBy("source").count().limit(max_sources + 1).collect()
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return sizes


def tempered(docs: DataFrame, exponent: float = 0.5, max_sources: int = MAX_SOURCES) -> dict[str | None, float]:
    """Target weights from the sources' row counts: exponent 1 keeps their proportions, 0 makes them equal."""
    sizes = _sizes(docs, max_sources)
    total = sum(r["count"] ** exponent for r in sizes)
    return {r["source"]: r["count"] ** exponent / total for r in sizes}


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, max_sources: int = MAX_SOURCES, broadcast_entries: int = BROADCAST_ENTRIES, by: Column | None = None) -> DataFrame:
    """docs with block, slot and place added: the order of the mix is (slot, place). Rows of a source come in the order of `by`, a
    hash (of doc_id and text if not given), so that docs may come without text."""
    spark = docs.sparkSession
    sizes = _sizes(docs, max_sources)
    sizes.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    blocks = {k: -(-r["count"] // block_rows) for k, r in enumerate(sizes)}
    weights = {r["source"]: math.sqrt(r["count"]) for r in sizes} if weights is None else weights
    wanted = {k: max(0.0, float(weights.get(r["source"], 0.0))) for k, r in enumerate(sizes)}
    plan = phases(blocks, wanted, period)
    entries = sum(map(len, plan.values()))
    schedule = _table(spark, plan)
    names = spark.createDataFrame([(r["source"], k) for k, r in enumerate(sizes)], "_source string, _k int")
    buckets = max(1, min(65536, sum(r["count"] for r in sizes) // 1000))
    outputs = ("block", "slot", "place")
    keyed = docs.select("source", "doc_id", common.boxed(docs, *outputs), (F.xxhash64("doc_id", "text") if by is None else by).alias("_h")).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(buckets)))
    counts = keyed.groupBy("source", "_b").count()
    before = counts.select(F.col("source").alias("_s"), F.col("_b").alias("_c"), (F.sum("count").over(Window.partitionBy("source").orderBy("_b")) - F.col("count")).alias("_before"))
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id")) - 1)
    at = numbered.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))).withColumn("_n", (F.col("_n") + F.col("_before")).cast("long"))
    told = at.withColumn("block", F.expr(f"_n div {block_rows}")).withColumn("place", (F.col("_n") % block_rows).cast("int"))
    side = F.broadcast(schedule) if entries <= broadcast_entries else schedule
    told = told.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source"))).join(side, ["_k", "block"])
    return told.select(*common.unboxed(docs, *outputs), *outputs)
