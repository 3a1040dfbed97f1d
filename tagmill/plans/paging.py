"""Keyset pages in order of event id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .numbering import dense_numbers

DEFAULT_TAKE = 5000
#: Up to so many rows a page is a top-k; a larger one stays spread over partitions that are in order of id.
TOP = 100_000


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: int | None


def _hits(events: DataFrame, where: Column, cursor: int | None) -> DataFrame:
    return events.where(where) if cursor is None else events.where(where & (F.col("id") >= cursor))


def _numbered(hits: DataFrame, name: str) -> DataFrame:
    """hits with 1, 2, ... in order of id, by ranges of ids: nothing is gathered."""
    return dense_numbers(hits.withColumn("_all", F.lit(0)), "_all", ["id"], name).drop("_all")


def page_frame(events: DataFrame, where: Column, take: int | None = None, cursor: int | None = None) -> DataFrame:
    """The page's rows. Predicates and cursor reach the scan; the order and limit are one top-k per task and a merge."""
    n = take or DEFAULT_TAKE
    hits = _hits(events, where, cursor)
    if n <= TOP:
        return hits.orderBy("id").limit(n)
    return _numbered(hits, "_place").where(F.col("_place") <= n).drop("_place")


def pages_frame(events: DataFrame, where: Column, take: int = DEFAULT_TAKE) -> DataFrame:
    """All rows with the number of their page: what following the cursors gives, in one scan."""
    return _numbered(_hits(events, where, None), "_place").withColumn("page", F.expr(f"cast((_place - 1) div {take} as int)")).drop("_place")


def page(events: DataFrame, where: Column, take: int | None = None, cursor: int | None = None) -> Page:
    """One row more than asked for is fetched: its id is where the next page begins (cursors are inclusive).

    For responses: the page's rows come to the driver. Larger results are page_frame()'s."""
    n = take or DEFAULT_TAKE
    rows = sorted(page_frame(events, where, n + 1, cursor).collect(), key=lambda r: r["id"])
    return Page(rows[:n], rows[n]["id"] if len(rows) > n else None)
