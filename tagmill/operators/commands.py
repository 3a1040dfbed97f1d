"""QUERY, EVENT and INDEX over an event store, and what a client gets back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from tagmill.functions.predicates import Layout, predicate
from tagmill.lang.nodes import Command
from tagmill.lang.tokens import CommandError
from tagmill.plans.paging import Page, page, page_frame
from tagmill.sources.store import EventStore, now_ms
from tagmill.sources.wire import packed


def query_frame(command: Command, events: DataFrame, layout: Layout) -> DataFrame:
    """The rows of a QUERY's page, as a plan."""
    return page_frame(events, predicate(command.get("where"), layout), command.get("take"), command.get("cursor"))


def query_page(command: Command, events: DataFrame, layout: Layout) -> Page:
    return page(events, predicate(command.get("where"), layout), command.get("take"), command.get("cursor"))


def matches(command: Command, events: DataFrame, layout: Layout) -> DataFrame:
    """All rows that the expression selects, without order or limit."""
    return events.where(predicate(command.get("where"), layout))


def event_pairs(row: Row, ns: str) -> list[tuple[str, str | int]]:
    """An event's fields as they go over the wire: id, in, entity, ts, then its tags in the order they were given.

    A tag named like a fixed field comes too, as a second pair of that name."""
    r = row.asDict()
    fixed = [("id", r["id"]), ("in", ns), ("entity", r["entity_i64"] if r["entity_str"] is None else r["entity_str"]), ("ts", r["ts"])]
    tags, numbers = r.get("tags") or {}, r.get("tags_i64") or {}
    return fixed + [(k, numbers.get(k, tags.get(k))) for k in r.get("tag_order") or sorted(tags)]


def event_object(row: Row, ns: str) -> dict:
    """An event as a dictionary; of two pairs of one name the fixed field stays, the tag is found by its filter."""
    out: dict = {}
    for k, v in event_pairs(row, ns):
        out.setdefault(k, v)
    return out


@dataclass(frozen=True)
class Result:
    """status OK or ERR, with the page of a query or the message of an error."""

    error: str | None = None
    objects: list[dict] | None = None
    next_cursor: int | None = None
    ids: list[int] = field(default_factory=list)
    pairs: list[list[tuple[str, str | int]]] = field(default_factory=list)

    def response(self) -> dict:
        if self.error is not None:
            return {"status": "ERR", "data": {"err_msg": self.error}}
        if self.objects is None:
            return {"status": "OK"}
        cursor = {} if self.next_cursor is None else {"next_cursor": self.next_cursor}
        return {"status": "OK", "data": cursor | {"objects": self.objects}}


    def wire(self) -> bytes:
        """The response in MessagePack, field by field in order."""
        if self.objects is None:
            return packed(self.response())
        cursor = [] if self.next_cursor is None else [("next_cursor", self.next_cursor)]
        return packed([("status", "OK"), ("data", [*cursor, ("objects", tuple(self.pairs))])])

    def wire_ids(self) -> bytes:
        """The ids alone, as a list response."""
        return packed([("status", "OK"), ("data", [("ids", tuple(self.ids))])])


def run_query(store: EventStore, command: Command) -> Result:
    ns = str(command.get("in"))
    if not store.has(ns):
        raise CommandError("Container does not exist")
    events, layout = store.table(ns)
    got = query_page(command, events, layout)
    return Result(objects=[event_object(r, ns) for r in got.rows], next_cursor=got.next_cursor, ids=[r["id"] for r in got.rows], pairs=[event_pairs(r, ns) for r in got.rows])


def run_events(store: EventStore, lines: list[str], batch: str, arrival: int | None = None) -> Result:
    """Append EVENT lines as one batch; the first refused line's error is the result, the others are stored."""
    at = now_ms() if arrival is None else arrival
    rows = [(line, at, "client", k) for k, line in enumerate(lines)]
    bad = store.append(store.spark.createDataFrame(rows, "line string, arrival long, source string, pos long"), batch).orderBy("pos").limit(1).collect()
    return Result(error=bad[0]["error"] if bad else None)


def run_index(store: EventStore, command: Command) -> Result:
    store.add_index(str(command.get("key")))
    return Result()
