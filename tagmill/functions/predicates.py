"""From expressions to predicates that are never null, so that NOT is a true complement."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.lang.nodes import Both, Compare, Either, Expr, Literal, Not, TagIs, Value
from tagmill.lang.tokens import CommandError

_FLIPPED = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "=": "=", "!=": "!="}
_APPLY: dict[str, Callable[[Column, int], Column]] = {
    ">": lambda c, n: c > n,
    ">=": lambda c, n: c >= n,
    "<": lambda c, n: c < n,
    "<=": lambda c, n: c <= n,
    "=": lambda c, n: c == n,
    "!=": lambda c, n: c != n,
}


@dataclass(frozen=True)
class Layout:
    """Where a table keeps what predicates read.

    text_tags and number_tags name top-level columns of hot tags, which Parquet can prune by; other tags are read from
    the map `tags` (if the table has one). indexes maps index keys to integer columns; ts is always among them.
    """

    text_tags: Mapping[str, str] = field(default_factory=dict)
    number_tags: Mapping[str, str] = field(default_factory=dict)
    indexes: Mapping[str, str] = field(default_factory=dict)
    has_map: bool = True

    def tag_is(self, key: str, value: Value) -> Column:
        text = str(value)
        if key in self.number_tags:
            canonical = text.isascii() and text.isdigit() and text == str(int(text)) and int(text) < 2**63
            return F.col(self.number_tags[key]).eqNullSafe(F.lit(int(text)).cast("long")) if canonical else F.lit(False)
        if key in self.text_tags:
            return F.col(self.text_tags[key]).eqNullSafe(F.lit(text))
        return F.col("tags").getItem(key).eqNullSafe(F.lit(text)) if self.has_map else F.lit(False)

    def index(self, key: str) -> Column:
        if key == "ts":
            return F.col("ts")
        if key not in self.indexes:
            raise CommandError("Index does not exist for tag key.")
        return F.col(f"`{self.indexes[key]}`")


def entity_is(value: Value) -> Column:
    """Entities, unlike tags, tell the string "5" from the number 5."""
    return F.col("entity_i64").eqNullSafe(F.lit(value).cast("long")) if isinstance(value, int) else F.col("entity_str").eqNullSafe(F.lit(value))


def predicate(e: Expr, layout: Layout) -> Column:
    match e:
        case TagIs(_, value, True):
            return entity_is(value)
        case TagIs(key, value, _):
            return layout.tag_is(key, value)
        case Both(left, right):
            return predicate(left, layout) & predicate(right, layout)
        case Either(left, right):
            return predicate(left, layout) | predicate(right, layout)
        case Not(inner):
            return ~predicate(inner, layout)
        case Compare(op, Literal(str() as key), Literal(int() as n)):
            return compared(op, layout.index(key), n)
        case Compare(op, Literal(int() as n), Literal(str() as key)):
            return compared(_FLIPPED[op], layout.index(key), n)
    raise CommandError("Unknown or unsupported system tag")


def compared(op: str, column: Column, n: int) -> Column:
    """An absent value matches no comparison, != included: false AND null is false, so this is never null, and both
    conjuncts can be pushed into a Parquet scan."""
    return column.isNotNull() & _APPLY[op](column, F.lit(n).cast("long"))
