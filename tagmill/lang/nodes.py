"""What a parsed command is made of."""

from __future__ import annotations

from dataclasses import dataclass

Value = str | int


@dataclass(frozen=True)
class Literal:
    value: Value


@dataclass(frozen=True)
class TagIs:
    """key:value. reserved marks entity:, which reads the entity columns."""

    key: str
    value: Value
    reserved: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Both:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Either:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    inner: Expr


Expr = Literal | TagIs | Compare | Both | Either | Not


@dataclass(frozen=True)
class Tag:
    """One key:value of a command; value is an expression for where."""

    key: str
    value: Value | Expr
    reserved: bool


@dataclass(frozen=True)
class Command:
    kind: str
    tags: tuple[Tag, ...]

    def get(self, key: str) -> Value | Expr | None:
        return next((t.value for t in self.tags if t.reserved and t.key == key), None)

    def custom(self) -> list[Tag]:
        return [t for t in self.tags if not t.reserved]
