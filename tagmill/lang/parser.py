"""Grammar: COMMAND (key ':' value)+, with an infix expression in parentheses after where.

Binding, strongest first: NOT, comparisons, AND, OR; all but NOT group to the left.
"""

from __future__ import annotations

from .nodes import Both, Command, Compare, Either, Expr, Literal, Not, Tag, TagIs
from .tokens import CommandError, Token, tokenize

MAX_CUSTOM_TAGS, MAX_ENTITY = 32, 62
_STRENGTH = {"or": 1, "and": 2} | dict.fromkeys((">", ">=", "<", "<=", "=", "!="), 3)
_RESERVED = frozenset(("in", "entity", "where", "take", "cursor", "key"))


class SyntaxFault(CommandError):
    """Clients are told "Syntax error"; `detail` says more."""

    def __init__(self, detail: str):
        super().__init__("Syntax error")
        self.detail = detail


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self, detail: str) -> Token:
        if (t := self.peek()) is None:
            raise SyntaxFault(detail)
        self.at += 1
        return t

    def take(self, sym: str) -> bool:
        if (t := self.peek()) and t.kind == "sym" and t.value == sym:
            self.at += 1
            return True
        return False

    def expression(self, least: int = 1) -> Expr:
        left = self.operand()
        while (t := self.peek()) and t.kind in ("sym", "keyword") and _STRENGTH.get(str(t.value), 0) >= least:
            self.at += 1
            right = self.expression(_STRENGTH[str(t.value)] + 1)
            left = Both(left, right) if t.value == "and" else Either(left, right) if t.value == "or" else Compare(str(t.value), left, right)
        return left

    def operand(self) -> Expr:
        if self.take("("):
            inner = self.expression()
            if not self.take(")"):
                raise SyntaxFault("Mismatched parentheses")
            return inner
        t = self.next("Mismatched parentheses")
        if t == Token("keyword", "not"):
            return Not(self.operand())
        if t.kind == "number":
            return Literal(t.value)
        if t.kind == "word" or t == Token("keyword", "entity"):
            if self.take(":"):
                v = self.next("Unexpected end of query after tag key")
                if v.kind not in ("word", "text", "number"):
                    raise SyntaxFault("Invalid tag value. Expected identifier, string, or number.")
                return TagIs(str(t.value), v.value, t.kind == "keyword")
            if t.kind == "word":
                return Literal(t.value)
        raise SyntaxFault("Unexpected token, expected operand.")


def _tag(r: _Reader) -> Tag:
    if len(r.tokens) - r.at < 3:
        raise SyntaxFault("Invalid tag")
    key = r.next("Invalid tag")
    reserved = key.kind == "keyword"
    if key.kind not in ("word", "text") and not (reserved and key.value in _RESERVED):
        raise SyntaxFault("Invalid tag")
    if not r.take(":"):
        raise SyntaxFault("Invalid tag")
    if reserved and key.value == "where":
        if not r.take("("):
            raise SyntaxFault("Expression must start with '('")
        inner = r.expression()
        if not r.take(")"):
            raise SyntaxFault("Mismatched parentheses")
        return Tag("where", inner, True)
    value = r.next("Invalid tag")
    if value.kind not in ("word", "text", "number"):
        raise SyntaxFault("Invalid tag")
    if reserved and key.value == "entity" and len(str(value.value)) > MAX_ENTITY and value.kind != "number":
        raise SyntaxFault("Invalid tag")
    return Tag(str(key.value), value.value, reserved)


def parse_tokens(tokens: list[Token]) -> Command:
    if not tokens or tokens[0].kind != "keyword" or tokens[0].value not in ("event", "query", "index"):
        raise SyntaxFault("Invalid command!")
    r = _Reader(tokens)
    kind = str(r.next("Invalid command!").value)
    if r.peek() is None:
        raise SyntaxFault("Invalid input: no key-value tags")
    tags: list[Tag] = []
    while r.peek() is not None:
        tags.append(_tag(r))
        if sum(not t.reserved for t in tags) > MAX_CUSTOM_TAGS:
            raise SyntaxFault("Too many custom tags!")
    return Command(kind, tuple(tags))


def parse(command: str) -> Command:
    return parse_tokens(tokenize(command))
