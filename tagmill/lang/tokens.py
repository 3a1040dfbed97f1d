"""Splitting a command into tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_COMMAND, MAX_TOKENS, MAX_TEXT, MAX_DIGITS = 2048, 256, 128, 19
INT64_MAX = 2**63 - 1
KEYWORDS = frozenset("and or not event query index in id entity cursor take where by having count key".split())

_SCAN = re.compile(r"""(?P<gap>[ \t\n\v\f\r]+)|(?P<sym>>=|<=|!=|[()<>=:])|"(?P<quoted>[A-Za-z0-9_. -]*)"|(?P<bare>[A-Za-z0-9_.-]+)""", re.A)


class CommandError(ValueError):
    """A command that is refused; the text is what a client is told."""


@dataclass(frozen=True)
class Token:
    """kind: word, text (quoted), number, keyword or sym; value: the string or integer."""

    kind: str
    value: str | int


def tokenize(command: str) -> list[Token]:
    """Tokens of a command. Unquoted words are folded to lower case, all-digit ones are integers."""
    size = len(command.encode("utf-8", "replace"))
    if not size or size > MAX_COMMAND:
        raise CommandError("Unrecognized character or invalid command")
    out: list[Token] = []
    at = 0
    while at < len(command):
        m = _SCAN.match(command, at)
        if not m:
            raise CommandError("Unrecognized character or invalid command")
        at = m.end()
        if m["gap"]:
            continue
        if m["sym"]:
            out.append(Token("sym", m["sym"]))
        elif m["quoted"] is not None:
            if not 0 < len(m["quoted"]) <= MAX_TEXT:
                raise CommandError("Unrecognized character or invalid command")
            out.append(Token("text", m["quoted"]))
        else:
            out.append(_word(m["bare"]))
        if len(out) > MAX_TOKENS:
            raise CommandError("Unrecognized character or invalid command")
    return out


def _word(raw: str) -> Token:
    if len(raw) > MAX_TEXT:
        raise CommandError("Unrecognized character or invalid command")
    if raw.isdigit():
        if len(raw) > MAX_DIGITS or int(raw) > INT64_MAX:
            raise CommandError("Unrecognized character or invalid command")
        return Token("number", int(raw))
    low = raw.lower()
    return Token("keyword" if low in KEYWORDS else "word", low)
