"""Tokens, grammar and rules."""

from __future__ import annotations

import pytest

from tagmill.lang.nodes import Both, Compare, Either, Literal, Not, TagIs
from tagmill.lang.parser import SyntaxFault, parse
from tagmill.lang.tokens import CommandError, Token, tokenize
from tagmill.lang.validate import read

BAD = "Unrecognized character or invalid command"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("LOC:CA", [Token("word", "loc"), Token("sym", ":"), Token("word", "ca")]),
        ('k:"A b"', [Token("word", "k"), Token("sym", ":"), Token("text", "A b")]),
        ("Where AND", [Token("keyword", "where"), Token("keyword", "and")]),
        ("sandy", [Token("word", "sandy")]),
        ("007", [Token("number", 7)]),
        ("-5", [Token("word", "-5")]),
        ("99.99", [Token("word", "99.99")]),
        ('"5"', [Token("text", "5")]),
        ("9223372036854775807", [Token("number", 2**63 - 1)]),
        ("a>=1", [Token("word", "a"), Token("sym", ">="), Token("number", 1)]),
        ("\ta\r\n", [Token("word", "a")]),
    ],
)
def test_tokens(text, want):
    assert tokenize(text) == want


@pytest.mark.parametrize("text", ["", "a;b", 'k:"open', 'k:""', "9223372036854775808", "1" * 20, "a" * 129, '"' + "a" * 129 + '"', "a " * 1025, "( " * 257, 'k:"a\\"b"', "é", "a!b", "k:$"])
def test_bad_tokens(text):
    with pytest.raises(CommandError, match=BAD):
        tokenize(text)


def test_limits_are_allowed():
    assert len(tokenize("( " * 256)) == 256
    assert tokenize("a" * 128)[0].value == "a" * 128


def where(text):
    return parse(f"QUERY in:a where:({text})").get("where")


A, B, C = (TagIs(k, "x") for k in "abc")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a:x", A),
        ("a:x AND b:x OR c:x", Either(Both(A, B), C)),
        ("a:x OR b:x AND c:x", Either(A, Both(B, C))),
        ("(a:x OR b:x) AND c:x", Both(Either(A, B), C)),
        ("a:x OR b:x OR c:x", Either(Either(A, B), C)),
        ("NOT a:x AND b:x", Both(Not(A), B)),
        ("NOT NOT a:x", Not(Not(A))),
        ("NOT (a:x OR b:x)", Not(Either(A, B))),
        ("k > 5", Compare(">", Literal("k"), Literal(5))),
        ("5 <= k", Compare("<=", Literal(5), Literal("k"))),
        ("NOT ts > 5", Compare(">", Not(Literal("ts")), Literal(5))),
        ("a:x AND k != 5", Both(A, Compare("!=", Literal("k"), Literal(5)))),
        ("entity:12", TagIs("entity", 12, True)),
        ('a:"count"', TagIs("a", "count")),
    ],
)
def test_grammar(text, want):
    assert where(text) == want


def test_not_may_be_followed_by_more_tags():
    """Q7: an expression that begins with NOT does not swallow the tags after it."""
    c = parse("QUERY in:a where:(NOT a:x) take:5")
    assert c.get("where") == Not(A)
    assert c.get("take") == 5


@pytest.mark.parametrize("text", ["(a:x", "a:x)", "", "a:x b:x", "AND a:x", "a:x AND", "a:", "count:5", "a:count", '"k":x', "a:x ) ("])
def test_bad_expressions(text):
    with pytest.raises(SyntaxFault, match="Syntax error"):
        read(f"QUERY in:a where:({text})")


@pytest.mark.parametrize("text", ["HELLO in:a", "EVENT", "event in", "EVENT in:a entity:b loc", "EVENT in:a entity:b 5:c", "EVENT in:a id:5", "QUERY in:a where:loc:ca", "EVENT in:a entity:b " + " ".join(f"k{i}:1" for i in range(33)), "EVENT in:a entity:" + "e" * 63])
def test_bad_commands(text):
    with pytest.raises(CommandError, match="Syntax error"):
        read(text)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("INDEX in:a key:b", "Indexing specific containers is not supported yet. Indexes apply globally to new data containers."),
        ("EVENT in:a in:b entity:c", "Duplicate `in` tags not yet supported"),
        ('EVENT in:"a b" entity:c', "Invalid container name"),
        ("EVENT in:a.b entity:c", "Invalid container name"),
        ("EVENT in:5 entity:c", "Invalid container name"),
        ("EVENT in:system entity:c", "Invalid container name"),
        (f"EVENT in:{'n' * 65} entity:c", "Invalid container name"),
        ("EVENT in:a entity:b where:(c:d)", "`where` tag only supported for queries"),
        ("QUERY in:a where:(c:d) where:(c:d)", "Duplicate `where` tag"),
        ("QUERY in:a entity:b where:(c:d)", "Unexpected `entity` tag"),
        ("EVENT in:a entity:b entity:c", "Duplicate `entity` tag"),
        ("EVENT in:a entity:b take:5", "Unexpected `take` tag"),
        ("QUERY in:a where:(c:d) take:x", "Value of `take` tag must be numeric"),
        ("QUERY in:a where:(c:d) take:0", "Value of `take` tag must be positive"),
        ("QUERY in:a where:(c:d) take:1 take:2", "Duplicate `take` tag"),
        ("QUERY in:a where:(c:d) cursor:x", "Value of `cursor` tag must be numeric"),
        ("QUERY in:a where:(c:d) cursor:0", "Value of `cursor` tag must be positive"),
        ("EVENT in:a entity:b cursor:5", "Unexpected `cursor` tag"),
        ("QUERY in:a where:(c:d) key:x", "Unexpected `key` tag"),
        ("INDEX key:a key:b", "Duplicate `key` tag"),
        ("QUERY in:a where:(c:d) loc:ca", "Unexpected tag"),
        ("EVENT in:a entity:b c:1 C:2", "Duplicate tag"),
        ("EVENT entity:b", "`in` tag is required"),
        ("EVENT in:a c:1", "`entity` tag is required"),
        ("QUERY in:a take:1", "`where` tag is required"),
        ("INDEX loc:ca", "Unexpected tag"),
        ("QUERY in:a where:(NOT ts > 5)", "Invalid comparison"),
        ("QUERY in:a where:(a > b)", "Invalid comparison types"),
        ("QUERY in:a where:(1 > 2)", "Invalid comparison types"),
        ("QUERY in:a where:(a:b > 2)", "Invalid comparison"),
        ("QUERY in:a where:(loc)", "Unexpected literal"),
        ("QUERY in:a where:(a:b AND 5)", "Unexpected literal"),
    ],
)
def test_rules(text, message):
    with pytest.raises(CommandError) as e:
        read(text)
    assert str(e.value) == message


@pytest.mark.parametrize("text", ["event IN:a ENTITY:B x:1", "QUERY take:5 where:(a:b) in:c cursor:9", "INDEX key:price", 'EVENT in:a entity:5 "My key":v', f"EVENT in:{'n' * 64} entity:{'e' * 62}"])
def test_accepted(text):
    read(text)
