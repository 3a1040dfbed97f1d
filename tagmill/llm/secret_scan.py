"""Secret scans with multipart credential linking.

Every text is searched for base secrets (assignments, access identifiers, long hex runs), which are always reported,
and for weak candidates (user or client identifiers, high-entropy tokens, endpoints), which alone mean little. Within
a scope (a paragraph, and no more than `reach` code points apart) an interval join sets weak candidates against
parts of the other kinds; a weak candidate is reported only if a complementary part stands in its scope:

* identifier: with a secret (base or weak);
* weak secret: with an identifier (base or weak), or with an endpoint and a base secret;
* endpoint: with both an identifier and a secret, or with a base secret (assignment or hex run).

Each row stands alone, so the scan has no shuffle and no memory beyond one batch of texts. A null text counts as
empty; an empty text has no spans; repeated rows give repeated results; texts of any length are scanned whole, in time
n log n; extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
REACH = 400

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENT = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account_?(?:id|name)|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})|\b(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s\"'<>]{4,}|\b[a-z0-9.-]+\.amazonaws\.com\b", re.I | re.A)
_BREAK = re.compile(r"\n[ \t\r]*\n")
_HINT = re.compile(r"pass|secret|token|api", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12] if _HINT.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _mixed(s: str) -> bool:
    """Digits, lower and upper case, many different characters: unlike a word or a path."""
    return bool(re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s)) and len(set(s)) >= 12


def _overlaps(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether any of the spans meets a given one: of those that start before its end, does the furthest reach past its start?"""
    spans = sorted(spans)
    starts, furthest = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))
    return lambda a, b: (k := bisect.bisect_left(starts, b)) > 0 and furthest[k - 1] > a


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    taken = _overlaps([(a, b) for a, b, _ in base])
    found = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if "://" in text or "amazonaws" in text else []
    found += [(m.start(), m.end(), "ident") for m in _IDENT.finditer(text)] if ":" in text or "=" in text or "A" in text else []
    found += [(m.start(), m.end(), "key") for m in _KEY.finditer(text) if _mixed(m[0])]
    free = [x for x in found if not taken(x[0], x[1])]
    ends = _overlaps([(a, b) for a, b, k in free if k == "endpoint"])
    return [x for x in free if x[2] == "endpoint" or not ends(x[0], x[1])]


_PART = {"assign": "secret", "hex": "secret", "key": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}


def link(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak spans whose scope holds complementary parts. Neighbours are found in lists sorted by start."""
    if not weak or not (base or len(weak) > 1):
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    starts: dict[str, list[int]] = {}
    for a, b, k in base + weak:
        for part in {_PART[k], "strong" if k in ("assign", "hex") else _PART[k]}:
            starts.setdefault(part, []).append(a)
    for x in starts.values():
        x.sort()

    def near(span: tuple[int, int, str], part: str) -> bool:
        at = bisect.bisect(breaks, span[0])
        low = max(span[0] - reach, breaks[at - 1] if at else 0)
        high = min(span[1] + reach, breaks[at] if at < len(breaks) else len(text))
        x = starts.get(part, [])
        return bisect.bisect_right(x, high) - bisect.bisect_left(x, low) - (part == _PART[span[2]]) > 0

    kept = []
    for s in weak:
        if s[2] == "ident":
            ok = near(s, "secret")
        elif s[2] == "key":
            ok = near(s, "ident") or near(s, "endpoint") and near(s, "strong")
        else:
            ok = near(s, "secret") and near(s, "ident") or near(s, "strong")
        if ok:
            kept.append(s)
    return kept


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_text(text: str | None, reach: int = REACH) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those that linking adds."""
    text = text or ""
    base = base_spans(text)
    return base, link(text, base, weak_spans(text, base), reach)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row for each row of docs (doc_id, text), in the columns of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                base, more = scan_text(t, reach)
                n = [sum(k == x for _, _, k in base) for x in KINDS[:3]]
                rows.append((i, *n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int64()] * 5 + [pa.string()] * 2, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
