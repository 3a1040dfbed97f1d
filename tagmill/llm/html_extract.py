"""Main text of web pages.

Pages are cut into blocks by one pass over their tags, and what is known of them is written once. Elements whose tag,
role or whole class name says what they are (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments) go; a class name that merely contains such a word says nothing. What stands inside <article> stays, or inside
<main> where there is no article; of several articles the longest, as the others are teasers. Where a page names no main
part, its remaining blocks are open, and the suffixes of their token streams decide: the streams of all pages of a host
are read as one sequence, suffixes are ordered by their first `span` tokens, and what begins suffixes of three distinct
page contents is boilerplate: copies of a page count once, and a passage that two pages quote stays. Tokens of a block under a repeated substring of `span` tokens or more are removed, and so
is a block that lies whole under repeats which go on in its neighbours; unique runs stay, a repeated heading among them.

The suffix order is made by a distributed aggregation on (host, first `span` tokens), which yields exactly the
neighbours whose common prefix has `span` tokens or more; the union of such windows is the union of all longer repeats. A
host with a third of all pages is summed before the shuffle, and no host is gathered in one task. Marked main text is never
touched by it: pages of a host may well quote one article, and its text is wanted on each.

Null html counts as empty and gives an empty text. Repeated rows give repeated results; a page counts once against
itself. Any length is parsed whole. Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, CONTENTS = 8, 3
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "datalist", "label"} | _RAW
_BLOCK = {"html", "body", "address", "article", "blockquote", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"} | _DROP
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Class and id names that say what an element is, also with "site-", "page-", "main-" or "top-" before them. Fixed values.
_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "comment", "comments", "respond", "disqus", "replies", "reply", "pagination", "pager", "toolbar", "skip", "cookie-banner", "cookie-notice", "cookie-consent", "ad-banner", "ad-slot", "share-bar", "share-buttons", "social-links", "related-posts", "related-articles", "comment-list", "comment-form", "newsletter-signup", "skip-link", "nav-menu", "nav-bar", "side-bar"}
_BEFORE = re.compile(r"^(?:site|page|main|top|global)[-_]")
_SPACE = re.compile(r"\s+")
# what an opening tag closes: an open <p>, <li>, ... that HTML lets go unclosed
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"article", "main", "section", "div", "body", "html", "ul", "ol", "table", "aside", "nav", "header", "footer", "form", "blockquote"}


def _dropped(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag == "header" and inside_main:
        pass  # an article's own header holds its title
    elif tag in _DROP:
        return True
    if not attrs or "=" not in attrs:
        return bool(re.search(r"\bhidden\b", attrs))
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and any(_BEFORE.sub("", c.lower()).replace("_", "-") in _WORDS for c in value.split()):
            return True
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=\s|$)", attrs))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, part) of each block that no tag or class throws out; part: 1 + n in the n-th article, 1 in <main>, 0 elsewhere."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, thrown out, part
    articles = 1
    buf: list[str] = []
    dead, part, at, low = False, 0, 0, page.lower()
    aligned = len(low) == len(page)

    def flush() -> None:
        if buf:
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            buf.clear()
            if text:
                out.append((text, part))

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not dead and (m.start() if m else n) > at:
            buf.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in _BLOCK for t, _, _ in stack[k:]):
                        flush()
                    del stack[k:]
                    dead, part = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                    break
                if stack[k][0] in ("article", "main", "body") and tag in ("p", "b", "i", "em", "strong", "span", "a"):
                    break
            else:
                if tag in _BLOCK:
                    flush()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif not dead and tag == "br":
                buf.append(" ")
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in _RAW:
            end = low.find(f"</{tag}", at) if aligned else next((x.start() for x in [re.compile(rf"</{tag}", re.I).search(page, at)] if x), -1)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
            if tag in _BLOCK and tag not in ("svg", "math"):
                flush()
            continue
        if tag in _BLOCK:
            flush()
            closes = _ENDS.get(tag)
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" or closes and t in closes:
                    del stack[k:]
                    dead, part = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                    if t != "p":
                        break
                elif t in _SCOPE:
                    break
        if tag == "body":
            for k, (t, _, _) in enumerate(stack):
                if t == "head":
                    del stack[k:]
                    dead, part = False, 0
                    break
        thrown = dead or _dropped(tag, m[3] or "", part > 0)
        if thrown and not dead:
            flush()
        role_main = tag == "main" or bool(m[3]) and "role" in m[3] and bool(re.search(r"""role\s*=\s*["']?main\b""", m[3], re.I))
        if tag == "article" and part < 2 and not thrown:
            articles += 1
            part = articles
        part = max(part, 1 if role_main else 0)
        dead = thrown
        stack.append((tag, dead, part))
    flush()
    return out


def main_blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks to keep, and whether they still are open to the host's suffixes (no main part was marked)."""
    found = blocks(page or "")
    size: dict[int, int] = {}
    for t, p in found:
        size[p] = size.get(p, 0) + len(t)
    best = max((p for p in size if p >= 2), key=lambda p: (size[p], -p), default=1)
    if best in size:
        return [t for t, p in found if p == best], False
    return [t for t, _ in found], bool(found)


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, and the text, or the blocks where they are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_blocks(h) for h in b["html"].to_pylist()]
            texts = [None if is_open else "\n".join(x) for x, is_open in got]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([x if is_open else None for x, is_open in got], pa.list_(pa.string()))], names=["page_id", "url", "text", "blocks"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, blocks array<string>")


def _suffixes(df: DataFrame, span: int) -> DataFrame:
    """(host, key, _p, _c, start): the suffixes of each page's token stream by their first `span` tokens."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1))
    toks = df.select("_p", "_c", host.alias("host"), F.split(F.array_join("blocks", " "), " ").alias("w")).where(F.size("w") >= span)
    each = toks.select("_p", "_c", "host", "w", F.posexplode("w").alias("start", "_t"))
    return each.where(F.col("start") <= F.size("w") - span).select("host", F.xxhash64(*[F.get("w", F.col("start") + k) for k in range(span)]).alias("key"), "_p", "_c", "start")


def extract(pages: DataFrame, span: int = SPAN) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    done = common.stored(_pages(pages))
    marked = done.where("blocks is null").select("page_id", "url", "text")
    bare = done.where("blocks is not null").select("page_id", "url", "blocks", F.xxhash64("page_id", "url", F.array_join("blocks", "\n")).alias("_p"), F.xxhash64(F.array_join("blocks", "\n")).alias("_c"))
    if bare.isEmpty():
        return marked.withColumn("n_chars", F.length("text").cast("long"))
    suffixes = _suffixes(bare, span)
    # pages of equal blocks are one content, so copies of a page don't make its text boilerplate
    shared = suffixes.select("host", "key", "_c").distinct().groupBy("host", "key").count().where(F.col("count") >= CONTENTS).select("host", "key")
    covered = suffixes.join(shared, ["host", "key"]).groupBy("_p").agg(F.collect_set("start").alias("hits"))
    kept = bare.join(covered, "_p", "left")

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for found, hits in zip(b["blocks"].to_pylist(), b["hits"].to_pylist(), strict=True):
                hits = sorted(hits or ())
                gone = {x for h in hits for x in range(h, h + span)}
                at, left = 0, []
                for words in (x.split(" ") for x in found):
                    end = at + len(words)
                    own = gone
                    if not all(i in gone for i in range(at, end)):
                        inside = hits[bisect.bisect_left(hits, at) : bisect.bisect_right(hits, end - span)]
                        own = {x for h in inside for x in range(h, h + span)}
                    left.append(" ".join(w for i, w in enumerate(words, at) if i not in own))
                    at = end
                texts.append("\n".join(x for x in left if x))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rest = kept.select("page_id", "url", "blocks", "hits").mapInArrow(cutter, "page_id long, url string, text string")
    return marked.union(rest).withColumn("n_chars", F.length("text").cast("long"))
