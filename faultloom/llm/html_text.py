"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. If the page has an article or main element, its lines are the text, whole, but for
boilerplate elements in it (navigation, footers, sidebars, forms, notices, adverts, comments; buttons and headers count only outside an article). An
article that lies in boilerplate, as in a wrapper named "comments-page", wins if it has more text than all that is no boilerplate; hidden elements and comments proper stay out.
An element that the page opens but never closes ends where an article begins.

Other pages are decided by the distribution: a line's length is that of its text, and 0 in boilerplate or if it consists of links. Lengths are summed over
sliding windows of three lines. The text surges where the sum rises above a threshold and dives where it falls to nothing: runs of windows between
dives that hold a surge are kept, whole, and with them the lines that lie in the same element as one of theirs. If all of a page is boilerplate, elements whose name
says something else too ("alert-level") count as text.

Character references are decoded, white space in a line becomes one space, and lines are joined by one space in page order.

Rows are extracted one by one, so no key matters; a very long page costs its own length only, however its elements nest: what is open is counted, not walked.

Edge cases: a null or empty page has an empty text; a quote that is not closed before the next "<" is an ordinary character, so a page is
read in one pass however broken it is; markup that is cut short or not closed ends with the page; a page without
markup is one line; repeated rows are extracted each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video".split())
#: Elements that hold others and need an end tag, so they nest.
_HOLDER = frozenset("address article aside blockquote body button details dialog div dl fieldset figure footer form head header html main menu nav noscript ol section select span svg table ul".split())
_RAW = frozenset("script style template object canvas textarea iframe".split())
_DROPPED = frozenset("nav footer aside form head select dialog menu".split())
#: Dropped unless they lie in an article.
_OUTSIDE = frozenset("header button noscript svg".split())
_WRAPS = "nav header footer aside form menu dialog".split()
_WRAP = re.compile(rf"<(/?)({'|'.join(_WRAPS)})\b", re.I)
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banners?|sponsor\w*|promo\w*|side-?bars?|menus?|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|comments?|commentlist|disqus|replies|reply|respond|shar(?:e|ing)|social|related|recommend\w*|newsletter|subscri\w*|footer|masthead|widgets?|paginat\w*|pager|login|sign-?up|toolbar)(?:$|[\s_-])", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?:$|[\s_-])", re.I)
#: A class of this name holds the article, so a class beside it counts as boilerplate only by its whole name.
_ARTICLE = frozenset("article article-body article-content content entry entry-content main main-content page-content post post-body post-content story story-body".split())
#: Parts of names that say nothing of what an element holds.
_NEUTRAL = frozenset("area bar block box container item items list section wrap wrapper".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
_WINDOW, _SURGE = 3, 86


def _kind(tag: str, attributes: str, within: bool) -> int:
    """How surely an element is boilerplate: 0 not, 1 by a name that says something else too, 2 by its tag, role or name, 3 beyond what an article in it could change."""
    own = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return 3
    if tag in _DROPPED or tag in _OUTSIDE and not within or own.get("role", "").lower() in _ROLES:
        return 2
    named = f"{own.get('class', '')} {own.get('id', '')}"
    tokens = named.lower().split()
    if _ARTICLE.intersection(tokens):
        hit = [x for x in tokens if _HINT.fullmatch(x) or _COMMENT.search(x)]
    else:
        hit = [x for x in tokens if (_COMMENT if tag in ("article", "main", "body", "html") else _HINT).search(x)]
    if not hit:
        return 0
    sure = [x for x in hit if all(_HINT.fullmatch(part) or part in _NEUTRAL for part in re.split("[_-]", x))]
    return 3 if any(_COMMENT.search(x) for x in sure) else 2 if sure else 1


class Line(NamedTuple):
    text: str
    boiler: int  # the surest kind of boilerplate it lies in
    article: bool  # in an article or main element
    freed: bool  # in an article or main element within boilerplate, and in no further boilerplate there
    links: float  # share of its text in links
    box: int | None  # the innermost element that holds it, body and inline elements aside


def page_lines(page: str) -> list[Line]:
    """Lines of a page, one for each block."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    boxes: list[int | None] = [None]  # of the open elements but spans
    opened: Counter[str] = Counter()  # elements of the stack by tag
    kinds = [0, 0, 0, 0]  # elements of the stack by kind
    spans: list[bool] = []  # whether each open span is boilerplate
    unclosed = Counter(m[2].lower() if not m[1] else "/" + m[2].lower() for m in _WRAP.finditer(page))
    free: tuple[int, int] | None = None  # of an article in boilerplate: depth of the stack and boilerplate around it
    linked = links = at = made = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            boiler = 3 if kinds[3] else 2 if kinds[2] else 1 if kinds[1] else 0
            out.append(Line(text, boiler, opened["article"] + opened["main"] > 0, free is not None and sum(kinds[1:]) == free[1], min(linked / len(text), 1.0), boxes[-1]))
        parts.clear()
        linked = 0

    def close() -> str:
        nonlocal free
        tag, kind = stack.pop()
        opened[tag] -= 1
        kinds[kind] -= 1
        if tag == "span":
            spans.pop()
        else:
            boxes.pop()
        if free and len(stack) < free[0]:
            free = None
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * bool(links)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW and not m[1] and not m[3].rstrip().endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            flush()
        if tag == "a":
            links = 0 if m[1] else 1
        if tag not in _HOLDER:
            continue
        if not m[1]:
            if not m[3].rstrip().endswith("/"):
                if tag in ("article", "main"):
                    # What the page never closes ends where the article begins.
                    for wrap in _WRAPS:
                        while opened[wrap] and unclosed[wrap] > unclosed["/" + wrap]:
                            unclosed[wrap] -= 1
                            while close() != wrap:
                                pass
                kind = _kind(tag, m[3], opened["article"] + opened["main"] > 0)
                if tag == "span":
                    if kind:
                        flush()
                    spans.append(kind > 0)
                else:
                    made += 1
                    boxes.append(None if tag in ("body", "html") else made)
                stack.append((tag, kind))
                opened[tag] += 1
                kinds[kind] += 1
                if tag in ("article", "main") and not kind and free is None and not kinds[3] and kinds[1] + kinds[2]:
                    free = (len(stack), kinds[1] + kinds[2])
        elif tag == "span":
            if spans and spans[-1]:
                flush()
            # A span does not close what it lies in.
            if stack and stack[-1][0] == "span":
                close()
        elif opened[tag]:
            while close() != tag:
                pass
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def main_text(page: str) -> str:
    lines = page_lines(page)
    if any(x.article and not x.boiler for x in lines):
        return " ".join(x.text for x in lines if x.article and not x.boiler)
    plain = [0 if x.boiler or x.links > 0.8 else len(x.text) for x in lines]
    if sum(len(x.text) for x in lines if x.freed) > sum(plain):
        return " ".join(x.text for x in lines if x.freed)
    size = plain if any(plain) else [len(x.text) if x.boiler == 1 and x.links <= 0.8 else 0 for x in lines]
    if not any(size):
        return ""
    sums = [sum(size[max(i, 0) : i + _WINDOW]) for i in range(1 - _WINDOW, len(size))]
    surge = min(_SURGE, max(sums) / 2)
    kept: set[int] = set()
    begin = None
    for i, s in enumerate([*sums, 0]):
        if s and begin is None:
            begin = i
        elif not s and begin is not None:
            if max(sums[begin:i]) >= surge:
                kept.update(j for j in range(max(begin + 1 - _WINDOW, 0), min(i, len(size))) if size[j])
            begin = None
    boxes = {lines[j].box for j in kept} - {None}
    return " ".join(x.text for j, x in enumerate(lines) if j in kept or size[j] and x.box in boxes)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("html")
        text = [main_text(x or "") for x in batch.column(at).to_pylist()]
        keep = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*(batch.schema.names[i] for i in keep), "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """The pages with text and n_chars in place of html (and of columns of these names)."""
    pages = pages.drop("text", "n_chars")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.mapInArrow(_extract, f"{fields}, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.col("text"), "n_chars")


SQL: dict[str, str] = {}
