"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: one for each block element, with the number of characters of its own text that is not link text.  Lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments count 0.  The lengths are summed over sliding
windows of lines; where the sum rises from nothing is a surge, where it falls back is a dive, and the lines between them are kept (those that count 0
left out).  A form, or an element that only its class, id or role marks, stays if the page's marked article is nowhere else, or hardly any text is.  Where a page marks its article, lines outside it count 0 too; where it does not, stretches much weaker than the strongest are dropped.

Null and empty pages, and pages without text, give an empty text.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_batches

WINDOW = 3
#: Without a marked article: a stretch is kept if its highest window has this share of the page's highest.
WEAKEST = 0.15

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "textarea", "select", "button"}
_AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "header", "fieldset", "label"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
          "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
          "table", "tbody", "tfoot", "thead", "tr", "ul"}
_MAIN = {"article", "main"}
#: Next anchor tag, and a self-closing slash (not the end of an unquoted value).
_ANCHOR, _CLOSED = re.compile(r"<(/?)a(?=[\s/>])", re.I), re.compile(r"(?:^|[\s\"'])/$")
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Fixed words of class, id and role values that mark what is not the article.
_MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "menu", "menus", "nav",
          "navbar", "navigation", "topnav", "sidebar", "sidenav", "aside", "footer", "foot", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice",
          "notices", "notification", "alert", "disclaimer", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments",
          "disqus", "reply", "replies", "respond", "discussion", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "popup", "modal", "overlay", "widget",
          "pagination", "pager", "skip", "search", "complementary", "contentinfo", "hidden"}


#: Why an element is away: by what it is, or by a mark that may be a wrapper's.
_HARD, _SOFT = 1, 2


def _away(name: str, rest: str, inside: bool) -> int:
    if name in _AWAY and name not in ("form", "fieldset") and not (name == "header" and inside):
        return _HARD
    soft = _SOFT if name in ("form", "fieldset") else 0
    if name in ("html", "body") or name in _MAIN or not rest:
        return soft
    for m in _ATTRIBUTE.finditer(rest):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _HARD
        if kind in ("class", "id", "role"):
            words = _SPLIT.split(_CAMEL.sub("-", value).lower())
            if not _MARKS.isdisjoint(words) or "header" in words and not inside:
                soft = _SOFT
    return soft


def _wrappers(weights: list[int], inside: list[bool], over: list[tuple[int, ...]]) -> set[int]:
    """Softly marked elements that stay.  ``over``: those around each line (-1: an element that is away for good)."""
    lines_ = [(w, a, o) for w, a, o in zip(weights, inside, over) if w and -1 not in o]
    if not any(o for _, _, o in lines_) or any(a and not o for _, a, o in lines_):
        return set()
    if any(a for _, a, _ in lines_):
        return {e for _, a, o in lines_ if a for e in o}
    held: dict[int, int] = {}
    for w, _, o in lines_:
        for e in o:
            held[e] = held.get(e, 0) + w
    total, bare = sum(w for w, _, _ in lines_), sum(w for w, _, o in lines_ if not o)
    return {e for e, w in held.items() if 2 * w > total and bare < WEAKEST * w}


def lines(page: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Text of each line in page order, its weight (characters of own text, outside links where no article is marked; 0 for what is not the article), and whether it lies in a marked article."""
    texts: list[str] = []
    weights: list[int] = []
    inside: list[bool] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    over: list[tuple[int, ...]] = []
    depth = marks = 0
    # of the open link: open elements at its start (0: no link), and whether its end tag is missing
    links, loose = 0, False

    def flush() -> None:
        text = " ".join(references.unescape("".join(x for x, _ in parts)).split())
        if text:
            linked = " ".join(references.unescape("".join(x for x, a in parts if a)).split())
            own = len(text) - len(linked)
            texts.append(text)
            weights.append(len(text) if depth else own if 2 * own >= len(text) else 0)
            inside.append(depth > 0)
            over.append(tuple(g for _, g in stack if g))
        parts.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at:m.start()], links > 0))
        at = max(m.end(), m.start() + 1)
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _RAW:
            if not m["close"] and not m["rest"].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in _BLOCK:
            flush()
            if loose:
                links, loose = 0, False
        elif name in ("br", "td", "th", "img"):
            parts.append((" ", False))
        if name == "a":
            links, loose = 0, False
            if not m["close"] and _HREF.search(m["rest"]) and not _CLOSED.search(m["rest"]):
                follow = _ANCHOR.search(page, at)
                links, loose = len(stack) + 1, not (follow and follow[1])
        if name in _VOID or m["rest"].endswith("/") and name not in _BLOCK:
            continue
        if m["close"]:
            if any(x == name for x, _ in stack):
                while stack:
                    open_name, _ = stack.pop()
                    depth -= open_name in _MAIN
                    if open_name == name:
                        break
                links = links if links <= len(stack) + 1 else 0
        elif name in _BLOCK or _away(name, m["rest"], depth > 0):
            if name in ("p", "li", "dt", "dd", "tr") and stack and stack[-1][0] == name:
                stack.pop()
                links = links if links <= len(stack) + 1 else 0
            gone = _away(name, m["rest"], depth > 0)
            if gone and name not in _BLOCK:
                flush()
            marks += gone == _SOFT
            stack.append((name, marks if gone == _SOFT else -gone))
            depth += name in _MAIN
    flush()
    stay = _wrappers(weights, inside, over)
    weights = [w if stay.issuperset(o) else 0 for w, o in zip(weights, over)]
    return texts, np.array(weights, dtype=np.int64), np.array(inside, dtype=bool)


def extract(page: str | None) -> str:
    """The article: its blocks, joined by two line ends."""
    texts, weight, inside = lines(page or "")
    if not texts:
        return ""
    marked = bool(weight[inside].sum()) if len(inside) else False
    if marked:
        weight = np.where(inside, weight, 0)
    # windows: sums[i] covers lines i .. i + WINDOW - 1; padding lets stretches touch either end
    padded = np.concatenate([np.zeros(WINDOW - 1, np.int64), weight, np.zeros(WINDOW - 1, np.int64)])
    sums = np.convolve(padded, np.ones(WINDOW, dtype=np.int64), "valid")
    full = np.concatenate([[False], sums > 0, [False]])
    surges, dives = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(full[:-1] & ~full[1:])
    out: list[str] = []
    for a, b in zip(surges, dives):
        if marked or sums[a:b].max() >= WEAKEST * sums.max():
            # window a is the first that reaches a counting line (its last); window b - 1 the last (its first)
            out += [texts[i] for i in range(a, b - WINDOW + 1) if weight[i] > 0]
    return "\n\n".join(out)


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, ``text`` and ``n_chars`` (code points)."""
    kept = pages.drop(*({"text", "n_chars"} - {html})).withColumn(html, F.col(html).cast("string"))
    at = kept.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in long_batches(whole, html):
                found = [extract(x) for x in b.column(at).to_pylist()]
                cols = [c for i, c in enumerate(b.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                                                 [*(n for i, n in enumerate(b.schema.names) if i != at), "text", "n_chars"])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != html), "text string", "n_chars long"]))


def digest(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
