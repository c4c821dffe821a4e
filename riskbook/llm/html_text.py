"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped line by line: block elements end a line, everything else stays within one. The
length of a line is its text outside of links; lines of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are left out, and if the page marks articles, so are the lines
outside of them (in an article, linked text counts as well). Lengths are summed over sliding windows of
lines: the text surges at the line where a sum rises from 0 and dives where it falls back, which takes
as many wholly linked lines as the window has. All lines between a surge and its dive are kept, whatever
their size, and at the page's ends the few linked lines next to them; a part that is nothing but a
copyright notice goes.

Words of a class, id or role put an element beside the article only as a whole name ("sidebar",
"ad-box", not "has-sidebar"), never a heading, and not an element that holds most of the text. If
nothing is left, the names count for nothing, and if still nothing is left, all lines stay.

Pages are independent rows: one pass, no shuffle. Defined cases: a null or empty page gives an empty
text; unclosed and misplaced tags never fail; the page is scanned forward once, so the time follows its
length; a quote opens an attribute's value only behind its equals sign, and where such a value never ends,
the next ``>`` ends the tag, there and in the rest of the page; repeated rows give equal results; other
columns are ignored.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a line.
BLOCKS = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript iframe object svg math canvas textarea audio video map head".split())
#: Elements that never hold a part of the article.
ASIDE = frozenset("nav aside footer form menu button select dialog search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role of elements beside the article.
BESIDE = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo
promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment
comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations
teaser teasers widget masthead complementary contentinfo search searchbox form paywall disclaimer skip""".split())
HEADER = frozenset({"header", "masthead", "banner"})
#: Parts of a name that say nothing about what the element is.
NEUTRAL = frozenset("""area bar block bottom box btn button col column container content global group holder icons inner
item items left link links list main outer page panel post posts primary right row secondary section site slot top
unit wrap wrapper""".split())
#: Names of reader comments, which may well be longer than the article.
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"""=\s*(["'])|>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_COPYRIGHT = re.compile(r"(?:copyright\s*)?(?:©|\(c\)|copyright)\s*\d{4}", re.I)
_BODY = re.compile(r"<body\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _hidden(attrs: str) -> bool:
    """Is there an attribute ``hidden``, ``aria-hidden=true`` or a style that shows nothing?"""
    if "hidden" not in (low := attrs.lower()) and "display" not in low:
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


class _Tags:
    """The tags of a page in order, found by one forward scan."""

    def __init__(self, page: str):
        self.page, self.last, self.plain, self.unclosed = page, page.rfind(">"), False, set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the first tag or comment (no name) from ``at`` on."""
        page = self.page
        while 0 <= (start := page.find("<", at)) and (start < self.last or page.startswith("<!--", start)):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if page[start + 1:start + 2] in ("!", "?"):
                return start, page.find(">", start) + 1, "", False, ""
            if m := _NAME.match(page, start + 1):
                end = self._end(m.end())
                return start, end, m[2].lower(), m[1] == "/", page[m.end():end - 1]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Behind the ``>`` of the tag; there is one, as the tag starts before the page's last."""
        page, i = self.page, at
        while not self.plain:
            m = _VALUE.search(page, i)
            if m and not m[1]:
                return m.end()
            i = page.find(m[1], m.end()) + 1 if m else 0
            if not i:
                self.plain = True
        return page.find(">", at) + 1

    def raw_end(self, name: str, at: int) -> int | None:
        """Behind the closing tag of a raw element, or None."""
        if name in self.unclosed:
            return None
        m = _RAW_END[name].search(self.page, at, self.last + 1)
        if not m:
            self.unclosed.add(name)
        return m.end() if m else None


def _beside(name: str, attrs: str, in_article: bool) -> str:
    """Does the element stand beside the article: "" (no), "element" (by its kind, or hidden), "comments"
    or "name" (by its class, id or role)?"""
    if name in ASIDE:
        return "element"
    if name == "header":
        return "" if in_article else "element"
    if name in ("html", "body", "main") or not attrs:
        return ""
    if _hidden(attrs):
        return "element"
    if name in HEADINGS:
        return ""
    words, header = set(), False
    for m in _NAMED.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = {w.lower() for w in _PART.findall(token) if not w.isdigit()}
            known = {token.lower()} & BESIDE or parts & BESIDE
            if known and parts - known <= NEUTRAL:
                words |= known
            header |= bool(parts & HEADER) and parts <= HEADER | BESIDE | NEUTRAL
    if words:
        return "comments" if words <= COMMENTS else "name"
    return "name" if header and not in_article else ""


@dataclass(eq=False)
class _Open:
    """An element beside the article, and how many elements of its name are open from it on."""
    name: str
    kind: str
    parent: _Open | None
    article: int
    depth: int = 1
    chars: int = 0
    wraps: bool = False
    beside: bool = True


def lines_of(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """Lines in page order: (text, characters outside of links, stands beside the article, number of
    the outermost article or 0, is a heading)."""
    out: list[tuple[str, int, _Open | None, int, bool]] = []
    parts: list[tuple[str, bool]] = []
    nodes: list[_Open] = []
    skip: list[_Open] = []    # open elements beside the article
    named: dict[str, list[_Open]] = {}
    links = articles = article = depth = headings = 0
    landmark = ""

    def end_line():
        if parts:
            text = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
            if text:
                plain = " ".join(entities.unescape("".join(t for t, linked in parts if not linked)).split())
                out.append((text, len(plain), skip[-1] if skip else None, article, headings > 0))
            parts.clear()

    def leave(node: _Open):
        while True:
            top = skip.pop()
            named[top.name].pop()
            if top is node:
                return

    at, tags = 0, _Tags(page)
    while found := tags.next(at):
        start, end, name, closing, attrs = found
        if start > at:
            parts.append((page[at:start], links > 0))
        at = end
        if not name:
            continue
        if name in RAW:
            if not closing and not attrs.endswith("/") and name != "head":
                end = tags.raw_end(name, at)
                if end or name in ("script", "style"):
                    at = end or len(page)
                continue
            if name == "head" and not closing:
                body = _BODY.search(page, at)
                at = tags.raw_end(name, at) or (body.start() if body else at)
            end_line()
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCKS:
            end_line()
            links = 0
            headings = int(name in HEADINGS and not closing)
        if closing:
            if named.get(name):
                node = named[name][-1]
                node.depth -= 1
                if not node.depth:
                    end_line()
                    leave(node)
            if article and name == landmark:
                depth -= 1
                if depth <= 0:
                    article = 0
            continue
        if name == "br":
            parts.append((" ", links > 0))
        if name in VOID or attrs.endswith("/"):
            continue
        if named.get("p") and name in BLOCKS:
            leave(named["p"][-1])  # the next block ends an unclosed paragraph
        beside = _beside(name, attrs, article > 0)
        if name in ("article", "main") and not beside:
            if not articles and skip:
                leave(skip[0])  # an unclosed menu before the page's article doesn't hold it
            if not article:
                articles += 1
                article, landmark, depth = articles, name, 1
            elif name == landmark:
                depth += 1
        if name in BLOCKS and skip:
            skip[-1].wraps = True
        if beside:
            end_line()
            skip.append(_Open(name, beside, skip[-1] if skip else None, article))
            named.setdefault(name, []).append(skip[-1])
            nodes.append(skip[-1])
        elif named.get(name):
            named[name][-1].depth += 1
    if at < len(page):
        parts.append((page[at:], links > 0))
    end_line()
    _resolve(out, nodes)
    return [(text, n, node is not None and node.beside, a, heading) for text, n, node, a, heading in out]


def _resolve(lines: list[tuple[str, int, _Open | None, int, bool]], nodes: list[_Open]) -> None:
    """Sets ``beside`` of the elements: those that only their name puts beside the article don't count if
    wrapped around most of the article's text outside of links (without a marked article: of the page's), or if
    nothing is left."""
    if not nodes:
        return
    apart: set[int] = set()  # in an element beside the article by its kind
    for node in nodes:
        if node.kind == "element" or (node.parent and id(node.parent) in apart):
            apart.add(id(node))
    totals: dict[int, int] = {}
    marked = any(a and node is None for _, _, node, a, _ in lines)
    for _, n, node, a, _ in lines:
        if node is None or id(node) not in apart:
            totals[a if marked else 0] = totals.get(a if marked else 0, 0) + n
            if node:
                node.chars += n
    for node in reversed(nodes):  # parents come first
        if node.parent and id(node) not in apart:
            node.parent.chars += node.chars
        if node.parent and node.wraps:
            node.parent.wraps = True
    for node in nodes:
        most = node.kind == "name" and node.wraps and (node.article > 0 or not marked) and 2 * node.chars > totals.get(node.article if marked else 0, 0)
        node.beside = not most or (node.parent is not None and node.parent.beside)
    for left in (apart, frozenset()):
        if any(node is None or not node.beside for _, _, node, _, _ in lines):
            return
        for node in nodes:
            node.beside = id(node) in left


def surges(lengths: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges of lines from each surge to its dive: where the sum of the last ``window`` lengths rises from
    0, and the last line with a length before it has fallen back."""
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(window, dtype=np.int64)) > 0
    edge = np.diff(np.concatenate([[0], sums.astype(np.int8), [0]]))
    return [(int(a), int(b) - window + 1) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)]


def main_text(page: str, window: int = 3) -> str:
    """Text between surge and dive points; ``window`` wholly linked lines in a row make a dive."""
    lines = [line for line in lines_of(page) if not line[2]]
    marked = any(line[3] for line in lines)
    if marked:
        lines = [line for line in lines if line[3]]
    lengths = np.array([len(text) if marked else n for text, n, *_ in lines], dtype=np.int64)
    for i in range(len(lines) - 2, -1, -1):
        if lines[i][4] and not lengths[i] and lengths[i + 1]:
            lengths[i] = len(lines[i][0])  # a linked headline belongs to the text below it
    found = surges(lengths, window)
    if not found:
        return "\n".join(text for text, *_ in lines)
    if found[0][0] < window:
        found[0] = (0, found[0][1])
    if len(lines) - found[-1][1] < window:
        found[-1] = (found[-1][0], len(lines))
    told = [(a, b) for a, b in found if marked or any(lengths[i] and not _COPYRIGHT.match(lines[i][0]) for i in range(a, b))]
    return "\n".join(lines[i][0] for a, b in told or found for i in range(a, b))


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", window: int = 3) -> DataFrame:
    """``id_cols`` and ``text`` for each row of ``df``."""
    keys = [f"k{i}" for i in range(len(id_cols))]
    pages = df.select(*[F.col(c).alias(k) for c, k in zip(id_cols, keys, strict=True)],
                      F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    types = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keys].assign(text=[main_text(p, window) for p in frame["html"]])

    return pages.mapInPandas(run, f"{types}, text string").select(
        *[F.col(k).alias(c) for c, k in zip(id_cols, keys, strict=True)], "text")
