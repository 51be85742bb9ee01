"""Main-text extraction by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf path of block elements and their classes. Per path,
text length outside links and punctuation are aggregated over its blocks; both ratios are fused. An element weighs what
the ratios of its blocks add up to, and from the root the page is followed into the element that holds most of the
weight, down to the main element: that is the article, with all its blocks, for short items, table cells and lists of
links are text of an article too. Where no element holds most of it, ratios are smoothed over the page's order and the
blocks that reach a share of the page's level are the article.

Scripts, styles, forms, hidden elements and reader comments are left out by kind, since ratios can't tell comments from
the article. Names that speak of menus, adverts and the like halve the weight of an element: one that holds most of
the weight all the same is the article. Inside the article, elements that names or kinds (nav, footer, aside) mark are
left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.store import table

#: Weight of elements that names mark as boilerplate, and share of its parent's weight that the article holds.
MARKED, MOST = 0.5, 0.5
#: Share of the page's level that a path must reach, and weights of the smoothing over page order.
LEVEL = 0.08
SMOOTH = (0.25, 0.5, 1.0, 0.5, 0.25)
#: Share of link text from which a block is a list of links.
LINKS = 0.6

_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_PLAIN_END = re.compile(r"[\s/]*>")
_NAME = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡。，；：！？、]")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are boilerplate inside an article and weigh by their ratios elsewhere, and those that hold no text of a page.
SOFT = {"nav", "header", "footer", "aside", "menu"}
OUT = {"form", "head", "dialog", "button", "select", "option", "optgroup", "datalist", "fieldset", "label", "legend", "svg", "math", "canvas", "object", "audio", "video", "map", "progress", "meter"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
#: First words of class names that tell of what a page has, not of what an element is.
STATES = {"has", "with", "without", "no", "is", "show", "hide", "enable", "enabled", "disable", "disabled"}
#: Marks of elements that hold remarks of readers.
REMARKS = {"comment", "commentlist", "comments", "disqus", "replies", "reply", "respond"}
#: Words of class and id names that mark boilerplate.
MARKS = {"ad", "ads", "adsbygoogle", "alert", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "rail", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "topbar", "widget", "widgets"}
PAIRS = {("side", "bar"), ("bread", "crumb"), ("sign", "up"), ("log", "in"), ("ad", "slot"), ("foot", "er"), ("nav", "bar"), ("pop", "up")}
MAIN = {"article", "main"}
MAIN_MARKS = {"article", "content", "entry", "main", "post", "story"}
HEADINGS = {"h1", "h2", "h3"}
#: Elements that a start tag closes, up to the nearest boundary.
_BLOCKS = ("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul").split()
CLOSES = {t: {"p"} for t in _BLOCKS} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th", "p"}, "thead": {"tr"}, "tfoot": {"tbody", "tr", "td", "th", "p"}, "body": {"head"}}
BOUNDS = {"table", "ul", "ol", "dl", "div", "section", "article", "aside", "main", "nav", "header", "footer", "form", "blockquote", "body", "html", "select", "button"}


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """Words of each class name and of the id, without names that only tell a state."""
    names = [[w.lower() for w in _WORD.findall(n)] for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    return [n for n in names if n and n[0] not in STATES]


def _marked(attrs: dict[str, str]) -> tuple[int, bool]:
    """(boilerplate: 0 no, 1 less weight, 2 left out; main) by role, hidden state, class and id."""
    role = attrs.get("role", "").lower()
    style = attrs.get("style", "").replace(" ", "").lower()
    names = _names(attrs)
    words = {w for n in names for w in n}
    out = 1 if role in ROLES else 0
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or not words.isdisjoint(REMARKS):
        out = 2
    elif not words.isdisjoint(MARKS) or any(p in PAIRS for n in names for p in zip(n, n[1:], strict=False)):
        out = 1
    return out, role == "main" or attrs.get("itemprop", "").lower() == "articlebody" or not words.isdisjoint(MAIN_MARKS)


class _Page:
    """Blocks of a page (text, length outside links, path, element), and the tree of its block elements."""

    def __init__(self, source: str, drop_forms: bool = True):
        self.blocks: list[tuple[str, int, int, int]] = []
        self.paths: dict[tuple[int, str, str], int] = {}
        #: Of each block element: parent, tag, marked as boilerplate, so by its names, main.
        self.parent, self.tag, self.marked, self.named, self.main = [0], [""], [False], [False], [False]
        self.drop_forms = drop_forms
        #: tag, left out (3: a header inside an article), link, path, block element
        self.stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
        self.parts: list[str] = []
        self.linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((text, max(0, len(text) - self.linked), *self.stack[-1][3:]))
        self.parts, self.linked = [], 0

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if top[1] == 0:
            self.parts.append(text)
            if top[2]:
                self.linked += len(text.strip())

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        closes = CLOSES.get(tag)
        if closes:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in closes:
                    del self.stack[k:]
                    if tag not in ("td", "th", "tr", "tbody", "tfoot", "dt", "dd", "li"):
                        break
                elif self.stack[k][0] in BOUNDS:
                    break
        _, out, link, path, element = self.stack[-1]
        mark, main = _marked(attrs) if attrs else (0, False)
        if tag in ("html", "body"):
            mark = 0
        main = main or tag in MAIN
        inside = self._inside(element)
        kind = tag in SOFT and not (tag == "header" and inside)
        if out == 0 and (mark == 2 or tag in OUT and (tag != "form" or self.drop_forms)):
            out = 2
        elif out == 0 and tag == "header":
            out = 3  # of an article's header only its headings are text
        elif out == 3 and tag in HEADINGS:
            out = 0
        elif out == 2 and tag in MAIN and mark < 2 and any(x[0] == "form" and x[1] for x in self.stack):
            out = 0  # a form whose end is missing
        if tag not in INLINE:
            path = self.paths.setdefault((path, tag, attrs.get("class", "")), len(self.paths) + 1)
            element = self._element(element, tag, kind, mark == 1, main)
        self.stack.append((tag, out, link or tag == "a", path, element))

    def _element(self, parent: int, tag: str, kind: bool, named: bool, main: bool) -> int:
        if tag in MAIN:  # an article that starts inside a menu or header is a page whose end tag is missing
            while self.tag[parent] in ("nav", "header", "menu"):
                parent = self.parent[parent]
        for values, value in ((self.parent, parent), (self.tag, tag), (self.marked, kind or named), (self.named, named), (self.main, main)):
            values.append(value)
        return len(self.parent) - 1

    def _inside(self, element: int) -> bool:
        while element:
            if self.tag[element] == "article":
                return True
            element = self.parent[element]
        return False

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in INLINE and self.stack[k][0] in BOUNDS:
                return

    def _attributes(self, source: str, at: int) -> tuple[dict[str, str], int]:
        """Attributes of a start tag from behind its name, and the place behind the tag; a quote that never ends is no quote."""
        attrs: dict[str, str] = {}
        while at < len(source):
            if source[at] == ">":
                return attrs, at + 1
            m = _NAME.match(source, at)
            at, value = m.end(), ""
            if m[2] and at < len(source):
                quote = source[at]
                if quote in "\"'" and self.last[quote] > at:
                    end = source.index(quote, at + 1)
                    value, at = source[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(source, at)
                    value, at = bare[0], bare.end()
            if m[1]:
                attrs.setdefault(m[1].lower(), value)
        return attrs, at

    def _read(self, source: str) -> None:
        self.last = {c: source.rfind(c) for c in "\"'>"}
        ends: dict[str, re.Pattern] = {}
        missing: set[str] = set()
        at = done = 0
        while (at := source.find("<", at)) >= 0:
            skip = 0
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4) if "-->" not in missing else -1
                if end < 0:
                    missing.add("-->")
                skip = end + 3 if end >= 0 else len(source)
            elif source[at + 1 : at + 2] in ("!", "?"):
                skip = source.index(">", at) + 1 if self.last[">"] > at else len(source)
            if skip:
                self._text(source[done:at])
                at = done = skip
                continue
            m = _TAG.match(source, at + 1)
            if not m:
                at += 1
                continue
            if at > done:
                self._text(source[done:at])
            if self.last[">"] < at:  # a tag that never ends
                at = done = len(source)
                break
            tag = m[2].lower()
            plain = _PLAIN_END.match(source, m.end())
            attrs, at = ({}, plain.end()) if plain else self._attributes(source, m.end())
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                if tag not in INLINE:
                    self._flush()
                end = None if tag in missing else ends.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I)).search(source, at)
                if end is None:
                    missing.add(tag)
                at = end.end() if end else len(source)
            else:
                self._open(tag, attrs)
            done = at
        if done < len(source):
            self._text(source[done:])
        self._flush()


def ratios(page: _Page) -> list[float]:
    """Of each block: its path's text length outside links per block, raised by the path's punctuation per block."""
    total: dict[int, list[int]] = {}
    for text, plain, path, _ in page.blocks:
        t = total.setdefault(path, [0, 0, 0])
        t[0] += 1
        t[1] += plain
        t[2] += len(_PUNCTUATION.findall(text))
    fused = {p: (length / n) * (1 + punct / n) ** 0.5 for p, (n, length, punct) in total.items()}
    return [fused[path] for _, _, path, _ in page.blocks]


def _passing(page: _Page, score: list[float]) -> list[bool]:
    """Blocks whose ratio, or smoothed ratio, reaches a share of the page's level and that aren't mostly links."""
    blocks, half, smooth = page.blocks, len(SMOOTH) // 2, []
    for i in range(len(blocks)):
        near = range(max(0, i - half), min(len(blocks), i + half + 1))
        smooth.append(sum(SMOOTH[k - i + half] * score[k] for k in near) / sum(SMOOTH[k - i + half] for k in near))
    weight = sum(plain for _, plain, _, _ in blocks) or 1
    level = sum(s * plain for s, (_, plain, _, _) in zip(score, blocks, strict=True)) / weight
    return [max(a, b) >= LEVEL * level and plain >= (1 - LINKS) * len(text) for a, b, (text, plain, _, _) in zip(score, smooth, blocks, strict=True)]


def _select(page: _Page) -> str:
    blocks, parent = page.blocks, page.parent
    if not blocks:
        return ""
    score = ratios(page)
    mark, named = [False] * len(parent), [False] * len(parent)  # here or above
    for e in range(1, len(parent)):
        mark[e], named[e] = page.marked[e] or mark[parent[e]], page.named[e] or named[parent[e]]
    held, inner = [0.0] * len(parent), [False] * len(parent)
    for s, (_, _, _, e) in zip(score, blocks, strict=True):
        held[e] += s * (MARKED if named[e] else 1)
    for e in range(len(parent) - 1, 0, -1):  # a child comes after its parent
        held[parent[e]] += held[e]
        inner[parent[e]] |= held[e] > 0
    heaviest: dict[int, int] = {}
    for e in range(1, len(parent)):
        if (inner[e] or page.main[e]) and held[e] > MOST * held[parent[e]]:
            heaviest[parent[e]] = e
    node = 0
    while not page.tag[node] in MAIN and node in heaviest:
        node = heaviest[node]
    passing = _passing(page, score)
    within, below = [False] * len(parent), [False] * len(parent)  # in the node; marked below it

    def place() -> None:
        for e in range(len(parent)):
            within[e] = e == node or e > 0 and within[parent[e]]
            below[e] = within[e] and e != node and (page.marked[e] or below[parent[e]])

    place()
    while page.tag[node] not in ("", "html", "body", *MAIN):
        # a heading or first lines beside the heaviest element are the article's too, unless marked or poor
        up = parent[node]
        if page.tag[up] in ("", "html", "body"):
            break
        inside = [e == node or e > node and within[e] for e in range(len(parent))]
        above = [False] * len(parent)
        for e in range(len(parent)):
            above[e] = e == up or e > 0 and above[parent[e]]
        if not all(ok and not mark[b[3]] for ok, b in zip(passing, blocks, strict=True) if above[b[3]] and not inside[b[3]]):
            break
        node = up
        place()
    if page.tag[node] not in ("", "html", "body"):
        return "\n".join(b[0] for b in blocks if within[b[3]] and not below[b[3]])
    kept = [b[0] for ok, b in zip(passing, blocks, strict=True) if ok and not mark[b[3]]]
    return "\n".join(kept)


def main_text(source: str | None) -> str:
    """The article of a page; empty if there is none. A page whose whole body is a form is read without that rule."""
    if not source:
        return ""
    return _select(_Page(source)) or _select(_Page(source, drop_forms=False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars. A null html is empty and gives an empty text.

    Pages are read one by one: repeated rows give equal rows, ids and urls may be null, other columns are left out. Of
    elements of equal weight the later one in the page is followed. A page of any length takes time in proportion to it.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return plain.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_tag_path_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
