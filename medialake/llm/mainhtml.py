"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams a page's events; block-level tags cut it into lines, and
each line knows its text, its tags, its link text and the chain of elements that it stands in.
The ratio of text to tags per line is smoothed with a Gaussian over the neighbouring lines, and
lines above a threshold (the ratios' standard deviation, as far as it leaves any) are content.
The content region is all article elements that hold content, if most of it is in them, else the
main element, else the smallest element that holds all content lines but link lists; the headings
directly before it belong to it (not if it is an article or main element with an h1 of its own).  Inside it every line stays, short ones too, but for
lines in elements that say what they are (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments) and, outside articles, for link lists; only where no element below
the body holds the content, what precedes or follows all content lines goes too.

A class, id or role says what its element is if it is such a word or a compound that ends in
one ("cookie-notice", "sidebar-left"; not "has-sidebar", "no-ads", "related-work"); ids of
headings and sections in articles are mostly slugs of their titles and count only for comments
and the like, and a paragraph or heading in an article is beside only if it is named as an advert
or a comment.  "post-header" and its like hold an article's title.  An element named so is beside nothing that makes up the page: one that holds the
main element, all article elements, or most of the content (three lines at least) is taken for
a wrapper.  Comments are comments however long they are.

A page is a row: one pass, no shuffle, memory for one batch of pages.  Lines and elements know
the element above them, and what they hold is summed up from below once, so a page costs what it
is long, however deep its elements are.

Defined results: NULL and empty HTML give the empty string; markup that does not close is
closed by its parents or the end; a page whose every line is in excluded elements has no text;
repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                    "q rp rt ruby s samp small span strike strong sub sup time tt u var "
                    "math semantics annotation annotation-xml mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot "
                    "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
_UNSEEN = frozenset(("annotation", "annotation-xml"))  # a formula's source, which no reader sees
_DROPPED = frozenset("head script style noscript template svg iframe object nav aside footer form "
                     "button select textarea option menu dialog fieldset canvas audio video".split())
_NEVER_BY_NAME = frozenset("html body main".split())
_SMALL = frozenset("p li dt dd td th pre h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 "
                      "h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
              "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Words in class, id or role that name an element as something beside the article.
_BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar toc "
    "sidebar aside complementary widget widgets masthead footer contentinfo copyright "
    "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription "
    "signup login search share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored".split())
#: Articles named so are not the page's own.
_OTHER_ARTICLES = _COMMENTS | _ADVERTS | {"related", "recommended"}
#: Words before "header" that make it the head of an article.
_TITLED = frozenset("article content entry page post story".split())
#: Ids that hardly come from a title, also on a section in an article.
_NO_TITLE = _COMMENTS | {"ads", "advert", "breadcrumb", "breadcrumbs", "newsletter", "sidebar"}
#: Words after a name that leave it the element's own.
_GENERIC = frozenset("area articles bar block bottom box button buttons container content div inner item items left link "
                     "links list outer panel posts right section slot top unit wrap wrapper".split())
_MODIFIERS = frozenset("has hide is no non not with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WRAPS_LINES = 3
_SPLIT = re.compile(r"[^a-z0-9]+")
SIGMA, RADIUS = 1.0, 2
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


class Line:
    __slots__ = ("parts", "tags", "linked", "element", "beside", "text")

    def __init__(self, element):
        self.parts, self.tags, self.linked = [], 1, 0
        self.element, self.beside, self.text = element, element.beside, ""


class Element:
    """``block``: the nearest element, itself included, that is not inline; ``beside``: by the kind of
    an element above or of its own; ``named``: the nearest one, itself included, with such a name."""

    __slots__ = ("tag", "number", "above", "block", "beside", "inside", "named", "word", "length", "lines",
                 "articles", "mains")

    def __init__(self, tag, number, above, beside, word):
        self.tag, self.number, self.above, self.beside, self.word = tag, number, above, beside, word
        self.block = above.block if above is not None and tag in _INLINE else self
        self.inside = tag in ("article", "main") or (above is not None and above.inside)
        self.named = self if word is not None or above is None else above.named
        self.length = self.lines = self.articles = self.mains = 0


def _name(value: str) -> str | None:
    """The word by which a class, id or role says what its element is, or None."""
    for token in value.lower().split():
        words = [w for w in _SPLIT.split(token) if w]
        if not words or words[0] in _MODIFIERS:
            continue
        while len(words) > 1 and (words[-1] in _GENERIC or words[-1].isdigit()):
            words.pop()
        if words[-1] in _BESIDE or (words[-1] == "header" and not _TITLED.intersection(words)):
            return words[-1]
    return None


class LineEvents(HTMLParser):
    """Cuts a page into lines while its events stream by."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", 0, None, False, None)]  # the page, and all elements in the order they begin
        self.stack = [self.elements[0]]
        self.open: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.line: Line | None = None

    def _cut(self):
        if self.line is not None:
            self.line.text = " ".join("".join(self.line.parts).split())
            self.line.parts = []
            if self.line.text:
                self.lines.append(self.line)
            self.line = None

    def _here(self) -> Line:
        if self.line is None:
            self.line = Line(self.stack[-1])
        return self.line

    def _close_to(self, tags, limits):
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                self._cut()
                self._pop(i)
                return
            if t in limits or (t not in _INLINE and t not in ("p", "td", "th", "li", "dt", "dd")):
                return

    def _pop(self, i):
        for x in self.stack[i:]:
            self.open[x.tag] -= 1
        del self.stack[i:]

    def _is_beside(self, tag, attrs) -> bool:
        if tag in _DROPPED:
            return True
        if tag == "header":
            return not self.stack[-1].inside
        if tag in _NEVER_BY_NAME:
            return False
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)

    def _named(self, tag, attrs) -> str | None:
        if tag in _NEVER_BY_NAME:
            return None
        in_article = self.stack[-1].inside
        titled = in_article and (tag in _HEADINGS or tag == "section")
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                word = _name(value)
                if word is None or (word == "header" and in_article):
                    continue
                if tag == "article" and word not in _OTHER_ARTICLES:
                    continue
                if in_article and (tag == "p" or tag in _HEADINGS) and word not in _ADVERTS | _NO_TITLE:
                    continue
                if name == "id" and titled and (tag in _HEADINGS or value.lower().strip() not in _NO_TITLE):
                    continue
                return word
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._here().parts.append(" ")
            return
        if tag in _CLOSES_P:
            self._close_to(("p",), ())
        if tag in _CLOSED_BY:
            names, limits = _CLOSED_BY[tag]
            self._close_to(names.split(), limits)
        above = self.stack[-1]
        beside = above.beside or self._is_beside(tag, attrs)
        word = self._named(tag, attrs)
        if tag not in _INLINE or word is not None or beside != above.beside:
            self._cut()
        elif self.line is not None:
            self.line.tags += 1
        if tag in _VOID:
            return
        one = Element(tag, len(self.elements), above, beside, word)
        self.elements.append(one)
        self.stack.append(one)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:  # HTML knows no self-closing elements besides the void ones, but pages do
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        inline = tag in _INLINE
        for i in range(len(self.stack) - 1, 0, -1) if self.open[tag] else ():
            x = self.stack[i]
            if x.tag == tag:
                if not inline or x.word is not None or x.beside != x.above.beside:
                    self._cut()
                elif self.line is not None:
                    self.line.tags += 1
                self._pop(i)
                return
            if inline and x.tag not in _INLINE:
                return
        if not inline:
            self._cut()

    def handle_data(self, data):
        if self.line is None and not data.strip():
            return
        if self.stack[-1].tag in _UNSEEN:
            return
        line = self._here()
        line.parts.append(data)
        if self.open["a"]:
            line.linked += len(data.strip())


def _sum_up(elements: list[Element], lines: list[Line], flags: list[bool]) -> None:
    """For every element: how many content lines it holds and how long they are, and how many article
    and main elements that are not beside by kind."""
    for x in elements:
        x.lines = x.length = 0
        x.articles = int(x.tag in ("article", "main") and not x.beside)
        x.mains = int(x.tag == "main" and not x.beside)
    for line, content in zip(lines, flags):
        if content:
            line.element.lines += 1
            line.element.length += len(line.text)
    for x in reversed(elements[1:]):  # an element begins after the one above it
        for part in ("lines", "length", "articles", "mains"):
            setattr(x.above, part, getattr(x.above, part) + getattr(x, part))


def page_lines(page: str) -> tuple[list[Line], list[Element]]:
    """A page's lines, marked where they are beside, and its elements."""
    events = LineEvents()
    events.feed(page)
    events.close()
    events._cut()
    lines, elements = events.lines, events.elements
    if lines and any(x.word is not None for x in elements):
        _sum_up(elements, lines, content_flags(lines))
        whole = elements[0]
        away: list[bool] = []  # per element: it or one above is beside by name and no wrapper
        for x in elements:
            away.append((x.word is not None and not _is_wrapper(x, whole))
                        or (x.above is not None and away[x.above.number]))
        for line in lines:
            line.beside = line.beside or away[line.element.number]
    return lines, elements


def _is_wrapper(x: Element, whole: Element) -> bool:
    """Whether an element beside by name holds what the page is about: see above."""
    below = x.articles - (x.tag in ("article", "main") and not x.beside)
    return bool(x.mains) or (x.word not in _COMMENTS and (
        (below > 0 and below == whole.articles) or (x.lines >= WRAPS_LINES and 2 * x.length > whole.length)))


def smoothed_ratios(lines: list[Line]) -> list[float]:
    """Characters of text per tag, smoothed over the neighbouring lines."""
    raw = [len(x.text) / x.tags for x in lines]
    out = []
    for i in range(len(raw)):
        near = [(raw[i + d], k) for d, k in zip(range(-RADIUS, RADIUS + 1), _KERNEL) if 0 <= i + d < len(raw)]
        out.append(sum(v * k for v, k in near) / sum(k for _, k in near))
    return out


def content_flags(lines: list[Line]) -> list[bool]:
    """Lines of the high cluster: at or above the threshold, and not in an element beside."""
    ratios = smoothed_ratios(lines)
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    flags = [r >= threshold and not x.beside for r, x in zip(ratios, lines)]
    return flags if any(flags) else [not x.beside for x in lines]


def _region(lines: list[Line], elements: list[Element], flags: list[bool]) -> tuple[str, list[bool]]:
    """The kind of the region that holds the article (see above), and per element whether it is in it."""
    _sum_up(elements, lines, flags)
    whole = elements[0]
    for name in ("article", "main"):
        held = [x.number for x in elements if x.tag == name and x.lines]
        inside = _below(elements, set(held))
        if held and 2 * sum(len(x.text) for x, f in zip(lines, flags) if f and inside[x.element.number]) >= whole.length:
            return name, inside
    prose = [f and 2 * x.linked <= len(x.text) for x, f in zip(lines, flags)]
    if any(prose):
        _sum_up(elements, lines, prose)
    # The elements that hold all of it stand in each other; the last one to begin is the smallest.
    least = next(x for x in reversed(elements)
                 if x.lines == whole.lines and x.block is x and x.tag not in _SMALL)
    return least.tag, _below(elements, {least.number})


def _below(elements: list[Element], roots: set[int]) -> list[bool]:
    inside: list[bool] = []
    for x in elements:
        inside.append(x.number in roots or (x.above is not None and inside[x.above.number]))
    return inside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, elements = page_lines(page)
    if not any(not x.beside for x in lines):
        return ""
    flags = content_flags(lines)
    kind, within = _region(lines, elements, flags)
    shown = [i for i, x in enumerate(lines) if not x.beside]
    inside = [i for i in shown if within[lines[i].element.number]]
    if kind not in ("article", "main"):
        if kind in ("", "html", "body"):
            high = [i for i in inside if flags[i]]
            inside = [i for i in inside if high[0] <= i <= high[-1]]
        inside = [i for i in inside if flags[i] or 2 * lines[i].linked <= len(lines[i].text)]
    first = shown.index(inside[0])
    titled = kind in ("article", "main") and any(lines[i].element.block.tag == "h1" for i in inside)
    while not titled and first and lines[shown[first - 1]].element.block.tag in _HEADINGS:
        first -= 1
        inside.insert(0, shown[first])
    return "\n".join(lines[i].text for i in inside)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus text and n_chars (code points)."""
    rows = pages.select(*keep, pages[html].alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_extract_batches, f"{fields}, text string, n_chars long")
