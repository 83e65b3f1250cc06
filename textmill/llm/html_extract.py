"""Main text of web pages by text-to-tag ratio, from the events of the standard library's streaming parser.

Parser events are cut into lines at block elements. A line's ratio is the logarithm of its text outside links over its
tags. Mark-up is only a prior: a line in an article or main element gets BOOST more. Ratios are smoothed with a Gaussian
(not across the edge of an article), and a threshold splits them into two clusters. A region is an article or main
element, or elsewhere the nearest container (div, section, table cell, body); regions whose lines of the upper cluster
hold at least SHARE of their text are content, with all their lines, however short: a low ratio alone may be a short
paragraph or a heading. Lines between two of the same region stay too. Lines that are mostly links stay only in an
article or in the upper cluster.

Elements that are never main text (menus, headers, footers, sidebars, scripts, styles) have no lines. Forms, and what is
named as a notice, an advert or a comment, by a whole class or id or its last part (cookie-notice, but not
notice-period or has-sidebar), are left out unless all else on the page has under a quarter of their text: then they
wrap the page. If no article or main element is left, those in elements so named are taken back, but not comments.

Defined results: null, empty and textless pages give an empty text; broken markup is read as far as it goes (an
element that isn't closed ends with its parent, an end tag without a start is passed over); character references
are decoded; white space within a block becomes one space; blocks are joined by one line break. Repeated rows are
extracted each; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption tbody tfoot thead tr ul".split()
)
NEVER = frozenset(
    "head title script style noscript template nav header footer aside fieldset button select option textarea input label iframe object embed svg math canvas audio video map dialog menu search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
#: Classes, ids, and last parts of them, that mark what isn't main text.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert alerts nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pager pagination paywall disclaimer".split()
)
#: First parts that say something of an element's state, not what it is.
STATES = frozenset("has have with no not non without hide show".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
HEADER_NAMED = frozenset(("header", "topbar"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "article", "main", "body", "html"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("div section td th body html center blockquote dialog".split())
SIGMA = 1.0
#: Added to the log ratio in an article or main element; no threshold is above it.
BOOST = 8.0
SHARE, WRAPS = 0.25, 4
_PART = re.compile(r"(?<![^\W_])[^\W\d_]+")


def named(value: str) -> set[str]:
    """The last parts of the names in a class or id, but of those of a state."""
    parts = (_PART.findall(x) for x in value.lower().split())
    return {x[-1] for x in parts if x and x[0] not in STATES}


def excluded(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether what an element holds is no main text, by its name or role."""
    if tag in NEVER:
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value or tag in ("body", "html", "article", "main"):
            continue
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def unwanted(tag: str, attrs: list[tuple[str, str | None]], inner: bool) -> set[str]:
    """Names of an element that say that what it holds is no main text. inner: whether it is in an article or main element."""
    if tag in ("body", "html", "main") or (tag == "article" and not inner):
        return set()
    names = set().union(*(named(value) for name, value in attrs if value and name in ("class", "id")))
    return (names & NAMED) | (names & HEADER_NAMED if tag not in HEADING else set()) | ({"form"} if tag == "form" else set())


class Lines(HTMLParser):
    """Lines of a page: pieces of text with what may leave them out, number of tags, and region.

    What may leave text out is a number of `outs`: (the one around it, its names, whether an article is in it), -1 for none.
    Regions are numbered; `marked` says which are article or main elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # pieces (text, out, link), tags, region
        self.outs: list[tuple[int, set[str]]] = []
        self.marked: list[bool] = [False]
        self.around: list[int] = [-1]  # by region, what may leave the element itself out
        self.stack: list[tuple[str, bool, int, int, bool]] = []  # element, whether its text is never read, out, region, link
        self.open: Counter[str] = Counter()
        self.parts: list[tuple[str, int, bool]] = []
        self.count = 0

    def _cut(self) -> None:
        if any(p[0].strip() for p in self.parts):
            self.lines.append((self.parts, self.count, self.stack[-1][3] if self.stack else 0))
            self.parts = []
            self.count = 0
        else:
            self.parts.clear()

    def _pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        block = tag in BLOCK
        if block:
            self._cut()
            if self.open["p"] and tag != "p" and self.stack[-1][0] == "p":
                self._pop()
        else:
            if tag in ("br", "td", "th"):
                self.parts.append((" ", self.stack[-1][2] if self.stack else -1, False))
        if tag in VOID:
            return
        if tag == "p" and self.open["p"]:
            # an open paragraph ends here, unless another block stands between
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    inline = self.stack[i + 1 :]
                    del self.stack[i:]
                    self.open["p"] -= 1
                    for x in inline:
                        self.open[x[0]] -= 1
                    break
                if self.stack[i][0] in BLOCK:
                    break
        for _ in range(2):
            if self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
                self._pop()
        _, never, out, region, link = self.stack[-1] if self.stack else ("", False, -1, 0, False)
        names = unwanted(tag, attrs, self.marked[region])
        if names:
            self.outs.append((out, names))
            out = len(self.outs) - 1
        main = tag in ("article", "main")
        if (main and not (self.marked[region] and self.around[region] == out)) or (tag in CONTAINERS and not self.marked[region]):
            region = len(self.marked)
            self.marked.append(main)
            self.around.append(out)
        self.stack.append((tag, never or excluded(tag, attrs), out, region, link or (tag == "a" and any(name == "href" for name, _ in attrs))))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't close an element of HTML

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if tag in BLOCK:
            self._cut()
        if self.open[tag] > 0:
            while self.stack:
                found = self.stack[-1][0] == tag
                self._pop()
                if found:
                    break

    def handle_data(self, data: str) -> None:
        _, never, out, _, link = self.stack[-1] if self.stack else ("", False, -1, 0, False)
        if not never:
            self.parts.append((data, out, link))

    def end(self) -> None:
        self.close()
        self._cut()

    def left_out(self) -> list[bool]:
        """Which of `outs` leave their text out."""
        own = [0] * len(self.outs)
        rest = 0
        for parts, _, _ in self.lines:
            for text, out, link in parts:
                n = 0 if link else len(text) - text.count(" ")
                if out < 0:
                    rest += n
                while out >= 0:
                    own[out] += n
                    out = self.outs[out][0]
        gone = [False] * len(self.outs)
        for i, (above, _) in enumerate(self.outs):  # the one around comes first
            gone[i] = (above >= 0 and gone[above]) or WRAPS * rest >= own[i]
        here = {r for _, _, r in self.lines if self.marked[r]}
        if not any(self.around[r] < 0 or not gone[self.around[r]] for r in here):
            for r in here:
                chain, out = [], self.around[r]
                while out >= 0:
                    chain.append(out)
                    out = self.outs[out][0]
                if not any(self.outs[o][1] & COMMENTS for o in chain):
                    for o in chain:
                        gone[o] = False
        return gone


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the edges are continued with their values."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters of values: the mean of the means of either side, until it stays."""
    cut = float(values.mean())
    for _ in range(20):
        upper = values > cut
        if upper.all() or not upper.any():
            break
        new = float(values[upper].mean() + values[~upper].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def content(texts: list[str], tags: list[int], linked: list[int], regions: list[int], marked: list[bool], sigma: float = SIGMA) -> np.ndarray:
    """Which lines are main text. linked: how much of a line is text of links."""
    if not texts:
        return np.zeros(0, bool)
    size = np.array([len(t) for t in texts])
    inside = np.array([marked[r] for r in regions])
    region = np.unique(regions, return_inverse=True)[1]
    plain = size - np.minimum(linked, size)
    ratio = np.log1p(plain / np.maximum(1, np.array(tags))) + BOOST * inside
    edges = [0, *(np.flatnonzero(inside[1:] != inside[:-1]) + 1).tolist(), len(ratio)]
    smooth = np.concatenate([smoothed(ratio[a:b], sigma) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    cut = min(threshold(smooth), float(smooth.max()), BOOST)
    upper = (smooth >= cut) & (ratio >= min(cut, float(ratio.max())))  # smoothing lifts the lines beside long ones
    links = 2 * np.array(linked) > size
    held = np.bincount(region, np.where(upper, size, 0)) >= SHARE * np.bincount(region, size)
    keep = held[region] & (inside | upper | ~links)
    first, last = np.full(region.max() + 1, len(texts)), np.full(region.max() + 1, -1)
    at = np.flatnonzero(keep)
    np.minimum.at(first, region[at], at)
    np.maximum.at(last, region[at], at)
    cover = np.zeros(len(texts) + 1, int)  # lines between two kept ones of a region outside articles
    spans = [(a, b) for r, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)) if b > a and not inside[a]]
    for a, b in spans:
        cover[a] += 1
        cover[b] -= 1
    return keep | ((np.cumsum(cover)[:-1] > 0) & ~links & ~inside)


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.end()
    gone = page.left_out()
    texts, tags, linked, regions = [], [], [], []
    for parts, count, region in page.lines:
        stay = [p for p in parts if p[1] < 0 or not gone[p[1]]]
        text = " ".join("".join(p[0] for p in stay).split())
        if text:
            texts.append(text)
            tags.append(count)
            linked.append(sum(len(p[0]) - p[0].count(" ") for p in stay if p[2]))
            regions.append(region)
    keep = content(texts, tags, linked, regions, page.marked, sigma)
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def _extractor(html: int, names: list[str], sigma: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, sigma) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return run


def extract(pages: DataFrame, html_col: str = "html", sigma: float = SIGMA) -> DataFrame:
    """pages with the column text (a name in use is lengthened)."""
    schema = T.StructType([*pages.schema.fields, T.StructField(free_name(pages, "text"), T.StringType(), False)])
    return pages.mapInArrow(_extractor(pages.columns.index(html_col), schema.names, sigma), schema)
