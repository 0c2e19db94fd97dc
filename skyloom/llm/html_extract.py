"""Main-text extraction: parser events, text-to-tag ratio per line, smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one per block element, with
their text outside of links, their number of tags and the container they stand in. End tags that
HTML lets authors leave out (p, li, td, dt...) are supplied. Lines inside boilerplate elements
(scripts, menus, page headers, footers, sidebars, notices, adverts, forms, comments) have ratio
0. The ratios are smoothed by a Gaussian over neighbouring lines, so a short line amid
paragraphs rises and a lone sentence amid links falls, and split into two clusters (two means of
their logarithms). The upper cluster, without lines of links at its edges, shows where the content is:

* if most of its text stands in ``article`` and ``main`` elements, these are the content, whole;
* otherwise every container (section, div, td) of a content line is, with all that is nested in it
  but lines outside the cluster that are mostly links. Of the body's own lines only those in the
  cluster and headings right before them are content.

A form, page header or element with a layout name (``header``, ``sidebar``...) that turns out to
hold all paragraphs of a page is a wrapper and its mark is ignored; class names count as a whole
(``has-sidebar`` and ``header-fixed`` name a layout, not a sidebar or header).

Defined cases: a null page is empty; pages of any length are parsed whole; broken or unclosed
markup is read as far as it goes; a page without content has the text ""; repeated rows are
extracted one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import table

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Share of a line's text in links from which the line is a link list.
LINKS = 0.5

#: HTML element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("article main section div body td th center".split())
WHOLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li dd td article main section".split())
DROPPED = frozenset("aside button canvas dialog fieldset footer form head header iframe input label menu nav noscript object option script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag ends, and the elements that keep them open.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ()),
}
#: Names of boilerplate in class and id; of the first ones only layouts are named, too.
LAYOUT_NAMES = frozenset("header masthead menu nav navbar navigation sidebar toolbar banner widget popup promo share sharing social".split())
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer newsletter notice related respond sponsor sponsored subscribe".split())
STATES = frozenset("has with no is not without".split())
LAYOUTS = frozenset("body container content fixed hidden layout open page sticky wrap wrapper".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())


def named(value: str) -> str:
    """"layout" or "other" where a class or id list names boilerplate: one of its names is such a word,
    or begins or ends with one and states no layout; else ""."""
    found = ""
    for name in value.lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] in STATES or not LAYOUTS.isdisjoint(parts):
            continue
        if parts[0] in OTHER_NAMES or parts[-1] in OTHER_NAMES:
            return "other"
        if parts[0] in LAYOUT_NAMES or parts[-1] in LAYOUT_NAMES:
            found = "layout"
    return found


def mark(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> str:
    """Whether an element is boilerplate: "other" for certain, "layout" unless it wraps the page, or ""."""
    if tag == "header" and inside_article:  # holds the article's heading
        return ""
    if tag in DROPPED:
        return "layout" if tag in ("form", "header", "fieldset") else "other"
    if tag in ("body", "html", "article", "main"):
        return ""
    found = ""
    for name, value in attrs:
        if name in ("class", "id") and value:
            kind = named(value)
            found = kind if kind == "other" else found or kind
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "other"
    return found


class Lines(HTMLParser):
    """Collects the lines of a page and the tree of its containers and marked elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False
        # by line: text, tags, characters in links, region, innermost mark, innermost block
        self.lines: list[tuple[str, int, int, int, int, str]] = []
        # by region: element, region around it; region 0 is the page
        self.regions: list[tuple[str, int]] = [("", 0)]
        # by mark: kind, mark around it; mark 0 is none
        self.marks: list[tuple[str, int]] = [("", 0)]
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # open element, its region and mark

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            tag, region, marked = self.stack[-1]
            self.lines.append((text, max(1, self.tags), min(len(text), self.linked), region, marked, tag))
        self.text, self.tags, self.linked = [], 0, 0

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in scope:
                return
            if self.stack[k][0] in tags:
                self._end_line()
                del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self._end_line()
            if tag != "option":  # no block stands in a paragraph
                self._close(("p",), ("article", "body", "div", "section", "td", "th", "li", "blockquote", "button", "table"))
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.in_link = True
        self.tags += 1
        if tag in VOID:
            return
        _, region, marked = self.stack[-1]
        kind = mark(tag, attrs, self.regions[region][0] in WHOLE)
        if not block and not kind:
            return  # inline elements open nothing
        if kind:
            if not block:
                self._end_line()
            self.marks.append((kind, marked))
            marked = len(self.marks) - 1
        if tag in REGIONS and self.regions[region][0] not in WHOLE:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.stack.append((tag, region, marked))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._end_line()
                del self.stack[k:]
                return
            if self.stack[k][0] in ("article", "body", "html") and tag not in ("body", "html"):
                return  # a stray end tag closes nothing outside the article
        if tag in BLOCKS:
            self._end_line()

    def handle_data(self, data):
        self.text.append(data)
        if self.in_link:
            self.linked += len(data)

    def finish(self) -> list[tuple[str, int, int, int, int, str]]:
        self.close()
        self._end_line()
        return self.lines


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a Gaussian, cut at three sigmas and renormalised at the ends."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, w)[r : r + len(x)] / np.convolve(np.ones(len(x)), w)[r : r + len(x)]


def level(smoothed: np.ndarray) -> float:
    """Where two clusters of the values part: two means of their logarithms, from the extremes."""
    x = np.log1p(smoothed)
    low, high = x.min(), x.max()
    while True:
        cut = (low + high) / 2
        upper = x >= cut
        if upper.all():
            return float(smoothed.min())
        new = x[~upper].mean(), x[upper].mean()
        if new == (low, high):
            return float(np.expm1(cut))
        low, high = new


def dropped_marks(page: Lines) -> list[bool]:
    """By mark, whether lines inside are boilerplate. Layout marks are lifted from outside in while
    no paragraph of the page stands outside of all marks."""
    lifted: set[int] = set()
    while True:
        gone = [False] * len(page.marks)
        outer = [0] * len(page.marks)  # the outermost mark in force
        for k, (_, around) in enumerate(page.marks[1:], 1):
            gone[k] = gone[around] or k not in lifted
            outer[k] = outer[around] or (0 if k in lifted else k)
        paragraphs = [(len(text), marked) for text, _, _, _, marked, tag in page.lines if text and tag in PARAGRAPHS]
        if not paragraphs or not all(gone[marked] for _, marked in paragraphs):
            return gone
        held: dict[int, int] = {}
        for size, marked in paragraphs:
            if page.marks[outer[marked]][0] == "layout":
                held[outer[marked]] = held.get(outer[marked], 0) + size
        if not held:
            return gone
        lifted.add(max(held, key=lambda k: (held[k], -k)))


def ratios(page: Lines, gone: list[bool]) -> np.ndarray:
    """Text outside of links per tag of every line; 0 in boilerplate. Where links hold all text, it counts."""
    count = lambda linked: np.array([0.0 if gone[m] else (len(t) - linked * k) / n for t, n, k, _, m, _ in page.lines])
    found = count(1)
    return found if found.any() else count(0)


def extract(html: str) -> str:
    """The main text of a page: its content blocks joined by line feeds."""
    page = Lines()
    page.feed(html)
    lines = page.finish()
    if not lines:
        return ""
    gone = dropped_marks(page)
    ratio = ratios(page, gone)
    if not ratio.any():
        return ""
    smoothed = smooth(ratio)
    content = (smoothed >= level(smoothed)) & (ratio > 0)
    links = np.array([k > LINKS * len(t) for t, _, k, _, _, _ in lines])
    text = np.concatenate([[False], content & ~links, [False]])
    content &= ~links | text[:-2] & text[2:]  # a line of links beside the text isn't part of it, one amid the text is
    if not content.any():
        content = ratio == ratio.max()
    whole = [False] * len(page.regions)  # in an article
    for k, (tag, around) in enumerate(page.regions[1:], 1):
        whole[k] = whole[around] or tag in WHOLE
    size = np.array([len(line[0]) for line in lines])
    in_article = np.array([whole[line[3]] for line in lines])
    if 2 * size[content & in_article].sum() >= size[content].sum():
        kept = in_article
    else:
        chosen = [False] * len(page.regions)
        for line, c in zip(lines, content, strict=True):
            chosen[line[3]] |= bool(c)
        own = [tag in ("", "body") for tag, _ in page.regions]
        for k, (tag, around) in enumerate(page.regions[1:], 1):  # outer regions come first
            chosen[k] |= chosen[around] and (not own[around] or tag in ("td", "th"))
        kept = np.array([chosen[line[3]] and not own[line[3]] for line in lines]) & ~(links & ~content) | content
        wanted = False
        for k in range(len(lines) - 1, -1, -1):  # headings of what follows
            text, marked, tag = lines[k][0], lines[k][4], lines[k][5]
            if wanted and text and tag in HEADINGS and not gone[marked]:
                kept[k] = True
            elif text:
                wanted = bool(kept[k])
    return "\n".join(line[0] for line, k in zip(lines, kept, strict=True) if k and line[0] and not gone[line[4]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its length in code points."""
    return pages.select("page_id", "url", "html").mapInArrow(_rows, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
