"""Main-text extraction from HTML (operator 2).

A streaming standard-library parser turns a page into lines, one per block. Each line has a text-to-tag ratio: its
characters outside links over the tags met since the line before, on a logarithmic scale, and nought in page furniture. The
ratios are smoothed by a Gaussian and split in two by a clustered threshold; lines above it are marked. Regions come from the
marks: the article and main elements of a page where they hold most of the marked text, else every container whose own text
is mostly marked, with the headings between such containers. All lines of a region that are not furniture are the text,
however short they are.

Furniture is what its element or role says it is. A class or id counts only if all its words are those of furniture or say
where something stands ("sidebar-left", not "layout with-sidebar"), never for an element that holds an article or main, and
for ambiguous words only where the ratios and links agree.

Scale: one pass, no shuffle; a page is the only state. An element is a number with its parent's, a line names the deepest one it
is in, and an open element carries what its ancestors are, so memory is linear in the page however deep it nests. What can't
be markup any more (an unclosed tag at a page's end) is cut before parsing, which keeps the time linear as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements whose content is never article text.
FURNITURE = frozenset("script style noscript template head nav footer aside form button select option textarea input iframe svg canvas object embed applet audio video map menu dialog datalist fieldset noframes".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars aside nav navbar navigation"
    " breadcrumb breadcrumbs footer foot masthead topbar cookie cookies consent gdpr popup modal newsletter social share sharing comment comments commentlist disqus replies respond paywall".split()
)
#: Words that name furniture only where little of the element's text is marked, or much of it is linked.
AMBIGUOUS_WORDS = frozenset(
    "menu menus header toolbar notice notices alert overlay subscribe subscription related recommended widget widgets login signin signup register search pagination pager form disclaimer skip reply".split()
)
#: Words that say where something stands or what it is made of.
PLACE_WORDS = frozenset(
    "site main page post posts article articles blog global primary secondary top bottom left right side inner outer wrap wrapper container box block list item items section area bar content group user reader"
    " readers the a of and to in on for new latest more links link".split()
)
CONTAINERS = frozenset("article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that belong to the text of what they stand in and are no region of their own.
TEXT_BLOCKS = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption details summary hgroup address center".split())
#: Lines of so many characters a tag are prose, whatever the other lines are.
PROSE = 40
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class _Open(NamedTuple):
    """An open element. The last three are true of it or of an ancestor."""

    tag: str
    number: int
    furniture: bool
    article: bool
    link: bool


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, deepest element's number) for every block of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.kind: list[str] = []  # tag by number
        self.parent: list[int] = []  # parent by number, -1 for none; parents have smaller numbers
        self.certain: list[bool] = []  # furniture by number
        self.named: list[int] = []  # by number: 2 if its class or id names furniture, 1 if by an ambiguous word
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def top(self) -> _Open:
        return self.open[-1] if self.open else _Open("", -1, False, False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.top().number))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self.implied(tag)
        if tag in VOID:
            return
        up = self.top()
        certain, named = self.is_furniture(tag, attrs), self.names_furniture(tag, attrs)
        apart = certain or named == 2
        if tag in INLINE and apart and not up.furniture:
            self.flush()
        self.open.append(_Open(tag, len(self.kind), up.furniture or apart, up.article or tag in ("article", "main"), up.link or tag == "a"))
        self.kind.append(tag)
        self.parent.append(up.number)
        self.certain.append(certain)
        self.named.append(named)

    def implied(self, tag: str) -> None:
        """Ends the elements that the start of another one ends without an end tag."""
        if tag in CLOSES:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in SCOPES[tag]:
                    break
                if self.open[i].tag in CLOSES[tag]:
                    del self.open[i:]
                    break
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == "p":
                del self.open[i:]
                break
            if self.open[i].tag not in INLINE:
                break

    def is_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether element, role or visibility make it furniture."""
        if tag in FURNITURE:
            return True
        if tag == "header":
            return not self.top().article
        if tag in CONTAINERS or tag == "html":
            return False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and (v or "").lower() in FURNITURE_ROLES:
                return True
            if k == "style" and "display:none" in (v or "").replace(" ", "").lower():
                return True
        return False

    def names_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        inside, out = self.top().article, 0
        if tag in ("html", "body", "main") or tag in HEADINGS and inside or tag == "article" and not inside:
            return 0
        for k, v in attrs:
            if k in ("class", "id") and v:
                for one in v.split():
                    words = set(_WORD.findall(_HUMP.sub(" ", one).lower()))
                    if words <= FURNITURE_WORDS | AMBIGUOUS_WORDS | PLACE_WORDS:
                        out = max(out, 2 if words & FURNITURE_WORDS else 1 if words & AMBIGUOUS_WORDS else 0)
        return out

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                if tag not in INLINE or self.open[i].furniture and not (i and self.open[i - 1].furniture):
                    self.flush()
                del self.open[i:]
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.top().link:
            self.linked += len(data.strip())


_WORD, _HUMP = re.compile(r"[^\W\d_]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMENT, _OPENS = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<[A-Za-z/!?]")


def _closed(html: str) -> str:
    """The page without comments and without a last tag that never ends."""
    if "<!--" in html:
        html = _COMMENT.sub("", html)
    if m := _OPENS.search(html, html.rfind(">") + 1):
        html = html[: m.start()]
    return html


def _parsed(html: str) -> _Lines:
    html = _closed(html)
    for text in (html, html.replace("<![", "&lt;![")):
        p = _Lines()
        try:
            p.feed(text)
            p.close()
        except AssertionError:  # a malformed marked section
            continue
        p.flush()
        return p
    return p


def smoothed(x: list[float], sigma: float = 1.0) -> list[float]:
    """x under a Gaussian of three sigma on each side; beyond the ends it is nought."""
    reach = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    total = sum(w)
    return [sum(w[d + reach] * x[i + d] for d in range(-reach, reach + 1) if 0 <= i + d < len(x)) / total for i in range(len(x))]


def threshold(x: list[float]) -> float:
    """The bound between two clusters of x: two-means on one line, from its ends."""
    lo, hi = min(x), max(x)
    for _ in range(50):
        mid = (lo + hi) / 2
        a, b = [v for v in x if v < mid], [v for v in x if v >= mid]
        new = (sum(a) / len(a) if a else lo, sum(b) / len(b) if b else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def _furniture(p: _Lines, named: list[int], least: int) -> list[bool]:
    """By element: whether it or an ancestor is furniture for certain or is named so at `least`."""
    out: list[bool] = []
    for n, up in enumerate(p.parent):
        out.append(up >= 0 and out[up] or p.certain[n] or named[n] >= least)
    return out


def marked(lines: list[tuple[int, int, int]], sigma: float = 1.0) -> list[bool]:
    """Which lines (characters, tags, linked characters; no characters for furniture) are above the clustered threshold."""
    smooth = smoothed([math.log1p(max(0, size - linked) / max(1, tags)) for size, tags, linked in lines], sigma)
    bound = min(threshold(smooth), math.log1p(PROSE))
    return [s >= bound and size > 0 for s, (size, _, _) in zip(smooth, lines, strict=True)]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page: its blocks in page order, joined by a newline; empty for null, empty or textless pages."""
    if not html:
        return ""
    p = _parsed(html)
    count = len(p.kind)
    parts = list(zip(p.kind, p.parent, strict=True))
    holds = [k in ("article", "main") for k in p.kind]
    for n in range(count - 1, -1, -1):
        if p.parent[n] >= 0:
            holds[p.parent[n]] |= holds[n]
    named = [0 if h and k != "article" else c for h, k, c in zip(holds, p.kind, p.named, strict=True)]
    off = _furniture(p, named, 2)
    is_off = lambda at: at >= 0 and off[at]
    if all(is_off(at) for *_, at in p.lines):
        return ""
    above = marked([(0 if is_off(at) else len(text), tags, linked) for text, tags, linked, at in p.lines], sigma)
    size, mass, links = [0] * count, [0] * count, [0] * count
    for (text, _, linked, at), m in zip(p.lines, above, strict=True):
        if at >= 0 and not off[at]:
            size[at], mass[at], links[at] = size[at] + len(text), mass[at] + m * len(text), links[at] + linked
    own_size, own_mass = [0] * (count + 1), [0] * (count + 1)
    region: list[int] = []  # the nearest container, by element
    for n, (kind, up) in enumerate(parts):
        region.append(n if kind not in INLINE and kind not in TEXT_BLOCKS else region[up] if up >= 0 else -1)
        own_size[region[n]] += size[n]
        own_mass[region[n]] += mass[n]
    for n in range(count - 1, -1, -1):
        if (up := p.parent[n]) >= 0:
            size[up], mass[up], links[up] = size[up] + size[n], mass[up] + mass[n], links[up] + links[n]
    # Ambiguous names count where the ratios or the links agree with them.
    named = [2 if c == 1 and (2 * mass[n] < size[n] or 10 * links[n] > 3 * size[n]) else c for n, c in enumerate(named)]
    off = _furniture(p, named, 2)
    total = sum(len(text) for (text, *_, at), m in zip(p.lines, above, strict=True) if m and not is_off(at))
    outer = [False] * count
    within, listed = [False] * count, [False] * count
    for n, (kind, up) in enumerate(parts):
        outer[n] = kind in ("article", "main") and not off[n] and not (up >= 0 and within[up])
        within[n] = outer[n] or up >= 0 and within[up]
        listed[n] = kind in ("li", "ul", "ol", "td") or up >= 0 and listed[up]
    if any(outer) and 2 * sum(mass[n] for n in range(count) if outer[n]) >= total:
        return "\n".join(text for text, *_, at in p.lines if at >= 0 and within[at] and not off[at])
    content = [own_mass[n] > 0 and 2 * own_mass[n] >= own_size[n] for n in range(count)]
    # Between the containers of content stand those that hold several of them; of these the headings belong to the text.
    branches = [int(c) for c in content]
    for n in range(count - 1, -1, -1):
        if p.parent[n] >= 0:
            branches[p.parent[n]] += branches[n] > 0
    out = []
    for (text, _, linked, at), m in zip(p.lines, above, strict=True):
        if is_off(at):
            continue
        r = region[at] if at >= 0 else -1
        if not m and linked > 0.8 * len(text) and at >= 0 and listed[at]:
            continue
        heading = at >= 0 and r >= 0 and branches[r] > 0 and p.kind[at] in HEADINGS
        if m and r < 0 or r >= 0 and content[r] or heading or r < 0 and not any(content):
            out.append(text)
    return "\n".join(out)


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        text = [main_text(x.decode("utf-8", "replace") if x is not None else None) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row. A null or empty page has an empty text; ids and urls pass unchanged, null
    or repeated; malformed markup is read as far as the parser goes, and a last tag that never ends is dropped; no pages give
    no rows; other columns are ignored."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").cast("binary").alias("html"))
    return slim.mapInArrow(_kernel, "page_id bigint, url string, text string, n_chars bigint")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
