"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser sends events; nothing of the page but its lines is kept.
A line is the text between two block boundaries, white space collapsed, with the number
of tags since the line before, how much of it is link text, and the containers that it
stands in. Elements that never hold article text (scripts, styles, menus, page footers,
sidebars, hidden parts) are left out by their name or role.

1. Ratio: every line's characters outside of links by its tags; 0 for lines left out.
2. Smoothing: a Gaussian over the lines, so that headings and short lines between long
   paragraphs rise and lone long lines between menus fall.
3. Threshold clustering: what reaches ``SPREAD`` standard deviations of the smoothed ratios
   is marked as content.
4. Evidence: a line is worth its characters, ``MARKED`` times them if it is marked,
   ``SEMANTIC`` times that within ``article`` or ``main``. A container that looks by class,
   id or element like a form, header, sidebar, advert or comment section is left out only
   if others have evidence too: one that holds ``WRAPPER`` of all of it (comments:
   ``DISCUSSION``) is a wrapper of the content whatever its name.
5. Region: from the page down to the container that holds ``SHARE`` of its parent's evidence,
   until none does, or to an ``article`` or ``main``. All of the region's lines stay, short
   ones too, save lists of links in a region found by evidence alone; there, marked headings
   and marked long lines beside the region stay as well.

Defined results: null or empty html gives ''; unclosed and misnested tags are closed by
the next boundary of an outer element; a page without any line outside of menus, footers,
scripts and the like gives ''; a page that ends within a tag loses that tag, while a ``<`` that
begins none is text; repeated rows give repeated results; an empty table gives an empty
one; columns named text or n_chars are replaced, others stay. A page costs its text, its
lines and its elements, however deeply these are nested: a line knows its innermost element,
an element its parent, and sums over elements are carried up once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import need

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose text is never the article's.
EXCLUDED = frozenset(
    "head script style noscript template nav footer aside button select textarea iframe object svg canvas dialog menu "
    "title audio video map datalist".split()
)
#: Elements that may hold a whole page, but mostly don't hold its article.
DOUBTFUL = frozenset(("form", "header"))
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
#: Parts of class names and ids of containers without article text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer masthead cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "pagination pager toolbar skip".split()
)
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset("html body div section article main center table tbody tr td form header span".split())
SIGMA, SPREAD = 1.5, 0.5
MARKED, SEMANTIC, WRAPPER, DISCUSSION, SHARE = 10, 100, 0.8, 0.98, 2 / 3
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAMED = re.compile(r"<([A-Za-z][A-Za-z0-9]*)")
_ATTRIBUTE = re.compile(r"\s[A-Za-z-]+\s*=")


class Line:
    """Text between block boundaries; ``node`` is the number of its innermost open element."""

    __slots__ = ("text", "tags", "linked", "excluded", "region", "node", "tag")

    def __init__(self, text, tags, linked, excluded, region, node, tag):
        self.text, self.tags, self.linked, self.excluded, self.region, self.node, self.tag = text, tags, linked, excluded, region, node, tag

    def ratio(self) -> float:
        return 0.0 if self.excluded else max(0, len(self.text) - self.linked) / self.tags

    def is_link(self) -> bool:
        return 2 * self.linked > len(self.text)


class Open:
    """An open element: what of it its lines inherit.

    ``wall`` is the place among the open elements of the innermost block, ``block`` the
    innermost tag that isn't an inline one.
    """

    __slots__ = ("tag", "excluded", "region", "number", "link", "wall", "block")

    def __init__(self, tag, excluded, region, number, link, wall, block):
        self.tag, self.excluded, self.region, self.number, self.link, self.wall, self.block = tag, excluded, region, number, link, wall, block


class PageLines(HTMLParser):
    """Collects the lines of one page, and what is doubtful or a container of its elements.

    Elements are numbered as they open, so that an element's parent has a smaller number.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # region: the number of the outermost article or main
        self.open: list[Open] = [Open("", False, 0, 0, False, 0, "")]
        self.open_tags = Counter()
        self.tag_of: list[str] = [""]
        self.parent: list[int] = [0]
        #: number of each doubtful element: the share of the evidence that makes it a wrapper
        self.doubtful: dict[int, float] = {}
        self.held: list[str] = []
        self.linked = 0
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if tag == "p" or tag in HEADINGS or tag == "li":
            self._close_implied(tag)
        outer = self.open[-1]
        number = len(self.tag_of)
        self.tag_of.append(tag)
        self.parent.append(outer.number)
        region = outer.region or (number if tag in CONTENT else 0)
        excluded = outer.excluded or tag in EXCLUDED or self._hidden(tag, attrs)
        if not excluded and (doubt := self._doubt(tag, attrs, bool(outer.region))):
            self.doubtful[number] = doubt
        wall = len(self.open) if tag in BLOCK else outer.wall
        self.open.append(Open(tag, excluded, region, number, outer.link or tag == "a", wall, outer.block if tag in INLINE else tag))
        self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self._flush()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        if self.open_tags[tag]:
            while self.open[-1].tag != tag:
                self._pop()
            self._pop()

    def _pop(self):
        self.open_tags[self.open.pop().tag] -= 1

    def handle_data(self, data):
        self.held.append(data)
        if self.open[-1].link:
            self.linked += len(" ".join(data.split()))

    def parse_marked_section(self, i, report=1):
        """Sections such as <![if x]> are comments up to the next >; the parser's own rule raises."""
        return self.rawdata.find(">", i) + 1 or -1

    def close(self):
        super().close()
        self._flush()

    def _close_implied(self, tag):
        """A paragraph ends before the next block, a list item before the next item."""
        wall = self.open[-1].wall
        if wall and self.open[wall].tag == ("li" if tag == "li" else "p"):
            while len(self.open) > wall:
                self._pop()

    @staticmethod
    def _hidden(tag, attrs) -> bool:
        if not attrs or tag in ("html", "body"):
            return False
        given = dict(attrs)
        if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ROLES:
            return True
        return bool((style := given.get("style")) and _HIDDEN.search(style))

    @staticmethod
    def _doubt(tag, attrs, inside: bool) -> float:
        """The share that lets an element pass although its name speaks against it, 0 if none does."""
        if tag == "header" and inside:
            return 0.0  # an article's own header holds its title; its other lines are told by name
        if tag in DOUBTFUL:
            return WRAPPER
        if not attrs or tag in ("html", "body", "main") or tag in INLINE and tag != "span":
            return 0.0
        names = {p.lower() for k, v in attrs if k in ("class", "id") and v for p in _PART.findall(v)}
        if names & COMMENTS:
            return DISCUSSION
        return WRAPPER if names & HINTS and tag != "article" and not tag in HEADINGS else 0.0

    def _flush(self):
        if not self.held:
            return
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            inner = self.open[-1]
            self.lines.append(Line(text, max(1, self.tags), min(self.linked, len(text)), inner.excluded, inner.region, inner.number, inner.block))
            self.tags = 0
        self.linked = 0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach)
    within = np.pad(np.ones(len(ratios)), reach)
    return np.convolve(padded, weight, "valid") / np.convolve(within, weight, "valid")


def _summed(lines: list[Line], worth: list[int], parent: list[int]) -> list[int]:
    """The worth of the lines within each element, by its number; 0 is the page."""
    mass = [0] * len(parent)
    for line, own in zip(lines, worth, strict=True):
        mass[line.node] += own
    for number in range(len(parent) - 1, 0, -1):
        mass[parent[number]] += mass[number]
    return mass


def _within(roots: set[int], parent: list[int]) -> list[bool]:
    """For each element whether it is one of ``roots`` or stands in one."""
    inside = [0 in roots] * len(parent)
    for number in range(1, len(parent)):
        inside[number] = number in roots or inside[parent[number]]
    return inside


def _region(mass: list[int], page: PageLines) -> int:
    """The container that holds most evidence, as far down as one does."""
    best = [0] * len(mass)  # of each element's children the one with most evidence, the first of equals
    for number in range(1, len(mass)):
        outer = page.parent[number]
        if mass[number] > (mass[best[outer]] if best[outer] else 0):
            best[outer] = number
    at = 0
    while page.tag_of[at] not in CONTENT:
        inner = best[at]
        if not inner or page.tag_of[inner] not in CONTAINERS or mass[inner] < SHARE * mass[at]:
            break
        at = inner
    return at


def content_lines(page: PageLines) -> list[Line]:
    free = [line for line in page.lines if not line.excluded]
    if not free:
        return []
    ratios = np.array([line.ratio() for line in page.lines])
    smooth = smoothed(ratios)
    limit = SPREAD * smooth.std()
    raised = {id(line) for line, s in zip(page.lines, smooth, strict=True) if not line.excluded and s >= limit}

    def evidence(lines: list[Line]) -> list[int]:
        worth = [len(line.text) * (MARKED if id(line) in raised else 1) * (SEMANTIC if line.region else 1) for line in lines]
        return _summed(lines, worth, page.parent)

    mass = evidence(free)
    if page.doubtful:
        gone = _within({n for n, share in page.doubtful.items() if mass[n] < share * mass[0]}, page.parent)
        free = [line for line in free if not gone[line.node]]
        mass = evidence(free)
    at = _region(mass, page)
    inside = _within({at}, page.parent)
    if page.tag_of[at] in CONTENT:
        return [line for line in free if inside[line.node]]

    size = _summed(free, [1] * len(free), page.parent)
    plain = _summed(free, [not line.is_link() for line in free], page.parent)
    menu = _within({n for n, k in enumerate(size) if k > 2 and not plain[n]}, page.parent)
    long = {id(line) for line, r in zip(page.lines, ratios, strict=True) if r >= limit or line.tag in HEADINGS}
    kept = []
    for line in free:
        beside = id(line) in raised and id(line) in long and not line.is_link()
        if not menu[line.node] if inside[line.node] else beside:
            kept.append(line)
    return kept


def _ending(html: str) -> str:
    """``html`` without a tag that its end cuts off; a last < that begins no tag is text."""
    last = html.rfind("<")
    if last < 0 or ">" in html[last:]:
        return html
    rest = html[last:]
    if re.match(r"</[A-Za-z]|<!|<\?", rest):
        return html[:last]
    if not (named := _NAMED.match(rest)):
        return html
    known = named[1].lower() in BLOCK | INLINE | VOID | EXCLUDED
    cut = _ATTRIBUTE.search(rest) or named.end() == len(rest) and not html[:last].endswith((" ", "\n", "\t"))
    return html[:last] if known and cut else f"{html[:last]}&lt;{rest[1:]}"


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = PageLines()
    parser.feed(_ending(html))
    parser.close()
    return "\n".join(line.text for line in content_lines(parser))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, plus text and n_chars."""
    need(pages, html_col)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    columns = [f.name for f in kept]

    def run(frames):
        for pdf in frames:
            text = [main_text(h) for h in pdf[html_col]]
            yield pdf[columns].assign(text=pd.Series(text, dtype=object, index=pdf.index), n_chars=[len(t) for t in text])

    return pages.mapInPandas(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
