"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters (operator 5).

The standard library's streaming parser splits a page into lines of text (one for each block
element). Each line has a ratio of its characters to its tags, nothing for lines that are mostly links;
the smoothed ratios that reach a threshold form clusters. The clusters select the content regions: the
articles most of whose text is in them, or else the innermost element that holds nearly all they have.
A region's lines are the text, without linked runs and marked elements that no cluster reaches; what
stands around it isn't, but for the heading of a region that has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content, but for the header of an article.
DROPPED = frozenset("nav header footer aside form script style noscript template head title menu button select option textarea iframe object svg canvas dialog math audio video".split())
#: Whole classes, ids and roles (- and _ alike, numbers at the end aside) that mark an element as something else than the article.
MARKS = frozenset(
    "ad ads adbox ad-box ad-slot ad-unit ad-banner ad-container ad-wrapper advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored sponsored-content promo promos promotion promotions promoted"
    " cookie cookies cookie-bar cookie-banner cookie-consent cookie-notice consent consent-banner notice notices newsletter newsletter-signup newsletter-form subscribe popup modal overlay alert"
    " nav navbar nav-bar nav-menu main-nav main-navigation site-nav site-navigation top-nav navigation menu main-menu nav-links breadcrumb breadcrumbs toolbar login signup search search-form search-box"
    " sidebar side-bar sidebar-left sidebar-right left-sidebar right-sidebar side widget widgets related related-posts related-articles related-stories related-links recommended recommended-posts"
    " share sharing share-buttons share-bar social social-share social-links social-media social-icons comment comments comment-list commentlist comments-area comments-section comment-section comment-form replies reply disqus disqus-thread"
    " user-comments reader-comments post-comments article-comments comments-wrapper comments-container comment-thread comment-body ad-inline inline-ad ad-block adsbygoogle native-ad"
    " footer foot site-footer page-footer masthead siteheader site-header pageheader page-header complementary contentinfo".split()
)
#: Of these, the words that an article may use for parts of its own text: such a part stays where a cluster reaches it.
WORDS = frozenset("menu side promo promos promotion promotions promoted banner banners notice notices alert modal overlay popup search login signup widget widgets foot toolbar share sharing social reply replies related recommended subscribe sponsor sponsors".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Dropped elements around which a text goes on.
PASSED = frozenset("script style noscript template title button select option textarea iframe object svg canvas math audio video".split())
CONTAINERS = frozenset("article main section div body td center details".split())
NAMED = frozenset(("article", "main"))
#: What an end tag that isn't of a block doesn't reach across, and what ends a search for an open item of a list or table.
BOUNDS = frozenset("body article main table".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "td": ("table",), "th": ("table",), "tr": ("table",)}
#: Width of the smoothing window to each side, and its standard deviation, in lines.
RADIUS, SIGMA = 2, 1.0
APART = 4.0
#: Share of the clusters' text that the content region must hold, and share of its own text that an article, or an element beside others, must have in them.
HELD, OWN = 0.9, 0.5

_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"-?[0-9]+$")
_COMMENT_END = re.compile(r"-->|(?<!<!)--!>")
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")


@dataclass
class Page:
    """Elements by number (0: the page): parent, tag, whether dropped, nearest marked one at or above it, whether that has no marks but WORDS, whether in an article or main, whether in a heading; and lines."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    dropped: list[bool] = field(default_factory=lambda: [False])
    mark: list[int] = field(default_factory=lambda: [0])
    word: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    heading: list[bool] = field(default_factory=lambda: [False])
    text: list[str] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)


class _Reader(HTMLParser):
    """Fills a Page. Open elements stand on a stack, with their places by tag, so that no event walks down it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bounds: list[int] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.unclosed = False

    def read(self, html: str) -> None:
        """The whole page. A tag, comment or declaration that never ends is dropped with what follows, as in browsers; a search for its end isn't made twice."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        if not self.unclosed:
            self.handle_data(unescape(_UNFINISHED.split(html[end:], maxsplit=1)[0]))
        self.end_line()

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = _COMMENT_END.search(self.rawdata, i + 2)
        self.unclosed = not found
        return found.end() if found else len(self.rawdata)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        """Where <![ ... ends: at the next >, which is there, as the parser is fed up to the last one."""
        return self.rawdata.index(">", i) + 1

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            p = self.page
            p.text.append(text)
            p.tags.append(self.tags)
            p.linked.append(self.linked)
            p.at.append(self.stack[-1] if self.stack else 0)
            self.tags = 0
        self.parts, self.linked = [], 0

    def _open(self, tag: str, attrs: list) -> None:
        p, above = self.page, self.stack[-1] if self.stack else 0
        inside = p.named[above]
        dropped = p.dropped[above] or tag in DROPPED and not (tag == "header" and inside)
        mark, word = p.mark[above], p.word[above]
        if not dropped and tag not in ("html", "body", *NAMED):
            dropped = any(a == "hidden" or (a == "aria-hidden" and v == "true") for a, v in attrs)
            # the id of a heading, or of a section inside an article, names its text
            own = tag in HEADINGS or inside and tag == "section"
            names = {_NUMBER.sub("", t.replace("_", "-")) for a, v in attrs if v and (a in ("class", "role", "itemprop") or a == "id" and not own) for t in v.lower().split()} & MARKS
            if names and not (mark and names <= WORDS):
                mark, word = len(p.tag), inside and names <= WORDS
        self.stack.append(len(p.tag))
        for values, value in ((p.parent, above), (p.tag, tag), (p.dropped, dropped), (p.mark, mark), (p.word, word), (p.named, inside or tag in NAMED), (p.heading, p.heading[above] or tag in HEADINGS)):
            values.append(value)
        place = len(self.stack) - 1
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in BOUNDS:
            self.bounds.append(place)

    def _place(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def _close_from(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.page.tag[self.stack.pop()]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in BOUNDS:
                self.bounds.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS or tag in DROPPED:
            self.end_line()
        if tag in BLOCKS and tag not in ("html", "body") and self.blocks and self.blocks[-1] == self._place("p"):
            self._close_from(self.blocks[-1])
        if tag in ITEMS and self._place(tag) > max(map(self._place, ITEMS[tag])):
            self._close_from(self._place(tag))
        if tag not in VOID:
            self._open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in DROPPED:
            self.end_line()
        place = self._place(tag)
        if place >= 0 and (tag in BLOCKS or not self.bounds or self.bounds[-1] <= place):
            self._close_from(place)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data.strip())


def read_page(html: str) -> Page:
    reader = _Reader()
    reader.read(html)
    return reader.page


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends over those there are."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    pad = lambda x: np.convolve(x, kernel)[RADIUS : RADIUS + len(ratios)]
    return pad(ratios) / pad(np.ones(len(ratios)))


def clusters(ratios: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio reaches a threshold: the one that best parts the logarithms in two groups.

    There is none where these groups are less than a factor of APART from each other, and it is no higher
    than an APARTth of the ratio at and above which half of the sum of all ratios lies, so that a few very
    long lines don't set all others aside.
    """
    smooth = smoothed(ratios)
    s, ranked = np.log1p(smooth), np.sort(np.log1p(smooth))
    n, left = np.arange(1, len(s)), np.cumsum(ranked)[:-1]
    if not len(n):
        return np.ones(len(s), bool)
    low, high = left / n, (ranked.sum() - left) / (len(s) - n)
    best = int(np.argmax(n * (len(s) - n) * (high - low) ** 2))
    if high[best] - low[best] < np.log(APART):
        return np.ones(len(s), bool)
    falling = np.sort(smooth)[::-1]
    half = falling[int(np.argmax(2 * np.cumsum(falling) >= falling.sum()))]
    return s >= min(ranked[best + 1], np.log1p(half / APART))


def _picked(page: Page, lines: np.ndarray, links: np.ndarray) -> np.ndarray:
    """For these lines, whether they are in a cluster. Links count for nothing in a ratio."""
    ratios = np.array([0.0 if links[k] else len(page.text[k]) / max(1, page.tags[k]) for k in lines.tolist()])
    return clusters(ratios) if len(lines) else np.zeros(0, bool)


def _below(page: Page, amounts: np.ndarray) -> np.ndarray:
    """The sum of the lines' amounts for each element, those below it included (a child has a greater number)."""
    total = np.bincount(np.array(page.at, np.int64), weights=amounts, minlength=len(page.tag)).tolist()
    for e in range(len(total) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    return np.array(total)


def _region_of(page: Page, regions: list[int]) -> np.ndarray:
    """For each line, the outermost of these elements that holds it; -1: none."""
    own, of = set(regions), [0 if 0 in regions else -1]
    for e in range(1, len(page.tag)):
        above = of[page.parent[e]]
        of.append(e if above < 0 and e in own else above)
    return np.array(of)[np.array(page.at, np.int64)]


def _units(page: Page, tags: frozenset) -> list[int]:
    """For each element, the outermost one with these tags at or above it; 0: none."""
    of = [0]
    for e in range(1, len(page.tag)):
        of.append(of[page.parent[e]] or (e if page.tag[e] in tags else 0))
    return of


def content_regions(page: Page, open_: np.ndarray, picked: np.ndarray) -> list[int]:
    """Numbers of the content elements, for the lines that aren't dropped and those in clusters; 0 is the page.

    Articles, or a main with text of its own, if they have OWN of their text in clusters, and half of
    all clusters' text together; else the innermost container that holds HELD of the clusters' text in two
    lines or more, and those around it as long as all they add are lines of their own in clusters. If that
    is the body, those of its parts that have OWN of their text in clusters, unless most of the clusters'
    text stands in none.
    """
    sizes = np.array([len(t) for t in page.text], float)
    held, whole, count = _below(page, sizes * picked), _below(page, sizes * open_), _below(page, open_.astype(float))
    mine = lambda e: whole[e] > 0 and held[e] >= OWN * whole[e]
    unit, article = _units(page, NAMED), _units(page, frozenset(("article",)))
    inner: dict[int, list[int]] = {}
    for e in sorted(set(article) - {0}):
        if mine(e):
            inner.setdefault(unit[e], []).append(e)
    named = []
    for e in sorted(set(unit) - {0}):
        within = inner.get(e, [])
        if page.tag[e] == "main" and sum(held[x] for x in within) >= HELD * held[e] > 0:
            named += within
        elif mine(e):
            named.append(e)
    if named and 2 * sum(held[e] for e in named) >= held[0]:
        return named
    full = [e for e in np.flatnonzero(held >= HELD * held[0]).tolist() if e and page.tag[e] in CONTAINERS]
    region = max((e for e in full if count[e] > 1), default=0)  # an inner element opens later
    if not region or page.tag[region] == "body":
        part = set(_units(page, CONTAINERS - {"body"})) - {0}
        parts = sorted(e for e in part if mine(e))
        return parts if parts and 2 * sum(held[e] for e in parts) > held[0] else [region]
    around = [0]
    for e in range(1, len(page.tag)):
        around.append(e if page.tag[e] in CONTAINERS else around[page.parent[e]])
    loose = np.bincount(np.array(around)[np.array(page.at, np.int64)], weights=(open_ & picked).astype(float), minlength=len(page.tag))
    while (above := around[page.parent[region]]) and page.tag[above] != "body" and loose[above] == count[above] - count[region]:
        region = above
    return [region]


def _container(page: Page, e: int) -> int:
    """The nearest container at or above an element."""
    while e and page.tag[e] not in CONTAINERS:
        e = page.parent[e]
    return e


def _with_heading(page: Page, region: int, inside: np.ndarray, fence: np.ndarray, open_: np.ndarray) -> list[int]:
    """Lines from a heading before a region to its first line, if both stand in one element and the region has no such heading itself."""
    around = _container(page, page.parent[region]) if region else 0
    if not around or page.tag[around] == "body" or not len(inside):
        return []
    level = lambda k: next((int(page.tag[e][1]) for e in _upward(page, page.at[k]) if page.tag[e] in HEADINGS), 7) if page.heading[page.at[k]] else 7
    least = min(map(level, inside.tolist()))
    limit = least if page.tag[region] not in NAMED else 7 if least == 7 else 0
    found, k = [], int(inside[0]) - 1
    while k >= 0 and not fence[k] and (not open_[k] or _container(page, page.at[k]) == around):
        found.append(k)
        if open_[k] and level(k) < limit:
            return found[::-1]
        k -= 1
    return []


def _upward(page: Page, e: int) -> Iterator[int]:
    while e:
        yield e
        e = page.parent[e]


def _kept_marks(page: Page, open_: np.ndarray, links: np.ndarray) -> set[int]:
    """Marked elements that stay: those with nearly all of the clusters' text, if no article or main has text outside marked ones."""
    marks, at = np.array(page.mark, np.int64), np.array(page.at, np.int64)
    lines = np.flatnonzero(open_)
    if not marks[at[lines]].any():
        return set()
    picked = np.zeros(len(open_), bool)
    picked[lines] = _picked(page, lines, links)
    sizes = np.array([len(t) for t in page.text], float) * picked
    if any(page.named[e] and not marks[e] for e in at[lines].tolist()):
        return set()
    held = _below(page, sizes)
    return {e for e in set(marks.tolist()) - {0} if held[e] > HELD * sizes.sum()}


def extract(html: str | None) -> str:
    """Content lines of a page, joined by line feeds."""
    page = read_page(html or "")
    at = np.array(page.at, np.int64)
    if not len(at):
        return ""
    dropped, named, heading, mark = (np.array(x)[at] for x in (page.dropped, page.named, page.heading, page.mark))
    links = np.array([2 * n > len(t) for n, t in zip(page.linked, page.text, strict=True)]) & ~named & ~heading
    stay = _kept_marks(page, ~dropped, links)
    words = {e for e, w in zip(page.mark, page.word, strict=True) if w}
    open_ = ~dropped & ~_gone(page, stay | words)[at]
    if words and open_.any():  # a part of an article that is called like boilerplate stays where a cluster reaches it
        lines = np.flatnonzero(open_)
        reached = lines[_picked(page, lines, links)]
        open_ = ~dropped & ~_gone(page, stay | (words & set(mark[reached].tolist())))[at]
    if not open_.any():
        return ""
    lines = np.flatnonzero(open_)
    picked = np.zeros(len(at), bool)
    picked[lines] = _picked(page, lines, links)
    text = picked & ~links
    regions = content_regions(page, open_, text if text.any() else open_)
    fence = ~open_ & ~np.array([t in PASSED for t in page.tag])[at]
    of = _region_of(page, regions)
    chosen = (of >= 0) & open_
    sizes, ranked = np.array([len(t) for t in page.text]), np.argsort(of, kind="stable")
    for region, start, end in zip(regions, *np.searchsorted(of[ranked], [regions, np.array(regions) + 1]).tolist(), strict=True):
        own = ranked[start:end][open_[ranked[start:end]]]
        if text.any() and sizes[own[text[own]]].sum() < OWN * sizes[own].sum():  # the clusters take parts of it
            chosen[own] = text[own]
        chosen[_with_heading(page, region, own, fence, open_)] = True
    inside = np.flatnonzero(chosen & open_)
    if not len(inside):
        return ""
    # a run of linked lines is the text's own where smoothing from both sides carries its cluster over it
    menu, k = np.zeros(len(at), bool), 0
    while k < len(lines):
        end = k
        while end < len(lines) and links[lines[end]]:
            end += 1
        run = lines[k:end]
        menu[run] = not (k > 0 and end < len(lines) and picked[run].all() and inside[0] < lines[k] and lines[end - 1] < inside[-1]) if len(run) else False
        k = max(end, k + 1)
    return "\n".join(page.text[k] for k in inside.tolist() if not menu[k])


def _gone(page: Page, stay: set[int]) -> np.ndarray:
    """For each element, whether it is in a marked one that doesn't stay."""
    gone = [False]
    for e in range(1, len(page.tag)):
        gone.append(gone[page.parent[e]] or page.mark[e] == e and e not in stay)
    return np.array(gone)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html.

    A null or empty page, and one without content, has empty text. A page of plain text is one
    line. Text beside an article, or beside the element that holds the clusters, isn't content. A comment, tag or declaration that never ends goes with what follows it. Repeated rows and equal or null keys give a row each. Other columns are left out. No rows
    in, none out. Outside an article or main, runs of lines with over half their characters in links
    count as a menu's, unless they are headings or in the midst of a cluster.
    """

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([extract(v.as_py()) for v in values], pa.string())

    found = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), main_text(F.col(html)).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
