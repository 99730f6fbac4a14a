"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser gives events; each block of a page is a line with its text, the tags in it and the
element it stands in. The lines' ratios of text (in code points, links left out) to tags are smoothed by a Gaussian and split
in two clusters; the lines of the upper one, but for those that are mostly links, are content. The content region is the smallest section of the page that holds
nearly all the content's text, or the article or main element around it; its lines are the text, whatever their own ratio,
with those of sections beside it that hold content, but for lines that are mostly links, and without those of menus, notices, adverts, forms, comments and the like, which elements' names, roles and classes tell. Classes
do not tell of articles, nor of an element around most of the page's text with its title or main part.

Defined cases: a null or empty page has an empty text, as has one without a line; a broken or unclosed page is read as far as
it goes; repeated rows and null ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import column, map_batches

#: Width of the smoothing, in lines, and the share of the content's text that the region must hold.
SIGMA, COVER = 1.0, 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
SECTIONS = frozenset("article main section div body td html".split())
#: Elements that never hold main text.
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea iframe svg canvas object audio video menu dialog "
                    "title fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert|newsletter|subscri\w+|"
    r"side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer|header|masthead|comment\w*|disqus|respond|replies|related|recommend\w*|share|sharing|"
    r"logo|social|popup|modal|overlay|widget\w*|login|signup|search|pagination|pager|toolbar|copyright|disclaimer|skip)(?=$|[\s_-])", re.I)
#: Headers of an article, not of the site.
OWN_HEADER = re.compile(r"(?:entry|post|article|content|story|title)[-_]*header|header[-_]*(?:title|text)", re.I)
#: Classes that say what a page or post is like, not what an element is.
ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without|tag|category|cat|hide|show)[-_]+\S*", re.I)
#: A marked element that holds more than this share of the page's text, and its title or main part or nearly all text, is no boilerplate.
MOST, NEARLY_ALL = 0.5, 0.9
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Lines(HTMLParser):
    """Collects lines: text, link characters, tags, section, whether it is dropped, whether it is a title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Of each open element: name, the section it stands in or is, dropped (0 no, -1 yes, else the number of the marked element),
        # and the place of the last block up to it. `at`: the places of each name. So no event has to look through all that is open.
        self.open: list[tuple[str, int, int, int]] = []
        self.at: dict[str, list[int]] = {}
        self.marked: list[tuple[int, list[bool]]] = [(0, [False])]  # the marked element around it, and whether it has a title or main part
        self.sections: list[tuple[str, int]] = []  # name and parent of each section
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags, self.link, self.links = 0, 0, 0

    def section(self) -> int:
        return self.open[-1][1] if self.open else -1

    def push(self, tag: str, section: int, dropped: int) -> None:
        here = len(self.open)
        block = (self.open[-1][3] if self.open else -1) if tag in INLINE else here
        self.open.append((tag, section, dropped, block))
        self.at.setdefault(tag, []).append(here)

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.at[tag].pop()
        if tag == "a":
            self.links -= 1
        return tag

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.link, self.tags, self.section(), self.open[-1][2] if self.open else 0, bool(self.at.get("h1"))))
        self.text, self.tags, self.link = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in ENDS_P and self.at.get("p"):
            self.close_to("p")
        elif tag == "li" and any(x[0] == "li" for x in self.open[-4:]):
            self.close_to("li")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        dropped = self.open[-1][2] if self.open else 0
        if dropped >= 0 and self.drops(tag, attrs):
            dropped = -1
        elif dropped >= 0:
            is_marked = self.marks(tag, attrs)
            if tag in ("main", "h1") or tag == "article" and not is_marked:
                self.has_main(dropped)
            if is_marked and tag != "article":
                self.marked.append((dropped, [False]))
                dropped = len(self.marked) - 1
        section = self.section()
        if tag in SECTIONS:
            self.sections.append((tag, section))
            section = len(self.sections) - 1
        self.push(tag, section, dropped)

    def drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":  # an article's own header holds its title
            return not (self.at.get("article") or self.at.get("main"))
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag not in ("html", "body", "main", "header") and any(
            name in ("class", "id") and MARKS.search(OWN_HEADER.sub("", ABOUT.sub("", value or ""))) for name, value in attrs)

    def has_main(self, number: int) -> None:
        while number > 0 and not self.marked[number][1][0]:  # those around a marked one that has it have it too
            self.marked[number][1][0] = True
            number = self.marked[number][0]

    def unmarked(self) -> set[int]:
        """Marked elements that are no boilerplate."""
        held, total = [0] * len(self.marked), 0
        for text, link, _, _, number, _ in self.lines:
            if number >= 0:
                size = max(len(text) - link, 0)
                total += size
                held[number] += size
        for k in range(len(held) - 1, 0, -1):  # from the inside out
            held[self.marked[k][0]] += held[k]
        found = {0}
        for k in range(1, len(held)):
            around, has = self.marked[k]
            if around in found and held[k] > (MOST if has[0] else NEARLY_ALL) * total:
                found.add(k)
        return found

    def close_to(self, tag: str) -> None:
        self.flush()
        while self.open and self.pop() != tag:
            pass

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.at.get(tag)
        if not places:
            return
        if tag not in INLINE:
            self.close_to(tag)
        elif self.open[-1][3] < places[-1]:
            # Only this element ends; a block that begins inside it stays.
            for _ in range(len(self.open) - places[-1]):
                self.pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links > 0:
            self.link += len(data)


def clusters(values: np.ndarray) -> np.ndarray:
    """Which values belong to the upper of two clusters in one dimension (least squares, by trying each border of the order)."""
    if len(values) < 2 or values.min() == values.max():
        return np.ones(len(values), bool)
    x = np.sort(values)
    n, sums, squares = len(x), np.cumsum(x), np.cumsum(x * x)
    k = np.arange(1, n)
    low = squares[:-1] - sums[:-1] ** 2 / k
    high = squares[-1] - squares[:-1] - (sums[-1] - sums[:-1]) ** 2 / (n - k)
    cut = int(np.argmin(np.where(x[1:] > x[:-1], low + high, np.inf)))
    return values > x[cut]


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach:reach + len(values)]
    return np.convolve(values, kernel, "full")[reach:reach + len(values)] / weight


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    unmarked = page.unmarked()
    lines = [x for x in page.lines if x[4] in unmarked]
    if not lines:
        return ""
    ratio = np.array([max(len(text) - link, 0) / max(tags, 1) for text, link, tags, *_ in lines])
    # A line that is mostly links is none, however long its neighbours.
    content = clusters(np.log1p(smoothed(ratio))) & np.array([2 * link < len(text) for text, link, *_ in lines])
    # Text of the content in each section and all those around it, added up from the inside out; the last stands for the page.
    held = [0] * (len(page.sections) + 1)
    for (text, _, _, section, *_), is_content in zip(lines, content):
        if is_content:
            held[section] += len(text)
    for section in range(len(page.sections) - 1, -1, -1):
        held[page.sections[section][1]] += held[section]
    region = max((s for s, n in enumerate(held[:-1]) if n and n >= COVER * held[-1]), default=-1)  # sections are numbered from outside in
    around, up = region, region
    while up >= 0:
        if page.sections[up][0] in ("article", "main"):
            around = up
            break
        up = page.sections[up][1]
    above = {-1}  # the region and all sections around it
    up = around
    while up >= 0:
        above.add(up)
        up = page.sections[up][1]

    # Of each section the outermost around it that does not hold the region, or else the region or what holds it.
    branch: list[int] = []
    for s, (_, up) in enumerate(page.sections):
        branch.append(s if s in above else branch[up] if up not in above else around if up == around else s)
    branches = [branch[section] if section >= 0 else section for _, _, _, section, *_ in lines]
    beside = {b for b, is_content in zip(branches, content) if is_content and b not in above}
    kept, inside = [], False
    for (text, link, _, _, _, title), b, is_content in zip(lines, branches, content):
        inside |= b == around
        # The page's title may stand before the region.
        if b == around or around < 0 or is_content or b in beside and 2 * link < len(text) or title and not inside:
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each page url, text and n_chars of its main text."""
    rows = pages.select(column(id_col).alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).alias("html"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in cols.pop("html")]
        return cols | {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(rows, run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint", heavy="html")
