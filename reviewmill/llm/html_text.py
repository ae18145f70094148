"""Main text of web pages from streaming parser events.

The parser's events cut a page into lines, one per block element. Each line has a
text-to-tag ratio; ratios are smoothed with a Gaussian kernel, and lines above a
threshold form clusters. The clusters show which part of the page holds the article:
the article or main element with most of their text, or in a page without such
elements the lowest element with nearly all of it. Its lines are the text, and those
of other article and main elements that lie in clusters; without elements whose tag or
role says that they are something else. Classes and ids say so only of elements that
hold a small part of the clustered text: layouts use the same names for wrappers. So
does a form with paragraphs or headings in it: some servers wrap whole pages in one.

Open elements are counted by tag and ancestors are summed bottom-up, so deep nesting
costs no more than flat pages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm.common import table

SIGMA = 2.0  # of the smoothing, in lines
NEARLY_ALL, HALF = 0.9, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label wbr img".split()
)
#: Elements that never hold article text.
LEFT_OUT = frozenset(
    "head title script style noscript template nav header footer aside menu button select option textarea input dialog iframe object embed svg canvas audio video map".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: First or last part of a class or id that marks something beside the article, unless it holds most of the page.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr"
    " notice notices notification notifications alert disclaimer sidebar sidebars aside comment comments commentlist respond reply replies disqus discussion"
    " menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer social share sharing related recommended recommendations newsletter"
    " subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager skip search form".split()
)
#: Those of them that themes also give to wrappers of the article.
LAYOUT_NAMES = frozenset("promo promos promotion banner banners notice notices alert sidebar sidebars aside nav header masthead footer widget widgets modal overlay search form".split())
FORM_TEXT = frozenset("article main section p h1 h2 h3".split())  # what a form has that wraps a page
NOT_SAID = frozenset("has with no without is not".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open one of these, up to the given border.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def left_out(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.strip().lower() in LEFT_OUT_ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def named(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[frozenset[str], bool] | None:
    """The classes and ids that mark something beside the article, and whether all are layout names; None without any."""
    if tag == "form":
        return frozenset(["<form>"]), True
    found = {}
    if tag not in ("html", "body", "article", "main"):
        for word in " ".join(value or "" for name, value in attrs if name in ("class", "id")).split():
            parts = [p.lower() for p in _PARTS.findall(word)]
            if parts and parts[0] not in NOT_SAID and (said := {parts[0], parts[-1]} & LEFT_OUT_NAMES):
                found[word] = said <= LAYOUT_NAMES
    return (frozenset(found), all(found.values())) if found else None


#: Text, whether it is a link's, the innermost named element around it (-1: none).
Piece = tuple[str, bool, int]


class Lines(HTMLParser):
    """Collects (pieces of text, tags, innermost container) per line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, container number (-1: inline), left out, named
        self.outside = 0  # open elements that are left out
        self.links = 0
        self.parent: list[tuple[str, int]] = []  # of each container: its tag, the container around it
        self.lines: list[tuple[list[Piece], int, int]] = []
        self.text: list[Piece] = []
        self.tags = 0
        self.names: list[tuple[frozenset[str], bool]] = []  # of each named element
        self.around: list[int] = []  # of each named element: the named element around it
        self.alike: list[int] = []  # and the innermost around it with the same names
        self.within: list[int] = []  # open named elements
        self.open_names: dict[frozenset[str], list[int]] = defaultdict(list)
        self.forms: list[int] = []  # open forms
        self.wrappers: set[int] = set()  # forms with paragraphs or headings
        self.containers: list[int] = []  # open containers
        self.open_tags: Counter[str] = Counter()

    def container(self) -> int:
        return self.containers[-1] if self.containers else -1

    def end_line(self) -> None:
        if any(data.strip() for data, _, _ in self.text):
            self.lines.append((self.text, self.tags, self.container()))
            self.tags = 0
        self.text = []

    def pop(self) -> None:
        tag, number, out, has_name = self.stack[-1]
        if number >= 0 or tag not in INLINE:
            self.end_line()
        self.stack.pop()
        self.open_tags[tag] -= 1
        self.outside -= out
        if number >= 0:
            self.containers.pop()
        if has_name:
            self.open_names[self.names[self.within.pop()][0]].pop()
        if tag == "form":
            self.forms.pop()
        self.links -= tag == "a"

    def close_open(self, tags: set[str] | frozenset[str], border: set[str]) -> None:
        if not any(self.open_tags[tag] for tag in tags):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in tags:
                while len(self.stack) > depth:
                    self.pop()
                return
            if self.stack[depth][0] in border:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self.close_open({"p"}, {"table", "td", "th", "div", "article", "section", "main", "body", "button"})
        if tag == "body":
            self.close_open({"head"}, set())
        if tag in IMPLIED:
            self.close_open(*IMPLIED[tag])
        if tag == "br":
            self.text.append((" ", False, -1))
        if self.forms and tag in FORM_TEXT:
            self.wrappers.add(self.forms[-1])
        self.tags += 1
        if tag in VOID:
            if tag not in INLINE and tag != "br":
                self.end_line()
            return
        number = -1
        if tag not in INLINE:
            self.end_line()
            if tag != "p":
                number = len(self.parent)
                self.parent.append((tag, self.container()))
        out, names = left_out(tag, attrs), named(tag, attrs)
        self.stack.append((tag, number, out, names is not None))
        self.open_tags[tag] += 1
        if number >= 0:
            self.containers.append(number)
        if names:
            new, same = len(self.names), self.open_names[names[0]]
            self.around.append(self.within[-1] if self.within else -1)
            self.alike.append(same[-1] if same else -1)
            self.names.append(names)
            self.within.append(new)
            same.append(new)
            if tag == "form":
                self.forms.append(new)
        self.outside += out
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing but for void elements

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append((" ", False, -1))
        elif tag not in VOID:
            self.close_open({tag}, set() if tag not in INLINE else ENDS_PARAGRAPH - {"p"})

    def handle_data(self, data: str) -> None:
        if not self.outside:
            self.text.append((data, self.links > 0, self.within[-1] if self.within else -1))


def joined(page: Lines, vetoed: set[int]) -> list[tuple[str, int, int, int]]:
    """(text, tags, link characters, innermost container) of every line that has text outside the vetoed elements."""
    lines, tags = [], 0
    for pieces, n, at in page.lines:
        tags += n
        left = [(data, link) for data, link, name in pieces if name not in vetoed]
        text = " ".join("".join(data for data, _ in left).split())
        if text:
            lines.append((text, tags, sum(len(data.strip()) for data, link in left if link), at))
            tags = 0
    return lines


def vetoes(page: Lines) -> set[int]:
    """Named elements that are left out, with the named elements in them.

    First go forms that hold neither paragraph nor heading, then those with another name
    than of layout, unless one holds nearly all of the clustered text. Of the text that is
    left a layout element may hold half at most, and so may all elements with the same
    names together.
    """
    if not page.names:
        return set()
    inside = clusters(joined(page, set()))[0]
    own = [0] * (len(page.names) + 1)  # characters right in each named element; the last: in none
    for (pieces, _, _), near in zip((line for line in page.lines if any(data.strip() for data, _, _ in line[0])), inside, strict=True):
        for data, link, name in pieces if near else ():
            own[name] += 0 if link else len(data.strip())
    gone = [words == {"<form>"} and k not in page.wrappers for k, (words, _) in enumerate(page.names)]
    for layout, most in ((None, 0.0), (False, NEARLY_ALL), (True, HALF)):
        # An element comes after those around it.
        held = [0 if gone[k] else own[k] for k in range(len(gone))]
        most *= sum(held) + own[-1]
        for k in range(len(gone) - 1, -1, -1):
            if page.around[k] >= 0:
                held[page.around[k]] += held[k]
        some = [is_layout == layout and held[k] <= most for k, (_, is_layout) in enumerate(page.names)]
        together: dict[frozenset[str], int] = defaultdict(int)
        counted = [False] * len(gone)  # whether an element around it with the same names counts its text
        for k, (words, _) in enumerate(page.names):
            counted[k] = page.alike[k] >= 0 and (some[page.alike[k]] or counted[page.alike[k]])
            if some[k] and not counted[k]:
                together[words] += held[k]
        for k, (words, _) in enumerate(page.names):
            gone[k] |= (some[k] and together[words] <= most) or (page.around[k] >= 0 and gone[page.around[k]])
    return {k for k, out in enumerate(gone) if out}


def clusters(lines: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines lie in clusters; the sizes of all, and of their links."""
    size = np.array([len(text) for text, _, _, _ in lines], dtype=float)
    linked = np.array([min(n, len(text)) for text, _, n, _ in lines], dtype=float)
    ratio = (size - linked) / np.maximum([tags for _, tags, _, _ in lines], 1)
    reach = int(3 * SIGMA)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    smooth = np.convolve(ratio, kernel)[reach:-reach] / np.convolve(np.ones(len(lines)), kernel)[reach:-reach]
    return smooth >= min(smooth.std(), smooth.mean()), size, linked


def content_lines(lines: list[tuple[str, int, int, int]], parent: list[tuple[str, int]]) -> list[str]:
    if not lines:
        return []
    clustered, size, linked = clusters(lines)

    held = [0.0] * len(parent)
    weights = np.where(clustered, size - linked, 1e-3 * size)  # lines outside the clusters only decide between elements without any
    for (_, _, _, at), n in zip(lines, weights, strict=True):
        if at >= 0:
            held[at] += n
    # A container's number is larger than that of the one around it; only those with lines in them count.
    filled = [False] * len(parent)
    for _, _, _, at in lines:
        if at >= 0:
            filled[at] = True
    for n in range(len(parent) - 1, -1, -1):
        around = parent[n][1]
        if around >= 0:
            held[around] += held[n]
            filled[around] |= filled[n]
    # Numbers grow with depth along a path: of all that hold enough, the largest number lies lowest.
    marks = [n for n in range(len(parent)) if filled[n] and parent[n][0] in ("article", "main")]
    landmark = bool(marks)
    most = max((held[n] for n in marks), default=0) / 2 if landmark else NEARLY_ALL * weights.sum()
    root = max((n for n in marks or range(len(parent)) if filled[n] and held[n] >= most), default=-1)
    under, marked = [False] * len(parent), [False] * len(parent)
    for n, (tag, around) in enumerate(parent):
        under[n] = n == root or (around >= 0 and under[around])
        marked[n] = tag in ("article", "main") or (around >= 0 and marked[around])
    kept = []
    for (text, _, _, at), inside, n, links in zip(lines, clustered, size, linked, strict=True):
        if root < 0 or (at >= 0 and under[at]):
            take = landmark or inside or links < n / 2
        else:  # the other landmarks give their clustered lines
            take = landmark and at >= 0 and marked[at] and inside and links < n / 2
        if take:
            kept.append(text)
    return kept


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty for a null or empty page."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    while page.stack:
        page.pop()
    page.end_line()
    if not page.lines:
        return ""
    return " ".join(content_lines(joined(page, vetoes(page)), page.parent))


def text_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return extract(html)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null ids and urls and repeated rows stay as they are; a null, empty or textless
    page has the empty text. Very long pages are read whole, in time that grows with
    their length; other columns, whatever their names, are dropped. An empty table gives
    an empty table.
    """
    made = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), text_column(F.col(f"`{html_col}`")).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
