"""Main text of web pages from parser events.

The standard library's parser streams events; no tree is built. Block tags cut the page into lines. A line's ratio is its
text per tag; ratios are smoothed with a Gaussian over neighbouring lines, and lines above the threshold (the standard
deviation of the smoothed ratios) are content. The content lines choose the region: the `article` or `main` element
that holds most of them, else the smallest element that holds all of them (or a part of it that has the title and most of
them). A region's lines all stay, short ones too, but for what is no text of the article:

- elements that are never content: nav, aside, footer, dialog, scripts, styles, buttons and the like, hidden ones, and those with
  a role that says so;
- page headers, forms, and elements whose class or id names a menu, a sidebar, a notice, an advert or reader comments,
  unless they hold the page's title or an article, or (comments apart, on pages without an article) most of the text;
- outside of articles, lists of links.

A line is one block of the result: character references are decoded, white space is one space, ends are trimmed.
`br` is white space. Comments, declarations and a tag or comment that the end of the page cuts off are markup.

Defined results: null or empty pages, and pages without text, give an empty text; text without tags is one block; repeated
pages are rows like others; extra columns aren't read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never read.
SILENT = frozenset("script style noscript template title iframe object svg math canvas audio video select option textarea button datalist".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form ul ol dl table tbody thead tfoot figure blockquote details dialog fieldset center menu search".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre hr address figcaption summary legend caption option noscript".split())
#: A start of these ends an open one of the same kind.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = frozenset("nav aside footer dialog menu search".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer copyright colophon masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification notifications alert announcement newsletter subscribe subscription signup login signin "
    "search share sharing social related recommended recommendations trending popular teaser teasers pagination pager paging popup modal overlay widget widgets skip".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
CUT_TAG = re.compile(r"<[A-Za-z/][^<>]*\Z")

#: Lines on either side that smooth a ratio, and the width of the Gaussian.
RADIUS, SIGMA = 3, 1.0
NONE, ALWAYS, HINT, COMMENT, HEADER, FORM = range(6)


def _kind(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool]:
    """How an element may be excluded, and whether it is a main element."""
    main = tag in ("article", "main")
    kind = ALWAYS if tag in NEVER else HEADER if tag == "header" else FORM if tag == "form" else NONE
    for name, value in attrs:
        if name == "hidden":
            kind = ALWAYS
        if not value:
            continue
        if name == "style" and HIDDEN_STYLE.search(value) or name == "aria-hidden" and value.lower() == "true":
            kind = ALWAYS
        elif name == "role":
            role = value.strip().lower()
            main |= role in ("main", "article")
            kind = ALWAYS if role in NEVER_ROLES else kind
        elif name == "itemprop" and value.strip().lower() == "articlebody":
            main = True
        elif name in ("class", "id") and kind in (NONE, HEADER, FORM) and tag not in ("html", "body", "main"):
            words = set(re.split(r"[^a-z0-9]+", CAMEL.sub(r"\1 \2", value).lower()))
            if words & COMMENTS:
                kind = COMMENT
            elif words & BOILERPLATE:
                kind = HINT
            elif "header" in words and kind == NONE:
                kind = HINT
    return kind, main and kind in (NONE, HEADER, FORM)


class Page(HTMLParser):
    """Lines of a page: (container, parts, tags, is_heading, linked characters); a part is (element, characters)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.up, self.kinds, self.mains, self.titles = ["#page"], [-1], [NONE], [False], [False]
        self.open = [("#page", 0)]
        self.silent = self.links = 0
        self.lines: list[tuple[int, list[tuple[int, str]], int, bool, int]] = []
        self.parts: list[tuple[int, str]] = []
        self.n_tags, self.linked, self.heading = 0, 0, False

    def end_line(self) -> None:
        if any(p and not p.isspace() for _, p in self.parts):
            home = next(i for t, i in reversed(self.open) if t in CONTAINERS or t == "#page")
            self.lines.append((home, self.parts, self.n_tags, self.heading, self.linked))
            self.n_tags = 0
        self.parts, self.linked, self.heading = [], 0, False

    def pushed(self, tag: str, kind: int, main: bool) -> None:
        self.tags.append(tag)
        self.up.append(self.open[-1][1])
        self.kinds.append(kind)
        self.mains.append(main)
        self.titles.append(False)
        self.open.append((tag, len(self.tags) - 1))
        self.silent += tag in SILENT

    def popped(self) -> None:
        tag, _ = self.open.pop()
        self.silent -= tag in SILENT

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag in BLOCKS:
            self.end_line()
            while len(self.open) > 1 and (self.open[-1][0] == "p" or self.open[-1][0] in ENDED_BY.get(tag, ())):
                self.popped()
        if tag == "br":
            self.parts.append((self.open[-1][1], " "))
        if tag in VOID:
            return
        if tag == "a":
            self.links = 1
        if tag == "h1" and not self.silent:
            self.titles[self.open[-1][1]] = True
        self.heading |= tag in ("h1", "h2", "h3")
        kind, main = _kind(tag, attrs)
        if tag in CONTAINERS or tag in SILENT or kind != NONE or main:
            self.pushed(tag, kind, main)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "object", "canvas") and self.open[-1][0] == tag:
            self.popped()

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self.end_line()
        wide = tag in CONTAINERS or tag in SILENT
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.popped()
                break
            if not wide and self.open[i][0] in CONTAINERS or wide and tag not in ("html", "body") and self.open[i][0] in ("body", "html"):
                break  # what is not open here ends nothing

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((self.open[-1][1], data))
            if self.links:
                self.linked += len(data.strip())

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of the source aren't asked for."""
        return j

    def parse_html_declaration(self, i: int) -> int:
        """Comments and declarations are skipped; one that isn't closed goes to the end."""
        raw = self.rawdata
        close = "-->" if raw.startswith("<!--", i) else ">"
        j = raw.find(close, i + 2)
        return len(raw) if j < 0 else j + len(close)

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self.parse_html_declaration(i)

    def parse_pi(self, i: int) -> int:
        j = self.rawdata.find(">", i + 2)
        return len(self.rawdata) if j < 0 else j + 1


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    over = np.convolve(np.ones(len(ratios)), kernel, "full")[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel, "full")[RADIUS : RADIUS + len(ratios)] / over


def _masses(page: Page, lines: list[int], sizes: list[int]) -> list[int]:
    """Characters of lines below each element."""
    mass = [0] * len(page.tags)
    for home, n in zip(lines, sizes, strict=True):
        mass[home] += n
    for i in range(len(mass) - 1, 0, -1):
        mass[page.up[i]] += mass[i]
    return mass


def _excluded(page: Page) -> list[bool]:
    """Elements that are no part of an article, and what is below them."""
    n = len(page.tags)
    mass = [0] * n
    for _, parts, *_ in page.lines:
        for i, s in parts:
            mass[i] += len(s.strip())
    has_main, has_title = list(page.mains), list(page.titles)
    gone, in_main = [False] * n, list(page.mains)
    for i in range(1, n):
        gone[i] = gone[page.up[i]] or page.kinds[i] == ALWAYS
        in_main[i] |= in_main[page.up[i]]
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            mass[page.up[i]] += mass[i]
            has_main[page.up[i]] |= has_main[i]
            has_title[page.up[i]] |= has_title[i]
    any_main = has_main[0]
    for i in range(1, n):
        kind, parent = page.kinds[i], page.up[i]
        holds = has_main[i] or has_title[i]
        most = 2 * mass[i] > mass[0] and not any_main
        gone[i] |= gone[parent] or kind == COMMENT and not holds or kind in (HINT, FORM) and not (holds or most) or kind == HEADER and not (in_main[parent] or has_main[i])
    return gone


def _is_link_list(page: Page, lines: list[tuple]) -> set[int]:
    """Lists outside of main elements that are links for the most part."""
    count: dict[int, list[int]] = {}
    for home, _, _, _, linked, s in lines:
        if page.tags[home] in ("ul", "ol", "dl", "table", "tbody"):
            c = count.setdefault(home, [0, 0, 0])
            c[0] += 1
            c[1] += linked
            c[2] += len(s)
    return {i for i, (n, linked, size) in count.items() if n >= 3 and linked > 0.8 * size}


def _ancestors(page: Page, i: int) -> list[int]:
    out = []
    while i >= 0:
        out.append(i)
        i = page.up[i]
    return out[::-1]


def _common(page: Page, homes: set[int]) -> int:
    """The smallest element that holds all of homes."""
    chain: list[int] | None = None
    for h in homes:
        own = _ancestors(page, h)
        chain = own if chain is None else [a for a, b in zip(chain, own) if a == b]  # noqa: B905
    return chain[-1] if chain else 0


def main_text(html: str) -> str:
    page = Page()
    page.feed(CUT_TAG.sub("", html))
    page.close()
    page.end_line()
    gone = _excluded(page)
    lines = []
    for home, parts, tags, heading, linked in page.lines:
        s = " ".join("".join(p for i, p in parts if not gone[i]).split())
        if s:
            lines.append((home, parts[0][0], tags, heading, linked, s))
    if not lines:
        return ""
    n = len(page.tags)
    in_main = list(page.mains)
    for i in range(1, n):
        in_main[i] |= in_main[page.up[i]]
    menus = _is_link_list(page, lines)
    lines = [x for x in lines if x[0] not in menus or in_main[x[0]]] or lines
    ratios = np.array([len(s) / max(1, tags) for _, _, tags, _, _, s in lines])
    even = smoothed(ratios)
    limit = float(even.std())
    content = even > limit
    core = content & (ratios > limit)
    if not core.any():
        content = core = np.ones(len(lines), dtype=bool)
    homes = [x[0] for x in lines]
    mass = _masses(page, [h for h, c in zip(homes, core, strict=True) if c], [len(x[5]) for x, c in zip(lines, core, strict=True) if c])
    title = _masses(page, [x[0] for x in lines if x[3]], [1 for x in lines if x[3]])

    inside = [False] * n
    outer = [i for i in range(n) if page.mains[i] and not gone[i] and mass[i] and not (page.up[i] >= 0 and in_main[page.up[i]])]
    most = max((mass[i] for i in outer), default=0)
    if 2 * sum(mass[i] for i in outer) >= mass[0]:
        for i in outer:
            if 5 * mass[i] < most:
                continue
            # an article within it that has the titles and nearly all the content is the region
            inner = [j for j in range(i + 1, n) if page.mains[j] and not gone[j] and mass[j] * 10 >= mass[i] * 9 and title[j] == title[i] and i in _ancestors(page, j)]
            inside[inner[-1] if inner else i] = True
        first, last = 0, len(lines)
    else:
        chosen = {h for h, c in zip(homes, core, strict=True) if c}
        heads = [k for k, x in enumerate(lines) if x[3]]
        at = _common(page, chosen | ({homes[heads[0]]} if heads else set()))
        part = [j for j in range(at + 1, n) if page.up[j] == at and 2 * mass[j] > mass[at] and title[j] and title[j] == title[at]]
        inside[part[0] if part else at] = True
        first, last = 0, len(lines)
        if page.tags[at] in ("#page", "html", "body") and not part:  # the page itself: from its first content to its last, and titles before
            found = np.flatnonzero(content)
            first, last = int(found[0]), int(found[-1]) + 1
            first = min([first, *heads[:1]])
    for i in range(1, n):
        inside[i] |= inside[page.up[i]]
    return "\n".join(x[5] for k, x in enumerate(lines) if first <= k < last and inside[x[0]])


@F.arrow_udf(T.StringType())
def extracted(pages: pa.Array) -> pa.Array:
    """The main text of each page."""
    text.lean()
    return pa.array([main_text(x) if x else "" for x in (v.as_py() for v in pages)], pa.string())


extracted = extracted.asNondeterministic()  # once a row
