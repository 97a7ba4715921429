"""Main text of HTML pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters, regions."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioflux.llm.arrowmap import map_texts
from folioflux.sources.tables import load

#: Width of the Gaussian in lines, and of its window on each side.
SIGMA, REACH = 1.0, 3
#: Lines whose smoothed ratio is over so many standard deviations of the page's are content (clusters of them: regions).
LEVEL = 0.9
#: A region's container is the deepest element that holds this share of the content lines' text.
SHARE = 2 / 3
#: A list is a menu if this share of its text is in links; outside of an article only.
LINKED = 0.6
#: Containers that are the whole page.
WHOLE = ("", "html", "body")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line. All but P and the headings may hold other lines.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements without readable text.
MUTE = frozenset("audio button canvas datalist iframe map math noembed noframes noscript object script select style svg template textarea title video".split())
#: Elements around the article; a header may be the article's own.
FURNITURE = frozenset("aside dialog footer menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that name what stands around an article: advert, menu, notice, sidebar, form, comments.
AROUND = frozenset(
    "ad ads adbox adslot adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion outbrain taboola banner "
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs toolbar topbar pagination pager skiplink "
    "sidebar sidebars aside rail widget widgets footer copyright colophon "
    "cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay paywall toast "
    "newsletter subscribe subscription signup signin login search share sharing social follow related recommended recommendations teaser teasers trending popular "
    "comment comments commentlist discussion disqus respond reply replies hidden".split()
)
#: Of these an ARTICLE or MAIN that is named so is not the article.
NOT_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
HEADS = frozenset(("header", "masthead", "head"))
CONTENT = frozenset("article body content contents entry main page post story text wrapper container".split())
#: A word after one of these names what the element has beside it, not what it is.
BESIDE = frozenset("with has no without open".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


def names_of(attrs: dict[str, str | None]) -> list[list[str]]:
    """The class names and the id, each as its words in lower case."""
    found = [*(attrs.get("class") or "").split(), *(attrs.get("id") or "").split()]
    return [[w.lower() for w in _CAMEL.split(x) if w] for x in found]


def hidden(attrs: dict[str, str | None]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I))


def stands_around(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """Whether the element is furniture of the page or hidden, by its tag, role, class and id."""
    if hidden(attrs):
        return tag not in ("html", "body")
    if tag in ("html", "body"):
        return False
    names = names_of(attrs)
    if tag in ("article", "main"):
        return any(x and (x[0] in NOT_ARTICLE or x[-1] in NOT_ARTICLE) and not BESIDE & set(x) for x in names)
    role = (attrs.get("role") or "").lower()
    if tag in FURNITURE or role in ROLES:
        return not (role == "banner" and in_article)
    if role in ("main", "article"):
        return False
    if not in_article and (tag == "header" or any(x and x[-1] in HEADS and not CONTENT & set(x[:-1]) for x in names)):
        return True
    return around_by_name(names)


def around_by_name(names: list[list[str]]) -> bool:
    if any(len(x) == 1 and x[0] in CONTENT for x in names):
        return False
    return any(w in AROUND and not BESIDE & set(x) for x in names for w in x)


@dataclass
class Node:
    tag: str
    parent: int
    around: bool
    closed: bool = False
    article: bool = False
    named: bool = False  # stands around by its class or id only


@dataclass
class Line:
    """A line's text, the element it stands in, the tags since the line before, how many characters are in links, and the
    level of a heading (0 for none)."""

    text: str
    node: int
    tags: int
    linked: int
    heading: int


@dataclass
class Open:
    tag: str
    node: int
    depth: int = 1
    inline: bool = False


class Reader(HTMLParser):
    """Lines and elements from the events of the standard library's parser, in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, False)]
        self.lines: list[Line] = []
        self.stack = [Open("", 0)]
        self.parts: list[str] = []
        self.tags = self.linked = self.muted = 0
        self.heading, self.in_link = 0, False
        self.in_article = 0
        self.open: Counter[str] = Counter()

    def finish(self) -> None:
        """The end of the page: a tag or comment that it breaks off has no text."""
        if re.match("<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""
        self.close()
        self.cut()

    def parse_html_declaration(self, i):
        """Sections and conditions are comments, as for browsers; the parser takes them for errors."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.stack[-1].node, self.tags, self.linked, self.heading))
            self.tags = 0
        self.parts.clear()
        self.linked = self.heading = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCKS
        if tag == "a":
            self.in_link = True
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if block:
            self.cut()
            self.heading = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
            if self.stack[-1].tag == "p":
                self._pop()
            if tag == "li" and self.open[tag]:  # its end tag may be left out
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag in ("ul", "ol", "menu"):
                        break
                    if self.stack[i].tag == "li":
                        self._pop(i)
                        break
        if tag in VOID:
            return
        top = self.stack[-1]
        if top.inline and top.tag == tag:
            top.depth += 1
            return
        around = tag in MUTE or (bool(attrs) or tag in FURNITURE or tag == "header") and stands_around(tag, dict(attrs), self.in_article > 0)
        if not block or tag == "p" or self.heading:
            if not around:
                return
            self._push(Open(tag, top.node if not block else self._node(tag, True), inline=not block))
            self.muted += not block
            return
        article = not around and (tag in ("article", "main") or ("role", "main") in attrs or ("role", "article") in attrs)
        self._push(Open(tag, self._node(tag, bool(around), article, bool(around) and tag == "div" and around_by_name(names_of(dict(attrs))) and not hidden(dict(attrs)))))

    def _node(self, tag: str, around: bool, article: bool = False, named: bool = False) -> int:
        self.nodes.append(Node(tag, self.stack[-1].node, around, article=article, named=named))
        self.in_article += article
        return len(self.nodes) - 1

    def _push(self, x: Open) -> None:
        self.stack.append(x)
        self.open[x.tag] += 1

    def _pop(self, to: int | None = None) -> None:
        """Closes all open elements from place `to` on (by default the last)."""
        to = len(self.stack) - 1 if to is None else to
        for x in self.stack[to:]:
            self.open[x.tag] -= 1
            self.muted -= x.inline
            if not x.inline:
                self.in_article -= self.nodes[x.node].article
        del self.stack[to:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = False
        block = tag in BLOCKS
        if block:
            self.cut()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            x = self.stack[i]
            if x.tag == tag:
                x.depth -= 1
                if not x.depth:
                    if not x.inline:
                        self.nodes[x.node].closed = True
                    self._pop(i)
                break
            if not block and not x.inline:  # an inline end tag closes no block
                break

    def handle_data(self, data):
        if not self.muted:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """The ratios under a Gaussian window; at the page's ends the window's rest counts as a whole."""
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(ratio, kernel)[REACH : REACH + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[REACH : REACH + len(ratio)]


@dataclass
class Region:
    lines: list[Line] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join(x.text for x in self.lines)


def with_clusters(nodes: list[Node], lines: list[Line], content: list[bool], node: int) -> int:
    """`node`, or the least element around it that also holds the rest of the clusters that begin or end in it; the whole
    page is none."""
    chain, up = {}, node
    while up >= 0:
        chain[up] = len(chain)
        up = nodes[up].parent
    levels = [0] * len(nodes)  # how far up from `node` the least element is that holds each element
    for i, n in enumerate(nodes):
        levels[i] = chain.get(i, levels[n.parent] if i else len(chain) - 1)
    need, run, inside = 0, 0, False
    for x, c in zip([*lines, None], [*content, False], strict=True):
        if c:
            run, inside = max(run, levels[x.node]), inside or levels[x.node] == 0
        else:
            need, run, inside = max(need, run if inside else 0), 0, False
    found = list(chain)[need]
    return node if nodes[found].tag in WHOLE else found


def main_region(reader: Reader) -> Region:
    """The lines of the page's article.

    A line's ratio is its characters over its tags. Lines whose smoothed ratio is over the threshold are content; where
    they cluster says which elements are the article: the ARTICLE and MAIN elements that hold some, or else the deepest
    element with most of their text, and with what their clusters have beside it. Of these all lines stay, in page order, but for what stands around (adverts, menus,
    forms, comments and the like inside them); where only the whole page is left as container, the lines from the first
    to the last content line, with headings right before.
    """
    nodes, lines = reader.nodes, reader.lines
    if not lines:
        return Region()
    below = [n.article for n in nodes]  # whether the element holds an article or its title
    main, letters = [n.article and n.tag == "main" for n in nodes], [0] * len(nodes)
    for x in lines:
        letters[x.node] += len(x.text)
        below[x.node] |= x.heading == 1
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        below[up], main[up], letters[up] = below[up] or below[i], main[up] or main[i], letters[up] + letters[i]
    for i, n in enumerate(nodes):  # a name may tell how the page is laid out: what holds the article isn't beside it
        if n.named and n.tag == "div" and (main[i] or (below[i] and 2 * letters[i] > letters[0])):
            n.around = False
    unclosed = [-1] * len(nodes)  # furniture that was never closed ends where an article begins
    for i, n in enumerate(nodes[1:], 1):
        if n.article and unclosed[n.parent] > 0:
            n.parent = nodes[unclosed[n.parent]].parent
        unclosed[i] = unclosed[n.parent] if unclosed[n.parent] > 0 else i if n.around and not n.closed else -1
    for i, n in enumerate(nodes):  # parents stand before their children
        form = n.tag == "form" and not below[i]
        n.around = n.around or form or (i > 0 and nodes[n.parent].around)
    ratio = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines], dtype=np.float64))
    content = [bool(c) and not nodes[x.node].around for c, x in zip(ratio > LEVEL * ratio.std(), lines, strict=True)]
    if not any(content):
        content = [not nodes[x.node].around for x in lines]

    held, sizes, links = ([0] * len(nodes) for _ in range(3))  # characters of content lines, of all lines, in links
    for x, c in zip(lines, content, strict=True):
        if not nodes[x.node].around:
            held[x.node] += len(x.text) * c
            sizes[x.node] += len(x.text)
            links[x.node] += min(x.linked, len(x.text))
    total = sum(held)
    for i in range(len(nodes) - 1, 0, -1):
        for each in (held, sizes, links):
            each[nodes[i].parent] += each[i]

    articles = [i for i, n in enumerate(nodes) if n.article and not n.around and sizes[i]]
    chosen = [i for i in articles if held[i]] or sorted(articles, key=lambda i: -sizes[i])[:1]
    inner = [i for i in chosen if nodes[i].tag != "main" and not (nodes[i].parent in chosen and nodes[nodes[i].parent].tag == "article")]
    outer = [i for i in chosen if i not in inner]
    if inner and outer and 2 * sum(held[i] for i in inner) < max(held[i] for i in outer):
        chosen = outer
    elif inner:
        chosen = inner
    whole = False
    if not chosen:
        best = max((i for i in range(len(nodes)) if total and held[i] >= SHARE * total and not nodes[i].around), default=0)
        chosen = [with_clusters(nodes, lines, content, best)]
        whole = nodes[chosen[0]].tag in WHOLE
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        menu = not articles and n.tag in ("ul", "ol", "dl", "table") and links[i] > LINKED * sizes[i]
        inside[i] = not n.around and not menu and (i in chosen or (i > 0 and inside[n.parent]))
    kept = [i for i, x in enumerate(lines) if inside[x.node]]
    if whole and kept:
        own = set(kept)
        seeds = [i for i in kept if content[i]] or kept
        first = seeds[0]
        while first - 1 in own and lines[first - 1].heading:
            first -= 1
        kept = [i for i in kept if first <= i <= seeds[-1]]
    return Region([lines[i] for i in kept])


def extract(html: str) -> Region:
    """The main region of one page."""
    reader = Reader()
    reader.feed(html)
    reader.finish()
    return main_region(reader)


def extract_pages(pages: DataFrame, html_col: str = "html", columns: list[str] | None = None) -> DataFrame:
    """_row (a struct of `columns` of each row, all by default), text and n_chars of each page's main region.

    A line is the text between two block elements; character references are decoded, white space is one space, lines
    are joined by newlines; nothing is cut off. One pass over the rows in their partitions: no shuffle, memory bounded by
    a slice of an Arrow batch or one longer page. Null and empty pages, and pages without any text, give ''; rows with
    null or repeated ids are rows of their own; an empty table gives no rows; the struct keeps columns of any name.
    """

    def make():
        def rows(data, offsets, texts):
            found = [extract(bytes(data[a:b]).decode("utf-8", "replace")).text for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return [pa.array(found, type=pa.string()), pa.array([len(x) for x in found], type=pa.int64())]

        return rows

    return map_texts(pages, html_col, "text string, n_chars long", make, columns)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return extract_pages(load(spark, sf_dir, "pages"), columns=["page_id", "url"]).select("_row.page_id", "_row.url", "text", "n_chars")
