"""Main text of HTML pages by text-to-tag ratios over a stream of parser events.

The standard library's parser streams a page as events. They are gathered to blocks, the lines of the
rendered page, each with its text, its number of tags and its place in the tree of elements; end tags that
HTML lets authors leave out (of p, li, dd, dt, option, head, rows and cells) are implied. A block's ratio is its
characters over its tags. Blocks of elements that HTML names as something else (menus, page headers, footers,
asides, scripts, styles, controls) have ratio 0. Class and id words and forms are hints: a strong hint sets the
ratio to 0, unless the element holds most of the page's text and no article stands elsewhere; a weak hint counts only
for elements of links or, outside articles, of low ratio.

The ratios are smoothed by a Gaussian over neighbouring blocks and split into two clusters by a threshold
(means of the two sides). The content region is found from the high cluster: from the root, go down to the child
that holds most of the cluster's characters (over half for article and main elements, over four fifths
for others). Of an article element all blocks are taken that are not boilerplate. Of another region, the stretch
from the first to the last high block is, and on at both ends as far as blocks are neither boilerplate nor mostly
links (short paragraphs), with the heading before it.

Edge cases: null or empty html gives an empty text; broken or unclosed markup is read as far as the parser
goes; text without any tag is one block; a page without text gives ''; pages may be of any length; repeated rows
give equal results; other columns of pages, whatever their names, are not read. Character references are decoded;
white space within a block (line breaks by <br> too) becomes one space; blocks are joined by a newline in page order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
RADIUS = 2
#: A block with more of its text in links than this is a list of links, where no article element says otherwise.
LINK_SHARE = 0.6
#: Link share from which a weak hint counts.
HINT_LINKS = 0.4
#: Share of the page's text from which a strong hint is held for wrong; for words of reader comments.
MOST_TEXT, MOST_COMMENTS = 0.5, 0.9
#: Share of the text that free articles must have for hints elsewhere to be believed whatever they hold.
ARTICLE_TEXT = 0.1
#: Share of the high cluster's characters with which a region goes down to a child.
INTO_ARTICLE, INTO_OTHER = 0.5, 0.8

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td textarea tfoot th thead title tr ul caption button canvas datalist iframe noscript object script style svg template audio video".split()
)
#: Elements with text that is never a block of its own row: a cell's text joins its row's.
CELLS = frozenset(("td", "th"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "aside button canvas datalist dialog footer head iframe menu nav noscript object script select style svg "
    "template textarea audio video title".split()
)
HEAD_ONLY = frozenset("base head html link meta noscript script style template title".split())
#: Elements that do not end an open paragraph.
IN_PARAGRAPH = frozenset("button canvas datalist iframe noscript object optgroup option script select style svg template textarea audio video".split())
#: An open element of the set is ended by a start of the name; not beyond the elements of the second set.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "caption")), frozenset(("table",))),
    "thead": (frozenset(("caption",)), frozenset(("table",))),
}
#: End tags do not reach beyond these.
FENCES = frozenset("table td th template object caption".split())
TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption".split())
WRAPS = frozenset("html body div section article main center table tbody tr td form fieldset details".split())
ARTICLES = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words of class and id attributes that name something besides the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertorial adsense adbox adslot banner sponsor sponsored promo promotion promotions "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs topbar masthead footer sidebar sidebars aside widget widgets "
    "share sharing newsletter subscribe subscription signup login signin "
    "cookie cookies consent gdpr notice notices notification popup modal overlay paywall pagination pager toolbar copyright disclaimer".split()
)
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Words that articles use too.
WEAK_HINTS = frozenset("rail reply replies respond discussion social related recommended recommendation recommendations trending popular search legal".split())
#: A word after one of these says how a page is laid out.
MODIFIERS = frozenset("has with without no non is not".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FREE, WEAK, STRONG, COMMENT, HARD = range(5)


def hint(value: str, cache: dict[str, int] = {}) -> int:  # noqa: B006  shared on purpose, bounded below
    """The strongest hint of a class or id attribute."""
    if (sign := cache.get(value)) is None:
        sign = FREE
        for name in value.split():
            before = ""
            for word in map(str.lower, _WORD.findall(name)):
                if before not in MODIFIERS:
                    sign = max(sign, COMMENT if word in COMMENTS else STRONG if word in HINTS else WEAK if word in WEAK_HINTS else FREE)
                before = word
        if len(cache) > 50_000:
            cache.clear()
        cache[value] = sign
    return sign


class Node:
    """An element that holds blocks. Parents come before children in a page's list."""

    __slots__ = ("article", "parent", "sign", "tag")

    def __init__(self, tag: str, parent: int, sign: int, article: bool):
        self.tag, self.parent, self.sign, self.article = tag, parent, sign, article


class Block:
    __slots__ = ("linked", "node", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, node: int):
        self.text, self.tags, self.linked, self.node = text, tags, min(linked, len(text)), node


class PageEvents(HTMLParser):
    """Gathers the blocks of a page and the tree of the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.nodes = [Node("", -1, FREE, False)]
        self.open: list[tuple[str, int]] = []  # name and node; -1: a link, -2: an inline element that is left out
        self.at = 0
        self.links = self.muted = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append(Block(text, self.tags, self.linked, self.at))
                self.tags = 0
            self.parts, self.linked = [], 0

    def sign(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in NEVER or (tag == "header" and not self.nodes[self.at].article):
            return HARD
        if tag in ("html", "body", "main"):
            return FREE
        sign = STRONG if tag == "form" else FREE
        for name, value in attrs:
            if name in ("class", "id"):
                sign = max(sign, hint(value) if value else FREE)
            elif name == "role":
                if value and value.lower() in ROLES:
                    sign = max(sign, STRONG)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return HARD
        return sign

    def pop(self) -> None:
        name, node = self.open.pop()
        if node > 0:
            if name not in CELLS:
                self.flush()
            self.at = self.nodes[node].parent
        elif node == -1:
            self.links -= 1
        else:
            self.muted -= 1

    def end(self, names: frozenset[str], fences: frozenset[str]) -> None:
        """Ends the innermost open element of the names with all in it, unless a fence is met before."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in names:
                while len(self.open) > k:
                    self.pop()
                return
            if name in fences:
                return

    def imply(self, tag: str) -> None:
        if tag not in HEAD_ONLY and any(name == "head" for name, _ in self.open[:4]):
            self.end(frozenset(("head",)), FENCES)
        if tag in IMPLIED:
            self.end(*IMPLIED[tag])
        elif tag not in IN_PARAGRAPH:
            self.end(frozenset(("p",)), FENCES)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag == "hr":
            self.imply(tag)
            if tag in CELLS:
                self.parts.append(" ")
            elif tag != "button":
                self.flush()
        elif tag in ("br", "img"):
            self.parts.append(" ")
        self.tags += 1
        if tag in BLOCKS:
            sign = self.sign(tag, attrs)
            if sign and tag in (*CELLS, "button"):
                self.flush()
            here = self.nodes[self.at]
            self.nodes.append(Node(tag, self.at, sign, here.article or tag in ARTICLES))
            self.at = len(self.nodes) - 1
            self.open.append((tag, self.at))
        elif tag in ("a", "span"):
            if attrs and self.sign(tag, attrs) >= STRONG:
                self.muted += 1
                self.open.append((tag, -2))
            elif tag == "a":
                self.links += 1
                self.open.append((tag, -1))
            elif tag == "span":
                self.open.append((tag, 0))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.imply(tag)
            self.flush()
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in ("a", "span"):
            for k in range(len(self.open) - 1, -1, -1):
                name, node = self.open[k]
                if name == tag:
                    del self.open[k]
                    self.links -= node == -1
                    self.muted -= node == -2
                    break
                if node > 0 and name in FENCES:
                    break
        elif tag in BLOCKS:
            if tag not in CELLS:
                self.flush()
            self.end(frozenset((tag,)), frozenset() if tag in FENCES or tag in ("tr", "tbody", "thead", "tfoot") else FENCES)

    def handle_data(self, data: str) -> None:
        if self.muted or (self.at and self.nodes[self.at].tag in ("script", "style")):
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    whole, padded = sum(weights), [0.0] * radius + values + [0.0] * radius
    return [sum(w * x for w, x in zip(weights, padded[k : k + 2 * radius + 1], strict=True)) / whole for k in range(len(values))]


def threshold(values: list[float]) -> float:
    """The boundary between two clusters of values: half-way between their means."""
    low, high = min(values), max(values)
    for _ in range(20):
        mid = (low + high) / 2
        below, above = [v for v in values if v <= mid], [v for v in values if v > mid]
        if not below or not above:
            return mid
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def believed(nodes: list[Node], blocks: list[Block]) -> list[bool]:
    """By node, whether it or an element around it is boilerplate by its name or by a strong hint that is believed."""
    under = [FREE] * len(nodes)
    for k, node in enumerate(nodes):
        under[k] = max(node.sign, under[node.parent] if k else FREE)
    mass = [0] * len(nodes)
    for b in blocks:
        mass[b.node] += len(b.text) - b.linked
    whole = sum(m for k, m in enumerate(mass) if under[k] < HARD)
    articles = sum(m for k, m in enumerate(mass) if under[k] < STRONG and nodes[k].article)
    void = articles < ARTICLE_TEXT * whole
    gone = [False] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        sign = nodes[k].sign
        if sign >= STRONG:
            gone[k] = sign == HARD or not void or mass[k] <= (MOST_COMMENTS if sign == COMMENT else MOST_TEXT) * whole
        if k and not gone[k]:
            mass[nodes[k].parent] += mass[k]
    for k in range(1, len(nodes)):
        gone[k] = gone[k] or gone[nodes[k].parent]
    return gone


def weakly_hinted(nodes: list[Node], blocks: list[Block], ratios: list[float], limit: float) -> list[bool]:
    """By node, whether a weak hint on it or around it counts."""
    size, linked, most = [0] * len(nodes), [0] * len(nodes), [0.0] * len(nodes)
    for b, ratio in zip(blocks, ratios, strict=True):
        size[b.node] += len(b.text)
        linked[b.node] += b.linked
        most[b.node] = max(most[b.node], ratio)
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        size[up], linked[up], most[up] = size[up] + size[k], linked[up] + linked[k], max(most[up], most[k])
    gone = [n.sign == WEAK and (linked[k] > HINT_LINKS * size[k] or (not n.article and most[k] <= limit)) for k, n in enumerate(nodes)]
    for k in range(1, len(nodes)):
        gone[k] = gone[k] or gone[nodes[k].parent]
    return gone


def region(nodes: list[Node], blocks: list[Block], high: list[int]) -> int:
    """The node that holds the high cluster: down from the root while one child has most of its characters."""
    mass, leaf = [0] * len(nodes), [True] * len(nodes)
    for k in high:
        mass[blocks[k].node] += len(blocks[k].text)
    children: list[list[int]] = [[] for _ in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        mass[up] += mass[k]
        leaf[up] = leaf[up] and leaf[k] and nodes[k].tag in TABLE_PARTS
        children[up].append(k)
    at = 0
    while nodes[at].tag != "article":
        best = max(children[at], key=mass.__getitem__, default=0)
        into = nodes[best]
        if into.tag in ARTICLES:
            if mass[best] <= INTO_ARTICLE * mass[0]:
                break
        elif nodes[at].article and not inner_article(nodes, children, best, mass):
            break
        elif into.tag not in WRAPS or leaf[best] or mass[best] <= INTO_OTHER * mass[0]:
            break
        at = best
    return at


def inner_article(nodes: list[Node], children: list[list[int]], at: int, mass: list[int]) -> bool:
    """Whether the way down from a node of main, by the heaviest child, comes to an article with most of the cluster."""
    while at and mass[at] > INTO_ARTICLE * mass[0]:
        if nodes[at].tag == "article":
            return True
        at = max(children[at], key=mass.__getitem__, default=0)
    return False


def title(nodes: list[Node], blocks: list[Block], good: list[bool], first: int, within: bool = False) -> range:
    """Blocks from the first-level heading before a region to its start; within: of the same main element only."""
    at = first
    while at and good[at - 1] and (not within or nodes[blocks[at - 1].node].article):
        at -= 1
        if nodes[blocks[at].node].tag == "h1":
            return range(at, first)
    return range(0)


def main_blocks(html: str | None) -> list[str]:
    """Texts of the main blocks of a page, in page order."""
    if not html:
        return []
    page = PageEvents()
    page.feed(html)
    page.close()
    page.flush()
    nodes, blocks = page.nodes, page.blocks
    gone = believed(nodes, blocks)
    ratios = [0.0 if gone[b.node] else len(b.text) / max(1, b.tags) for b in blocks]
    if not any(ratios):
        return []
    scores = smoothed(ratios)
    limit = threshold(scores)
    weak = weakly_hinted(nodes, blocks, ratios, limit)
    live = [k for k, b in enumerate(blocks) if not gone[b.node] and not weak[b.node]] or [k for k, b in enumerate(blocks) if not gone[b.node]]
    high = [k for k in live if scores[k] > limit] or [max(live, key=scores.__getitem__)]
    top = region(nodes, blocks, high)
    inside = [False] * len(nodes)
    inside[top] = True
    for k in range(top + 1, len(nodes)):
        inside[k] = inside[nodes[k].parent]
    lives = set(live)
    good = [k in lives and b.linked <= LINK_SHARE * len(b.text) for k, b in enumerate(blocks)]
    if nodes[top].article:
        taken = [k for k in live if inside[blocks[k].node]]
        return [blocks[k].text for k in [*title(nodes, blocks, good, taken[0], within=True), *taken]]
    marked = [k for k in high if inside[blocks[k].node]]
    first, last = marked[0], marked[-1]
    while first and good[first - 1] and inside[blocks[first - 1].node]:
        first -= 1
    while last + 1 < len(blocks) and good[last + 1] and inside[blocks[last + 1].node]:
        last += 1
    return [blocks[k].text for k in [*title(nodes, blocks, good, first), *(k for k in range(first, last + 1) if good[k])]]


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(html))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        columns = [*(batch.column(n) for n in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id long, url, html). One scan, no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
