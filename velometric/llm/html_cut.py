"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A small classifier gives each block a cost for being called boilerplate and one for
being called content, from its tags, names, link density, length and punctuation: these are the capacities to the two
terminals. Neighbouring blocks, and blocks under one parent, are tied by capacities that fall with their distance in the
tree. A maximum flow finds the labelling of least total cost, so a short paragraph amid an article stays in and a long
notice amid menus stays out.

Pages are independent: the flow runs in an Arrow function over one page at a time.

Defined results: a null page is empty and gives the empty text; broken markup is read as far as it goes, what follows the
last `>` being text, in time that grows with the page; very long pages are taken whole; equal rows each get their row; extra
columns are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from velometric.llm.common import packed, slices, text_bytes

#: Never text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "title", "annotation"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var",
    # Of formulas, whose source in an annotation is silent.
    "annotation", "math", "menclose", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace",
    "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics",
}
#: Elements that end at the next of their kind or at a block element.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
PARAGRAPH_ENDS = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: What names and tags say, in units of the classifier.
AWAY_TAGS = {"nav", "aside", "footer", "form", "button", "select", "textarea", "menu", "dialog", "fieldset", "input"}
AWAY_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related",
    "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "tags", "teaser", "toolbar", "tracking", "widget", "widgets",
}
HOME_TAGS = {"article", "main"}
HOME_NAMES = {"article", "body", "content", "entry", "main", "post", "story", "text"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
#: What an article below does not undo, beside tags other than a form's, roles and hidden elements.
FIRM_NAMES = {
    "comment", "comments", "disqus", "modal", "popup", "promo", "promoted", "related", "replies", "respond", "sponsor",
    "sponsored", "teaser",
}
#: Names that tell how a page is laid out (such as "has-sidebar"), not what the element is.
STATES = {"has", "is", "no", "with", "without"}
#: Parts of names that leave the meaning of the others as it is ("site-header", "comment-list").
PLAIN = {
    "and", "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "btn", "center",
    "col", "column", "container", "content", "desktop", "entry", "fixed", "form", "global", "group", "hd", "ft", "icon",
    "icons", "inner", "item", "items", "js", "label", "large", "left", "link", "links", "list", "main", "mobile", "module",
    "more", "news", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site",
    "slot", "small", "sticky", "stories", "story", "text", "the", "title", "top", "unit", "user", "wp", "wrap", "wrapper",
}
_NAME = re.compile(r"[a-z]+")
#: Weight of evidence against an element's content, the same from a name with other parts in it ("social-science"), and
#: what is left of it for each element further down.
AWAY, HINT, FADE = 12.0, 3.0, 0.85
#: A form with this share of a page's text, most of it running text, is the page's frame.
FRAME = 0.8
#: Capacities are integers: a unit of evidence, and the ties between blocks.
UNIT = 100
NEXT_TIE, SIBLING_TIE = 60, 30


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    away: float
    #: Whether an article below is away too.
    firm: bool
    home: bool
    silent: bool
    #: Place, among the page's forms, of the one it stands in.
    form: int | None = None


@dataclass
class Block:
    text: str
    node: Node
    linked: int


def evidence(tag: str, attrs: dict[str, str | None], inside: bool, frame: bool = False) -> tuple[float, bool, bool]:
    """How much a tag with these attributes speaks against content below it, whether firmly so, and whether for it.

    A name counts in full where its other parts are plain. A form that is the page's `frame` says nothing.

    `inside` an article a header holds its title; elsewhere it is the page's.
    """
    words = [_NAME.findall(x) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()]
    told = [x for x in words if x and x[0] not in STATES]
    every = {n for x in told for n in x}
    names = {n for x in told if AWAY_NAMES.union(PLAIN, HOME_NAMES).issuperset(x) for n in x}
    hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"
    hidden |= "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
    if tag == "header":
        names.add("header")
    hints = (every & AWAY_NAMES) - names
    if inside:
        names.discard("header")
        hints.discard("header")
    if tag in ("html", "body"):
        names -= AWAY_NAMES
        hints.clear()
    role = (attrs.get("role") or "").lower()
    firm = hidden or tag in AWAY_TAGS - {"form"} or bool(names & FIRM_NAMES) or role in AWAY_ROLES - {"form"}
    away = firm or (tag == "form" and not frame) or bool(names & AWAY_NAMES) or role == "form"
    home = tag in HOME_TAGS or bool(every & HOME_NAMES) or role in ("main", "article")
    # An element that calls itself both (such as "article-comments") is judged by the narrower word.
    return AWAY if away else HINT if hints else 0.0, firm, home and not away and not hints


class BlockReader(HTMLParser):
    """Text blocks of a page, in its order."""

    def __init__(self, frames: frozenset[int] = frozenset()) -> None:
        """`frames` are the places, among the page's forms, of those that frame it."""
        super().__init__(convert_charrefs=True)
        self.frames, self.forms = frames, 0
        self.root = Node("", None, 0, 0.0, False, False, False)
        self.node, self.holder = self.root, self.root
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.linked = 0
        self.links = 0
        self.open: Counter[str] = Counter()
        self.unended: set[str] = set()

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append(Block(text, self.holder, self.linked))
            self.held.clear()
            self.linked = 0

    def leave(self, node: Node) -> None:
        """Closes everything down to and with `node`."""
        at = self.node
        while at is not node.parent:
            self.links -= at.tag == "a"
            self.open[at.tag] -= 1
            at = at.parent
        self.node = node.parent

    def implied(self, tag: str) -> None:
        """End tags that this start tag stands for."""
        at = self.node
        while at.parent is not None and at.tag in INLINE:
            at = at.parent
        if (at.tag == "p" and tag in PARAGRAPH_ENDS) or tag in CLOSED_BY.get(at.tag, ()):
            self.leave(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.held.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self.implied(tag)
        if tag in VOID:
            return
        up = self.node
        values = dict(attrs)
        self.forms += tag == "form"
        frame = tag == "form" and self.forms - 1 in self.frames
        away, firm, home = evidence(tag, values, up.home, frame) if attrs or tag not in INLINE else (0.0, False, False)
        # Firm evidence stays. Other evidence fades on its way down, and an article undoes what its ancestors' names say of the
        # page's layout.
        fresh = not up.firm and (tag in HOME_TAGS or (values.get("role") or "").lower() in ("main", "article"))
        inherited = AWAY if up.firm else 0.0 if fresh else up.away * (1 if tag in INLINE else FADE)
        self.node = Node(
            tag, up, up.depth + 1, max(away, inherited), up.firm or firm, (up.home or home) and away < AWAY,
            up.silent or tag in SILENT, self.forms - 1 if tag == "form" else up.form,
        )
        self.links += tag == "a"
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            if tag not in INLINE:
                self.flush()
            return
        at = self.node
        while at.parent is not None and at.tag != tag:
            if tag in INLINE and at.tag not in INLINE:
                return
            at = at.parent
        if tag not in INLINE:
            self.flush()
        if at.parent is not None:
            self.leave(at)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self.sought("--", super().parse_comment, i, report)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        name = _NAME.match(self.rawdata[i + 3 : i + 12].lower())
        try:
            return self.sought(name.group() if name else "", super().parse_marked_section, i, report)
        except AssertionError:  # of unknown name or none: a bogus comment up to the next `>`, as in browsers
            return self.parse_bogus_comment(i, report)

    def sought(self, kind: str, parse: Callable[[int, int], int], i: int, report: int) -> int:
        """What `parse` gives; once it finds no end of a kind, there is none further on either."""
        if kind in self.unended:
            return -1
        end = parse(i, report)
        if end < 0:
            self.unended.add(kind)
        return end

    def handle_data(self, data: str) -> None:
        if self.node.silent:
            return
        if not self.held:
            at = self.node
            while at.parent is not None and at.tag in INLINE and at.away <= at.parent.away:
                at = at.parent
            self.holder = at
        self.held.append(data)
        if self.links:
            self.linked += len(data.strip())


def read_blocks(html: str) -> list[Block]:
    """Read once, and again when a form turns out to frame the page."""

    def read(frames: frozenset[int] = frozenset()) -> list[Block]:
        reader = BlockReader(frames)
        # Behind the last `>` no markup can end: the parser would look for its end from every `<`.
        whole = html.rfind(">") + 1
        reader.feed(html[:whole])
        reader.close()
        if whole < len(html) and not reader.cdata_elem:
            reader.handle_data(unescape(html[whole:]))
        reader.flush()
        return reader.blocks

    blocks = read()
    frames = framing(blocks)
    return read(frames) if frames else blocks


def framing(blocks: list[Block]) -> frozenset[int]:
    """The form that holds nearly all text of a page, if most of that is text of ten words or more."""
    held: Counter[int] = Counter()
    running: Counter[int] = Counter()
    total = 0
    for block in blocks:
        length = len(block.text) - block.linked
        total += length
        if block.node.form is not None:
            held[block.node.form] += length
            running[block.node.form] += length if block.text.count(" ") >= 9 else 0
    return frozenset(f for f, n in held.items() if n >= FRAME * total and 2 * running[f] > n)


def costs(block: Block) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    content, boiler = 0.0, 0.0
    node = block.node
    boiler += node.away
    if node.home:
        content += 6
    density = min(1.0, block.linked / max(len(block.text), 1))
    boiler += 3 * density
    content += 2 * (1 - density) if node.tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "li", "td", "figcaption") else 0
    words = block.text.count(" ") + 1
    content += 1.5 if words >= 25 else 0.7 if words >= 10 else 0
    boiler += 1 if words < 4 and node.tag not in ("h1", "h2", "h3") else 0
    content += 0.5 if block.text[-1] in ".!?…:»”\"" else 0
    return round(UNIT * content), round(UNIT * boiler)


def tree_distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: with the next block, weaker the further apart in the tree, and with the last block of the parent."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, round(NEXT_TIE / (1 + tree_distance(blocks[i - 1].node, block.node)))))
        parent = id(block.node.parent or block.node)
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING_TIE))
        last[parent] = i
    return [e for e in out if e[2] > 0]


def content_side(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut, by Dinic's maximum flow.

    What a node could pass straight from source to sink is passed at once, so it keeps one terminal at most.
    """
    n = len(source)
    start, end = n, n + 1
    to, room = [], []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forward: int, backward: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forward)
        out[b].append(len(to))
        to.append(a)
        room.append(backward)

    for i in range(n):
        rest = source[i] - sink[i]
        if rest > 0:
            edge(start, i, rest, 0)
        elif rest < 0:
            edge(i, end, -rest, 0)
    for a, b, tie in edges:
        edge(a, b, tie, tie)
    while True:
        level = [-1] * (n + 2)
        level[start] = 0
        queue = deque([start])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[end] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        x = start
        while True:
            if x == end:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
            while place[x] < len(out[x]):
                e = out[x][place[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                place[x] += 1
            else:
                if x == start:
                    break
                e = path.pop()
                x = to[e ^ 1]
                place[x] += 1


def main_text(html: str) -> str:
    blocks = read_blocks(html)
    if not blocks:
        return ""
    source, sink = zip(*map(costs, blocks), strict=True)
    keep = content_side(list(source), list(sink), ties(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


@F.arrow_udf(StringType())
def extracted(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in (part for whole in arrays for part in slices(whole)):
        pages = (x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in array)
        yield pa.array([main_text(page) for page in pages], pa.string())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, `text` and `n_chars`."""
    rows = packed(pages).select(
        F.col(f"row.`{id_col}`").alias(id_col), F.col(f"row.`{url_col}`").alias(url_col), extracted(text_bytes(html_col)).alias("text")
    )
    return rows.select("*", F.char_length("text").cast("long").alias("n_chars"))
