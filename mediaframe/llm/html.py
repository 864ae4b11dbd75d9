"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A block's evidence (kind of element, its surroundings and their class names, link
share, length, sentence marks) is a cost for either label and becomes the capacity of its edge to the source
(content) or the sink (boilerplate). Neighbouring blocks and blocks of one parent are joined by edges that weigh
less the further apart they are in the tree. The minimum cut is the cheapest labelling; the source side is the text.

Only navigation, footers and unseen elements are certain. Every other name or kind of element has a finite cost that
its blocks inherit, and none where it encloses the page: a form around landmarks, a named wrapper around ``main`` or an
article with its headline, a partly named one around landmarks and most of the text. The costs are set by hand, not fitted: a strong one
outweighs the best paragraph, an article and its neighbours together, a weak one the best paragraph alone.

Defined cases: null or empty html has the empty text; markup that is cut off anywhere is read as far as it goes;
scripts, styles and comments never reach a block; equal pages and repeated rows give equal texts, one row each; an empty
table gives an empty result. A page of any size is read whole, one page at a time, however deep its elements lie.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|canvas)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
PART = re.compile(r"[^a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title select option datalist dialog".split())
CERTAIN = frozenset("nav footer".split())
UNLIKELY = frozenset("aside form menu button fieldset".split())
LANDMARKS = frozenset("main article nav header footer h1".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr select article section div main aside nav footer header body html form blockquote".split())
#: Words in class, id and role names.
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu sidebar aside footer comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup popup modal overlay widget login search pagination pager toolbar masthead skip complementary contentinfo disclaimer copyright".split())
TOP_NAMES = frozenset("header banner topbar".split())
GOOD_NAMES = frozenset("article content entry main post story body text prose".split())
#: Words that stand for readers' comments even as a part of a name.
READERS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: First and last parts of names that state a property of the page, not what the element is.
BEFORE = frozenset("has no with without not hide category cat tag term supports".split())
AFTER = frozenset("open opened closed enabled disabled on off none fixed".split())

HARD = 1e6
STRONG = 8.0
WEAK = 5.0
ADJACENT = 1.0
SIBLING = 0.5


class Element:
    """An element: its place in the tree, what its tag and names say, what lies inside, and the evidence that results."""

    __slots__ = ("tag", "parent", "depth", "hidden", "hard", "strong", "weak", "top", "good", "page", "main", "chars", "plus", "minus")

    def __init__(self, tag: str, parent: Element | None, attrs: str = "") -> None:
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)
        self.hard = tag in CERTAIN or bool(attrs and UNSEEN.search(attrs)) or bool(parent and parent.hard)
        self.strong, self.weak, self.top, self.good = False, False, 0.0, False
        self.page, self.main, self.chars = False, False, 0
        self.plus = self.minus = 0.0
        if attrs and tag not in ("body", "html", "main"):
            self.read(attrs)

    def read(self, attrs: str) -> None:
        """Words of the names: a whole name is strong, a part of one weak, a property of the page nothing."""
        for kind, *values in NAMES.findall(attrs):
            for name in HUMP.sub("-", "".join(values)).lower().split():
                parts = [p for p in PART.split(name) if p]
                if not parts or (len(parts) > 1 and (parts[0] in BEFORE or parts[-1] in AFTER)):
                    continue
                whole = len(parts) == 1 and kind.lower() != "aria-label"
                bad = sum(p in BAD_NAMES for p in parts)
                self.strong |= bad > 1 or (bad and whole) or any(p in READERS for p in parts)
                self.weak |= bad > 0
                if any(p in TOP_NAMES for p in parts):
                    self.top = max(self.top, STRONG if whole else WEAK)
                self.good |= any(p in GOOD_NAMES for p in parts)

    def weigh(self, half: float) -> None:
        """Evidence for and against the blocks inside, from the parent's and the element's own."""
        above = self.parent
        good, bad = above.plus, above.minus
        cost = 0.0
        if self.tag in UNLIKELY and not (self.page if self.tag == "form" else self.main):
            cost = STRONG
        if not self.main:
            if self.strong:
                cost = STRONG
            elif self.weak and not (self.page and self.chars > half):
                cost = max(cost, WEAK)
            if good <= 0 and self.tag != "article":
                cost = max(cost, STRONG if self.tag == "header" else self.top)
        if cost:
            good, bad = 0.0, min(bad + cost, 2 * STRONG)
        if bad < STRONG:
            if self.tag in ("article", "main"):
                good = max(good, 4.0)
            elif self.good and not cost and self.tag not in ("body", "html"):
                good = max(good, 2.0)
        self.plus, self.minus = good, bad


class Block:
    __slots__ = ("text", "place", "link", "score")

    def __init__(self, text: str, place: Element, link: int, score: float) -> None:
        self.text, self.place, self.link, self.score = text, place, link, score


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    root = Element("", None)
    stack, every = [root], [root]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    link, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal link
        if pieces:
            top = stack[-1]
            if not top.hidden:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    out.append(Block(text, top, link, 0.0))
            pieces.clear()
        link = 0

    def close(tags, stop) -> None:
        """Close the innermost open element among ``tags``, if none of ``stop`` is open inside it."""
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                open_tags.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def found(what: str, upto: list[Element]) -> None:
        """Tell the open elements what lies in them; those above one that knows know already."""
        for e in reversed(upto):
            if getattr(e, what):
                return
            setattr(e, what, True)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if links:
                link += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = 0
            if tag in INLINE:
                continue
            flush()
            close({tag}, ())
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 1
            continue
        flush()
        links = 0
        if tag in CLOSES_P:
            close({"p"}, HOLDS)
        if tag in OWN_KIND:
            close(OWN_KIND[tag], HOLDS - OWN_KIND[tag])
        if tag in VOID:
            continue
        if tag in LANDMARKS:
            found("page", stack)
        if tag == "main":
            found("main", stack)
        elif tag == "h1" and open_tags["article"]:
            inner = max(i for i, e in enumerate(stack) if e.tag == "article")
            if not stack[inner].strong:
                found("main", stack[:inner])
        stack.append(Element(tag, stack[-1], m["attrs"]))
        every.append(stack[-1])
        open_tags[tag] += 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    for block in out:
        block.place.chars += 0 if block.place.hard else len(block.text)
    for e in reversed(every[1:]):
        e.parent.chars += e.chars
    for e in every[1:]:
        e.weigh(root.chars / 2)
    for block in out:
        e = block.place
        block.score = -HARD if e.hard else e.plus - e.minus + own_score(block.text, e.tag, block.link)
    return out


def own_score(text: str, tag: str, link: int) -> float:
    """Evidence of the block itself."""
    score = min(len(text), 200) / 100 - 1.0
    if tag in ("p", "pre", "blockquote"):
        score += 1.0
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 0.8
    elif tag in ("li", "td", "th", "dd", "dt"):
        score -= 0.3
    if text[-1] in ".!?:;\"'”’)…。":
        score += 0.5
    return score - 5.0 * min(1.0, link / max(1, len(text)))


class Network:
    """A flow network for minimum cuts (blocking flows over shortest paths)."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, forth: float, back: float) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [forth, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in self.edges[a]:
                b = self.to[e]
                if level[b] < 0 and self.room[e] > 1e-9:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturate the network; True for the nodes that the source still reaches."""
        to, room, edges = self.to, self.room, self.edges
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            nth = [0] * len(edges)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    flow = min(room[e] for e in path)
                    cut = len(path)
                    for i, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if room[e] <= 1e-9 and i < cut:
                            cut = i
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while nth[a] < len(edges[a]):
                    e = edges[a][nth[a]]
                    if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    nth[a] += 1
                if nth[a] < len(edges[a]):
                    path.append(edges[a][nth[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    nth[a] += 1
                else:
                    break


def distance(a: Element, b: Element) -> int:
    """Tree steps between two elements."""
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
        steps += 1
    return steps


def label(found: list[Block]) -> list[bool]:
    """True for content: the minimum cut of the page's network."""
    n = len(found)
    if not n:
        return []
    net = Network(n + 2)
    parents: dict[int, int] = {}
    for i, block in enumerate(found):
        if block.score > 0:
            net.join(n, i, block.score, 0)
        elif block.score < 0:
            net.join(i, n + 1, -block.score, 0)
        if i:
            weight = ADJACENT / (1 + distance(found[i - 1].place, block.place))
            net.join(i - 1, i, weight, weight)
        parent = id(block.place.parent)
        last = parents.get(parent)
        if last is not None and last != i - 1:
            net.join(last, i, SIBLING, SIBLING)
        parents[parent] = i
    return net.source_side(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    found = blocks(page) if page else []
    return "\n".join(b.text for b, good in zip(found, label(found)) if good)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(the columns of ``keep``, text, n_chars): one row per row of ``pages``."""
    names = [f"__k{i}" for i in range(len(keep))]
    source = pages.select(F.col(html_col).cast("string").alias("__html"), *(F.col(k).alias(n) for k, n in zip(keep, names)))
    kinds = [f"{n} {pages.schema[k].dataType.simpleString()}" for k, n in zip(keep, names)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                texts = [main_text(t) for t in texts_of(part, 0)]
                columns = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    out = source.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"]))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names)), "text", "n_chars")
