"""Main text of web pages by composite text density (Sun, Song and Liao, "DOM Based Content Extraction via Text
Density", 2011).

The nodes are a page's block elements; inline elements are a part of their block. Elements that hold no article by their
tag (scripts, fields, nav, aside, footer and so on), hidden ones and containers whose whole name says so (class="comments",
"site-footer", not "share-price") are taken out first, and so is a form, unless the article stands in it (it has an article, main or h1, or
half of the page's text). What is taken out ends where its parent ends, and one that is never closed at the next block. A node of C characters, T tags, LC characters in links and LT links
has the density

    C / T * log(C / LC * T / LT), to the base ln(C / (C - LC) * LC + LCb / Cb * C + e)

where b is the body and a zero below a line counts as 1. The node whose children's densities have the largest sum is
the core. The least density on its path from the body is the threshold; every node that reaches it, in the core's
article if it has one, marks its own largest-sum node. The text is that of the smallest subtree that holds all marks.
Outside of article and main elements, parts that are mostly links and under the threshold go. A paragraph or heading that is
named as no part of an article goes only if its density is under the core's.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.batches import text_slices

#: Elements that are blocks of their own, that hold no text of a page, and that are no part of an article.
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption header hgroup details summary address center fieldset form hr".split()
)
SILENT = set("script style noscript template head title iframe object embed svg math canvas audio video map select option optgroup textarea datalist button label input nav aside footer menu dialog".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Words of class and id of what is no part of an article, words that may stand beside them, and roles.
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "reply replies respond disqus cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "widget toolbar pagination pager login signup signin search copyright disclaimer skip header topbar".split()
)
BESIDE = set(
    "site page main user reader top bottom left right side primary secondary global list lists item items box block area section container wrapper wrap inner outer group bar row column col panel "
    "content body posts post articles stories links link buttons button icons icon form thread threads message text label title slot unit zone region module component sticky fixed mobile desktop js".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_IN_PARAGRAPH = set("p h1 h2 h3 h4 h5 h6".split())
_TEXTS = _IN_PARAGRAPH | set("li dt dd td th blockquote pre figcaption caption".split())
#: What the start of an element ends, and within what.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "named", "keeps", "chars", "tags", "link_chars", "links", "density", "total", "enters", "leaves", "depth", "own_links")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, named: bool = False):
        #: noise goes; what is only named so is judged by its density. keeps: 2 above an article, 1 above its title.
        self.tag, self.parent, self.noise, self.named, self.keeps = tag, parent, noise, named, 0
        #: Nodes, and (text, whether in a link) in page order.
        self.children: list[Node | tuple[str, bool]] = []
        self.chars = self.link_chars = self.links = self.own_links = 0
        self.tags, self.density, self.total, self.enters, self.leaves = 1, 0.0, 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0


def _named(attrs: dict[str, str]) -> set[str]:
    """The words for which a class or the id, as a whole, names no part of an article."""
    found: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
        if words & NOISE and words <= NOISE | BESIDE:
            found |= words & NOISE
    return found


def _hidden(attrs: dict[str, str]) -> bool:
    return bool("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


class Page(HTMLParser):
    """A tree of a page's blocks, also of one whose tags are not closed. Time is that of the tags, however deep they are."""

    def __init__(self, html: str = ""):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.open: defaultdict[str, list[Node]] = defaultdict(list)  # the open nodes of each tag
        self.inline: list[Node] = []  # those that are no blocks
        #: Tags that are open in a part without article, from its own on, how many of each, and whether its own is never closed.
        self.silent: list[str] = []
        self.held: Counter[str] = Counter()
        self.unclosed = False
        self.ends = Counter(x.lower() for x in re.findall(r"</([a-zA-Z][a-zA-Z0-9]*)", html))
        self.link: Node | None = None  # the block in which the open link began

    def _silence(self, tag: str) -> None:
        self.silent, self.held, self.unclosed = [tag], Counter([tag]), not self.ends[tag]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            own = self.silent[0]
            if (
                (own in ("head", "title") and tag in ("body", "article", "main"))
                or (self.unclosed and tag in BLOCKS and len(self.silent) == 1)
                or (own == "label" and tag in BLOCKS and self.at.tag in _IN_PARAGRAPH)
            ):
                self.silent = []
            else:
                if tag not in VOID:
                    self.silent.append(tag)
                    self.held[tag] += 1
                return
        if tag in ("html", "body"):
            return
        found = {k: v or "" for k, v in attrs}
        if tag in SILENT:
            if tag not in VOID:
                self._silence(tag)
            return
        if tag == "br":
            self.at.children.append((" ", False))
        elif tag == "a":
            self.link = self.at
            self.at.own_links += 1
        elif tag in BLOCKS:
            self._implied(tag)
            if tag == "hr":
                return
            inside, names = self.open["article"] or self.open["main"], _named(found)
            if tag == "header":
                names = set() if inside else {"header"}
            elif inside:
                names -= {"header"}
            text = tag in _TEXTS
            noise = _hidden(found) or found.get("role", "").lower() in ROLES or bool(names and not text)
            self._enter(Node(tag, self.at, noise, bool(names) and text))
            if tag in ("article", "main", "h1"):
                level, x = 1 if tag == "h1" else 2, self.at
                while x and x.keeps < level and not (level == 1 and x.tag == "header"):  # a site's name is no article's
                    x.keeps, x = level, x.parent
        elif tag not in VOID and _hidden(found):
            self._enter(Node(tag, self.at, True))

    def _enter(self, node: Node) -> None:
        self.at.children.append(node)
        self.at = node
        self.open[node.tag].append(node)
        if node.tag not in BLOCKS:
            self.inline.append(node)

    def _implied(self, tag: str) -> None:
        """Ends what a block of this tag cannot stand in: an open paragraph, and the row, cell or item before."""
        while self.at.parent and self.at.tag in _IN_PARAGRAPH:
            self._leave(self.at)
        ends, stop = _ENDS.get(tag, (set(), set()))
        if not ends:
            return
        floor = max([x[-1].depth for t in stop if (x := self.open[t])] + [x.depth for x in self.inline[-1:]], default=0)
        last = min((x[-1] for t in ends if (x := self.open[t]) and x[-1].depth > floor), key=lambda x: x.depth, default=None)
        if last:
            self._leave(last)

    def _leave(self, node: Node) -> None:
        """Ends a node that is open, and all that is open in it."""
        if self.link and self.link is not node.parent:
            self.link = None
        while True:
            x = self.at
            self.open[x.tag].pop()
            if self.inline and self.inline[-1] is x:
                self.inline.pop()
            self.at = x.parent or self.root
            if x is node:
                return

    def handle_endtag(self, tag: str) -> None:
        self.ends[tag] -= 1
        if self.silent:
            if self.held[tag]:
                while self.silent:
                    self.held[x := self.silent.pop()] -= 1
                    if x == tag:
                        return
            if not self.open[tag]:  # else the parent ends, and with it what is silent
                return
            self.silent = []
        if tag == "a":
            self.link = None
        elif self.open[tag]:
            self._leave(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent and data:
            self.at.children.append((data, self.link is not None))


def _measure(root: Node) -> list[Node]:
    """Counts and densities of the tree without noise; the nodes, parents first."""
    nodes = _counted(root)
    forms = [n for n in nodes if n.tag == "form" and not n.keeps and 2 * n.chars < root.chars]
    if forms:
        for form in forms:
            form.noise = True
        nodes = _counted(root)
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        c, lc, tags = node.chars, node.link_chars, node.tags + node.links
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / tags * max(0.0, math.log(max(1.0, c / max(1, lc) * tags / max(1, node.links)))) / max(1.0, math.log(base) if base > math.e else 1.0)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node))
    return nodes


def _counted(root: Node) -> list[Node]:
    """The nodes without noise, parents first, with characters, tags and links of their own and of what is in them."""
    nodes, queue = [], [root]
    while queue:
        node = queue.pop()
        nodes.append(node)
        node.chars, node.link_chars, node.tags, node.links = 0, 0, 1, node.own_links
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.noise and not c.keeps)]
        queue.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags
                node.link_chars += c.link_chars
                node.links += c.links
            else:
                n = len("".join(c[0].split()))
                node.chars += n
                node.link_chars += n * c[1]
    return nodes


def _main(root: Node) -> tuple[Node, Node, float]:
    """The subtree of the main text, the core, and the threshold of density."""
    nodes = _measure(root)
    core = max(nodes, key=lambda n: n.total)  # the first of equals is the outermost
    if core.total <= 0:
        return root, root, 0.0
    for k, n in enumerate(nodes):  # parents come first, and a node's descendants are the nodes that follow it
        n.enters = n.leaves = k
    for n in reversed(nodes):
        if n.parent:
            n.parent.leaves = max(n.parent.leaves, n.leaves)
    path, x = [core], core
    while x.parent:
        path.append(x := x.parent)
    threshold = min(n.density for n in path)
    top = next((n for n in reversed(path) if n.tag in ("article", "main")), root)
    # a node's children's best are known when nodes are gone through backwards
    best = {}
    for n in reversed(nodes):
        best[n] = max([n, *(best[c] for c in n.children if isinstance(c, Node))], key=lambda x: x.total)
    marks = [best[n] for n in nodes[top.enters : top.leaves + 1] if n.density >= threshold and best[n].total > 0]
    first, last = min(m.enters for m in [core, *marks]), max(m.enters for m in [core, *marks])
    common = next(n for n in path if n.enters <= first and last <= n.leaves)
    return common, core, threshold


def _blocks(node: Node, core: Node, threshold: float, whole: bool) -> Iterator[str]:
    """The texts of blocks, in page order; whole: no part is left out for its links."""
    open_text: list[str] = []
    stack: list[Iterator] = [iter(node.children)]
    while stack:
        c = next(stack[-1], None)
        if isinstance(c, tuple):
            open_text.append(c[0])
            continue
        if text := " ".join("".join(open_text).split()):
            yield text
        open_text.clear()
        if c is None:
            stack.pop()
        elif not (c.named and c.density < core.density) and (whole or not (2 * c.link_chars > c.chars and c.links > 1 and c.density < threshold)):
            stack.append(iter(c.children))


def main_text(html: str | None) -> str:
    """The main text of one page: blocks joined by newlines; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    page.feed(html)
    page.close()
    node, core, threshold = _main(page.root)
    x: Node | None = core
    while x and x.tag not in ("article", "main"):
        x = x.parent
    return "\n".join(_blocks(node, core, threshold, x is not None))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns but html, and (which replace any of those names) text and n_chars (its code points).

    The text is taken from the whole html; a null, an empty one and one without text give an empty text. Repeated rows get equal
    texts; other columns pass through as they are.
    """
    kept = pages.drop(*[c for c in ("text", "n_chars") if c != html])
    fields = [f for f in kept.schema if f.name != html]
    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, html):
            texts = [main_text(x) for x in part.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(texts, pa.string())], [*(f.name for f in fields), "text"])

    return kept.mapInArrow(run, f"{schema}text string").withColumn("n_chars", F.length("text").cast("long"))
