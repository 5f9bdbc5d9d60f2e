"""Main text of HTML pages by composite text density (Sun, Song and Liao, 2011).

A page is read into a tree of elements, in time proportional to its length however broken it is (implied ends of p, li,
table parts and the like are supplied; what a page leaves open ends with its parent; an unfinished tag at the end is
dropped). Elements that can't be main text are set aside first: scripts, styles, navigation, page headers and footers,
asides, and elements whose class, id or role names a menu, sidebar, notice, advert or comments. A class or id sets an
element aside only if it holds half of the page's unlinked text at most, or no block elements; where the name is but a
part of a class token (has-sidebar), only if it holds a fifth at most and is no article. A form goes if it holds half at most.

Every node of body then gets its characters-per-tag density, adjusted for linked text, and its density sum, the sum over its
children. The node with the largest density sum is the content; the smallest density on its path up to body is the
threshold, and other subtrees of body of at least that density count as content too, each by its own node of largest
density sum. Articles only complete what the densities select: the article around the content node, or one selected beside
it, comes with its headings and short blocks, without blocks that are mostly links; main elements have no part in it.
Without an article, the nearest headings before the content node, siblings of it or of what holds it, come too.

Within content all blocks are kept: text between starts and ends of block elements, references decoded, white space one
space, trimmed, empty ones dropped. br is white space within its block. Null or empty html gives an empty text, as does a
page without text. Repeated rows and ties are kept, ties in density going to the earlier node. An empty table gives no
rows. Columns other than id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element names of the HTML standard, by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math object video audio canvas".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address"
    " header footer nav aside form fieldset details summary hr center dir menu hgroup search legend dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What ends when an element starts, the outer first, by groups of elements; a group's open element is in scope up to STOPS.
GROUP = {"p": "p", "li": "li", "dt": "term", "dd": "term", "option": "option", "td": "cell", "th": "cell", "tr": "row", "thead": "rows", "tbody": "rows", "tfoot": "rows", "head": "head"}
CLOSES = {"li": ["li"], "dt": ["term"], "dd": ["term"], "option": ["option"], "td": ["cell"], "th": ["cell"], "tr": ["row", "cell"], "thead": ["rows", "row", "cell"], "tbody": ["rows", "row", "cell"], "tfoot": ["rows", "row", "cell"], "body": ["head"]}
STOPS = frozenset("ul ol table body html article section div main td blockquote dl aside form nav footer header".split())
TABLE = ("cell", "row", "rows")
ASIDE_TAGS = frozenset("head nav footer aside button select label menu dialog script style noscript iframe template svg math object video audio canvas textarea title input".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs"
    " sidebar aside footer comment comments commentlist disqus respond reply replies cookie cookies consent notice notices alert popup modal overlay share sharing social"
    " subscribe subscription newsletter signup related recommended widget toolbar masthead skip pagination pager login".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "links", "tags", "link_tags", "density", "total", "off", "named", "scope")

    def __init__(self, tag: str, parent: Node | None, off: bool = False):
        self.tag, self.parent, self.off, self.named = tag, parent, off, 1.0
        self.items: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        scope: dict[str, Node] = parent.scope if parent else {}
        if tag in STOPS:
            scope = {} if tag == "table" else {k: v for k, v in scope.items() if k in TABLE}
        self.scope = scope | {GROUP[tag]: self} if tag in GROUP else scope


def set_aside(tag: str, attributes: str, parent: Node) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if tag == "header":
        while parent:
            if parent.tag in ("article", "main"):
                break
            parent = parent.parent
        else:
            return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True
    return False


def most_aside(tag: str, attributes: str) -> float:
    """The share of the page's unlinked text up to which an element is set aside for its class or id; 1 without such a name."""
    share = 0.5 if tag == "form" else 1.0
    if not attributes or tag in ("body", "html", "main"):
        return share
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for token in (m[2] or "").strip("\"'").split():
                if token.lower() in ASIDE_WORDS:
                    return 0.5
                if tag != "article" and any(w.lower() in ASIDE_WORDS for w in WORDS.findall(token)):
                    share = min(share, 0.2)
    return share


def set_named_aside(root: Node) -> None:
    """Decides on elements by their names, from the unlinked text that they hold."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag != "a":
            stack += [x for x in node.items if isinstance(x, Node) and not x.off]
    plain: dict[int, int] = {}
    for node in reversed(order):
        plain[id(node)] = 0 if node.tag == "a" else sum(len(x.strip()) if isinstance(x, str) else plain.get(id(x), 0) for x in node.items)
    for node in order:
        if node.named < 1:
            bare = node.named == 0.5 and node.tag != "form" and not any(isinstance(x, Node) and x.tag in BLOCK for x in node.items)
            node.off = bare or plain[id(node)] <= node.named * plain[id(root)]


class Reader:
    """Finds what ends tags, comments and raw text; each search that fails once is never tried again, as places only rise."""

    def __init__(self, page: str):
        self.page, self.none, self.quotes = page, set(), True

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.none else self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The > that ends a tag, or -1. Quoted values may hold >, unless a page has a tag that quotes leave without an end."""
        i = at
        while self.quotes:
            m = TAG_END.search(self.page, i)
            if not m:
                self.quotes = False
            elif not m[1]:
                return m.start()
            else:
                close = self.find(m[1], m.end())
                i = close + 1 if close >= 0 else m.end()
        return self.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the text after this element's end tag begins, or -1."""
        if f"</{tag}" in self.none:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
        close = self.find(">", m.end()) if m else -1
        if close < 0:
            self.none.add(f"</{tag}")
        return close + 1 if close >= 0 else -1


def tree(page: str) -> Node:
    root = now = Node("html", None)
    reader, at, end = Reader(page), 0, len(page)
    opened: dict[str, int] = {}

    def closed(node: Node) -> Node:
        """What is open once node has ended."""
        x = now
        while True:
            opened[x.tag] -= 1
            if x is node:
                return node.parent
            x = x.parent

    while at < end:
        less = page.find("<", at)
        if less != at:
            now.items.append(page[at:less] if less >= 0 else page[at:])
        if less < 0:
            break
        if page.startswith(("<!", "<?"), less):
            comment = page.startswith("<!--", less)
            close = reader.find("-->", less + 2) if comment else reader.find(">", less)
            at = close + (3 if comment else 1) if close >= 0 else end
            continue
        ending = page.startswith("</", less)
        m = NAME.match(page, less + 1 + ending)
        if not m:
            now.items.append("<")
            at = less + 1
            continue
        close = reader.tag_end(m.end())
        if close < 0:
            break
        tag, attributes, at = m[0].lower(), page[m.end() : close], close + 1
        if ending:
            if opened.get(tag):
                node = now
                while node.tag != tag:
                    node = node.parent
                now = closed(node)
            elif tag == "p":
                now.items.append(Node("p", now))
            continue
        if tag == "html":
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                now.items.append(Node(tag, now))
            continue
        if tag in RAW:
            after = reader.raw_end(tag, at)
            if after >= 0 or tag in ("script", "style", "textarea", "title"):
                at = after if after >= 0 else end
                continue
        if tag in BLOCK and "p" in now.scope:
            now = closed(now.scope["p"])
        for group in CLOSES.get(tag, ()):
            if group in now.scope:
                now = closed(now.scope[group])
                break
        new = Node(tag, now, now.off or set_aside(tag, attributes, now))
        new.named = most_aside(tag, attributes)
        now.items.append(new)
        if not (attributes.endswith("/") and tag not in BLOCK):
            now = new
            opened[tag] = opened.get(tag, 0) + 1
    set_named_aside(root)
    return root


def measured(root: Node) -> list[Node]:
    """Elements that aren't set aside, each before its descendants, with their counts."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += reversed(child_nodes(node))
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
            elif not x.off:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.links += x.links
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.links, node.link_tags = node.chars, node.link_tags + 1
    whole = root.links / root.chars if root.chars else 0.0
    for node in reversed(order):
        c, t = node.chars, max(1, node.tags)
        if c:
            plain = max(1, c - node.links)
            base = math.log(c / plain * node.links + whole * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, node.links) * t / max(1, node.link_tags))) / base if base else 0.0
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.off)
        if any(isinstance(x, str) and x.strip() for x in node.items):
            node.total = max(node.total, node.density)
    return order


def densest(node: Node) -> Node:
    best, stack = node, [node]
    while stack:
        x = stack.pop()
        if x.total > best.total:
            best = x
        stack += reversed(child_nodes(x))
    return best


def child_nodes(node: Node) -> list[Node]:
    return [x for x in node.items if isinstance(x, Node) and not x.off]


def nearest_headings(path: list[Node]) -> list[Node]:
    """Headings before the content node path[0], siblings of it or of the lowest node around it that has such."""
    for x, above in zip(path, path[1:], strict=False):
        before = child_nodes(above)
        found = [y for y in before[: before.index(x)] if y.tag in HEADINGS and y.chars > y.links * 2]
        if found:
            return found
    return []


def contents(root: Node) -> list[Node]:
    body = next((x for x in child_nodes(root) if x.tag == "body"), root)
    order = measured(body)
    if not body.chars:
        return []
    best = max(order, key=lambda x: x.total)
    path, x = [best], best
    while x is not body:
        x = x.parent
        path.append(x)
    on_path = set(map(id, path))
    article = next((x for x in reversed(path) if x.tag == "article"), None)
    for x in path[1 : path.index(article) + 1] if article else ():
        for y in child_nodes(x):
            if id(y) not in on_path and y.tag in BLOCK and y.links * 2 >= y.chars > 0:
                y.off = True
    chosen = article or best
    titles = [] if article else nearest_headings(path)
    threshold = min(x.density for x in path)
    found, stack = [], [body]
    while stack:
        x = stack.pop()
        if x is chosen or x in titles:
            found.append(x)
        elif id(x) in on_path:
            stack += reversed(child_nodes(x))
        elif x.density >= threshold and x.chars > x.links * 2:
            found.append(x if x.tag in ("article", "p", "pre", "h1", "h2", "h3") else densest(x))
    return found


def blocks(node: Node) -> list[str]:
    found: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join(references.unescape("".join(now)).split()):
            found.append(text)
        now.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.off:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            elif x.tag in ("br", "td", "th"):
                now.append(" ")
            stack += reversed(x.items)
    flush()
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b for node in contents(tree(page)) for b in blocks(node)) if page else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
