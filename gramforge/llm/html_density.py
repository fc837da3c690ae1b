"""Main-content extraction from HTML by composite text density.

For every DOM node: C characters, T tags, LC characters and LT tags inside
links; its composite density is characters per tag, discounted by how much of
it is link text relative to the body's own share:

    C/T * log_{ ln( C/(C-LC) * LC + LCb/Cb * C + e ) } ( C/LC * T/LT )

with zero counts taken as one. A node's density sum adds up its children's
densities. The threshold is the least density on the path from the body to the
node of greatest density sum; from the body down, wherever a node reaches the
threshold, the node of greatest density sum in its subtree is content, and the
content is given in document order.

Pages are parsed by one regular expression, whose repetitions never go back, and
an explicit stack with the depths of the open elements of each name, so that time
is linear in a page whatever its tags are and depth is no limit. Unclosed and
stray tags are repaired the way browsers repair the common cases (p, li, option,
table parts, void elements); a tag, comment or script that never ends reaches to
the end of the page, a quote that never ends is a character like any other.

Defined results
---------------
* null html: null content.   empty html, or no text at all: empty content.
* no body element: the whole page is the body.
* very long, deep or broken pages: processed whole, in linear time.
* ties in density sum: the node that begins first.   page ids of any type.
* repeated rows: each by itself.   extra columns: ignored.   empty table: empty.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, slices

_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+(?:>|\Z)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*+(?:>|\Z).*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+){_INSIDE}|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split()
)
#: An opening tag closes these if they are open and nearer than the barrier.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
}
_P = (frozenset(["p"]), frozenset(["article", "body", "div", "section", "td", "table", "button"]))
_SPACE = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")


class Node:
    __slots__ = ("tag", "parent", "children", "pieces", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.pieces: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def parse(page: str) -> tuple[Node, list[Node]]:
    """(root, all nodes in document order)."""
    root = Node("#root", None)
    nodes = [root]
    path = [root]
    # Depths at which elements of each name are open, rising.
    depths: dict[str, list[int]] = defaultdict(list)

    def text(piece: str) -> None:
        path[-1].pieces.append(html_lib.unescape(piece) if "&" in piece else piece)

    def close(depth: int) -> None:
        for node in path[depth:]:
            depths[node.tag].pop()
        del path[depth:]

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            text(page[end : m.start()])
        end = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2):
            if depths[tag]:
                close(depths[tag][-1])
            continue
        closing = _CLOSES.get(tag) or (_P if tag in _BLOCK and tag != "br" else None)
        if closing:
            gone, barrier = closing
            if any(depths[t] for t in gone):
                least = max((depths[t][-1] for t in barrier if depths[t]), default=0)
                found = [depths[t][k] for t in gone if (k := bisect_right(depths[t], least)) < len(depths[t])]
                if found:
                    close(min(found))
        at = path[-1]
        node = Node(tag, at)
        at.children.append(node)
        at.pieces.append(node)
        nodes.append(node)
        if tag not in _VOID and not m.group(0).endswith("/>"):
            depths[tag].append(len(path))
            path.append(node)
    if end < len(page):
        text(page[end:])
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        own = sum(len(p.strip()) for p in node.pieces if p.__class__ is str)
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        parent = node.parent
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    t, plain = max(t, 1), max(c - lc, 1)
    base = math.log(c / plain * lc + share * c + math.e)
    power = c / max(lc, 1) * (t / max(lt, 1))
    # ln(e) = 1 is no base of a logarithm: take the limit just above it.
    return c / t * (math.log(max(power, 1.0)) / max(math.log(base), 1e-3))


def extract_content(page: str | None) -> str | None:
    """Content text of one page."""
    if page is None:
        return None
    root, nodes = parse(page)
    body = next((n for n in nodes if n.tag == "body"), root)
    _measure(nodes)
    if not body.chars:
        return ""
    share = body.link_chars / body.chars
    begin = nodes.index(body)
    inside = {id(body)}
    members = [body]
    for n in nodes[begin + 1 :]:
        if id(n.parent) in inside:
            inside.add(id(n))
            members.append(n)
    for n in members:
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    best: dict[int, Node] = {}
    for n in reversed(members):
        n.total = sum(c.density for c in n.children) if n.children else n.density
    order = {id(n): i for i, n in enumerate(members)}
    for n in reversed(members):
        top = n
        for c in n.children:
            other = best[id(c)]
            if (other.total, -order[id(other)]) > (top.total, -order[id(top)]):
                top = other
        best[id(n)] = top
    threshold, n = math.inf, best[id(body)]
    while True:
        threshold = min(threshold, n.density)
        if n is body:
            break
        n = n.parent
    content: set[int] = set()
    stack = [body]
    while stack:
        n = stack.pop()
        if n.density >= threshold and n.chars:
            content.add(id(best[id(n)]))
            stack.extend(n.children)
    return _render(body, content)


def _render(body: Node, content: set[int]) -> str:
    out: list[str] = []
    stack: list[tuple] = [(body, id(body) in content)]
    while stack:
        item, on = stack.pop()
        if item.__class__ is str:
            if on:
                out.append(item)
            continue
        on = on or id(item) in content
        if on and item.tag in _BLOCK:
            out.append("\n")
            stack.append(("\n", True))
        stack.extend((p, on) for p in reversed(item.pieces))
    return _LINES.sub("\n", _SPACE.sub(" ", "".join(out))).strip()


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, content) of every input row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                content = [extract_content(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, type=pa.string())], names=["_gf_id", "content"])

    kind = dict(pages.dtypes)[id_col]
    return (
        pages.select(named(pages, id_col).alias("_gf_id"), named(pages, html_col).alias("_gf_html"))
        .mapInArrow(work, f"_gf_id {kind}, content string")
        .withColumnRenamed("_gf_id", id_col)
    )
