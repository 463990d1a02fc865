"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder, which knows void elements, implied end tags and
implied table rows; the renderer leaves out what a browser doesn't show and lays the
rest out as text: paragraphs and other spaced blocks are set off by blank lines, list
items have markers and are indented by depth, cells of a table are aligned in columns,
preformatted text keeps its white space.  What a table holds outside of its cells stands
before it.

Defined results: null or empty html gives an empty text; unclosed, misplaced or unknown
tags never fail; what elements nested deeper than `MAX_DEPTH` hold counts as that of the one
at that depth, but what they hide stays hidden; extra columns are passed on by extract_text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import steps

MAX_DEPTH = 200
_NAME = re.compile(r"</?[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_STYLE = re.compile(r"""\bstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|\baria-hidden\s*=\s*["']?true""", re.I)
_START = re.compile(r"""\bstart\s*=\s*["']?(-?\d+)""", re.I)
_QUOTED = re.compile(r"""=\s*("[^"]*"|'[^']*')""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"))
INVISIBLE = frozenset(("head", "script", "style", "template", "noscript", "iframe", "title", "textarea", "select", "datalist", "object", "svg", "canvas", "audio", "video"))
#: Set off by a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address form fieldset li dt dd tr td th tbody thead tfoot caption figcaption details summary center".split())
#: An opening tag ends these, up to an element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_PARAGRAPH_ENDS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}


class Node:
    __slots__ = ("tag", "attrs", "children", "visible")

    def __init__(self, tag: str, attrs: str = "", visible: bool = True):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: What the visibility property says of its own texts; elements inside may differ.
        self.visible = visible
        if attrs and (style := _STYLE.search(attrs)) and (v := _VISIBILITY.search(style[1])):
            self.visible = v[1].lower() not in ("hidden", "collapse") if v[1].lower() != "inherit" else visible

    def shown(self) -> bool:
        if self.tag in INVISIBLE:
            return False
        if not self.attrs:
            return True
        style = _STYLE.search(self.attrs)
        return not (style and _HIDING.search(style[1])) and not _HIDDEN.search(_QUOTED.sub(lambda m: m[0] if "true" in m[1].lower() else "=", self.attrs))


class _Tags:
    """Tags of a page in order, in linear time whatever it holds.

    A tag goes up to the first > that isn't quoted; where there is none, its < is text.  What is
    found out on the way (the next mark from a place on, where a tag that gets to a quote ends) is kept,
    so that no part of the page is searched again for each < before it.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.next: dict[re.Pattern, tuple[int, int]] = {}  # from, place: the first match from there on
        self.ends: dict[int, int] = {}  # end of a tag that reaches this quote, or -1
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def _find(self, pattern: re.Pattern, at: int) -> int:
        """The first match from `at` on, or -1; asked for places from left to right."""
        a, b = self.next.get(pattern, (1, 0))
        if not a <= at <= b:
            m = pattern.search(self.html, at)
            b = m.start() if m else len(self.html)
            self.next[pattern] = (at, b)
        return b if b < len(self.html) else -1

    def end(self, at: int) -> int:
        """The place of the > of a tag whose attributes start at `at`, or -1."""
        passed, out = [], -1
        while at <= self.last[">"]:
            k = self._find(_SPECIAL, at) if at >= self.next.get(_SPECIAL, (0, 0))[0] else self._search(at)
            if k < 0 or self.html[k] == ">":
                out = k
                break
            if k in self.ends:
                out = self.ends[k]
                break
            passed.append(k)
            if k >= self.last[self.html[k]]:
                break
            at = self.html.find(self.html[k], k + 1) + 1
        self.ends.update(dict.fromkeys(passed, out))
        return out

    def _search(self, at: int) -> int:
        m = _SPECIAL.search(self.html, at)
        return m.start() if m else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes); comments and declarations have no name."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
                yield start, at, "", False, ""
            elif html.startswith(("<!", "<?"), start):
                if start < self.last[">"]:
                    at = html.find(">", start) + 1
                    yield start, at, "", False, ""
            elif start < self.last[">"] and _NAME.match(html, start):
                closing = html[start + 1] == "/"
                name_end = self._find(_NAME_END, start + 1 + closing)
                end = name_end if name_end < 0 or html[name_end] == ">" else self.end(name_end)
                if end >= 0:
                    at = end + 1
                    told = yield start, at, html[start + 1 + closing:name_end].lower(), closing, html[name_end:end]
                    at = at if told is None else told


class _Open:
    """The elements that are open, with the places of each kind, so that looking for one takes no walk."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close all from a place on."""
        deep = len(self.nodes) > MAX_DEPTH and any(n.tag in BLOCK for n in self.nodes[max(at, MAX_DEPTH):])
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]
        if deep and len(self.nodes) >= MAX_DEPTH:
            self.nodes[-1].children.append(Node("br"))

    def last(self, tags) -> int:
        """The place of the innermost of these, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, tags, behind: int) -> int:
        return min((p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, behind)) < len(p)), default=0)


_CELLS = ("table", "td", "th")
_WITHIN_CELL = ("p", "div", "li", "span", "b", "i")


def parse(html: str) -> Node:
    """The tree of a page.

    Elements beyond MAX_DEPTH are open like others, but what they hold goes to the one at that
    depth; that of hidden ones goes nowhere, and blocks begin a new line there.
    """
    root = Node("#root")
    stack, at = _Open(root), 0

    def close(tags, fence) -> None:
        """The outermost of these inside of the fence."""
        if (last := stack.last(tags)) and last > (edge := stack.last(fence)):
            stack.cut(stack.outermost(tags, edge))

    def push(tag: str, attrs: str) -> None:
        top = stack.nodes[-1]
        node = Node(tag, attrs, top.visible)
        if len(stack.nodes) < MAX_DEPTH or tag in VOID:
            top.children.append(node)
        elif node.shown():
            if tag in BLOCK:
                top.children.append(Node("br"))
            node.children = top.children
        if tag not in VOID:
            stack.push(node)

    def text(part: str) -> None:
        if part and stack.nodes[-1].visible:
            stack.nodes[-1].children.append(unescape(part) if "&" in part else part)

    tags = iter(_Tags(html))
    found = next(tags, None)
    while found:
        start, end, tag, closing, attrs = found
        text(html[at:start])
        at, told = end, None
        if closing:
            i = stack.places[tag][-1] if stack.places.get(tag) else 0
            if i and not (tag in _WITHIN_CELL and stack.last(_CELLS) > i):  # doesn't reach out of its cell
                stack.cut(i)
            elif not i and tag in ("p", "br") and not (tag == "p" and stack.last(_CELLS)):
                stack.nodes[-1].children.append(Node(tag))
        elif tag:
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in _PARAGRAPH_ENDS:
                close(("p",), ("td", "th", "table", "li", "button", "body"))
            if stack.nodes[-1].tag == "colgroup" and tag not in ("col", "template"):
                stack.cut(len(stack.nodes) - 1)
            if tag in ("td", "th") and stack.nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", "")
            if tag in RAW:
                over = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                stack.nodes[-1].children.append(Node(tag, attrs))
                at = told = over.end() if over else len(html)
            else:
                push(tag, attrs)
        try:
            found = tags.send(told)
        except StopIteration:
            found = None
    text(html[at:])
    return root


class _Page:
    """Lines of a block; None is a paragraph's edge, and edges next to each other are one."""

    def __init__(self) -> None:
        self.lines: list[str | None] = []
        self.run: list[str] = []

    def flush(self) -> None:
        if self.run:
            for part in "".join(self.run).split("\0"):
                if line := _SPACE.sub(" ", part).strip(" "):
                    self.lines.append(line)
            self.run = []

    def edge(self) -> None:
        self.flush()
        if self.lines and self.lines[-1] is not None:
            self.lines.append(None)

    def done(self) -> list[str | None]:
        self.flush()
        while self.lines and self.lines[-1] is None:
            self.lines.pop()
        return self.lines


def _cells(node: Node, rows: list[list[Node]], around: list[Node]) -> None:
    """Rows of a table or section; what is neither row, section nor cell goes to around.

    Cells inside of other elements of a row are cells of that row, rows inside of other
    elements of a section are rows, and so on with the rest of these elements.
    """
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                _aside(c, around)
        elif not c.shown() or c.tag == "col":
            continue
        elif c.tag == "tr":
            rows.append([])
            _row(c, rows[-1], around)
        elif c.tag in ("td", "th"):
            rows.append([c])
        elif c.tag in ("tbody", "thead", "tfoot", "colgroup") or _holds(c, ("tr", "td", "th")):
            _cells(c, rows, around)
        else:
            _aside(c, around)


def _row(node: Node, row: list[Node], around: list[Node]) -> None:
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                _aside(c, around)
        elif not c.shown():
            continue
        elif c.tag in ("td", "th"):
            row.append(c)
        elif _holds(c, ("td", "th")):
            _row(c, row, around)
        else:
            _aside(c, around)


def _aside(c: Node | str, around: list[Node]) -> None:
    block = Node("div")
    block.children.append(c)
    around.append(block)


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    """Whether an element of these tags is inside, but not in a table or list of its own."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in ("table", "ul", "ol", "pre") or not n.shown():
            continue
        for c in n.children:
            if isinstance(c, Node):
                if c.tag in tags:
                    return True
                todo.append(c)
    return False


def _table(node: Node) -> list[str | None]:
    out: list[str | None] = []
    rows: list[list[Node]] = []
    around: list[Node] = []
    _cells(node, rows, around)
    for c in around:  # what isn't in a cell stands before the table
        out += _render(c, 0)
    grid = [[[x for x in _render(c, 0) if x is not None] for c in r] for r in rows]
    width = [0] * max((len(r) for r in grid), default=0)
    for r in grid:
        for i, cell in enumerate(r):
            width[i] = max([width[i], *map(len, cell)])
    for r in grid:
        for k in range(max((len(c) for c in r), default=0)):
            line = "  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(r, width)).rstrip()
            if line:
                out.append(line)
    return out


def _list(node: Node, depth: int) -> list[str | None]:
    out: list[str | None] = []
    first = _START.search(node.attrs)
    number = int(first[1]) if first else 1
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.append(_SPACE.sub(" ", c).strip(" "))
        elif c.shown():
            lines = _render(c, depth + 1)
            if c.tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                if lines:
                    out.append(mark + (lines[0] or ""))
                    out += [x if x is None else " " * len(mark) + x for x in lines[1:]]
            else:
                out += lines
    return [x for x in out if x is not None]


def _render(node: Node, depth: int) -> list[str | None]:
    if node.tag == "table":
        return _table(node)
    if node.tag in ("ul", "ol"):
        return _list(node, depth)
    page = _Page()
    # an explicit stack of iterators over inline content; blocks recurse, at most MAX_DEPTH deep
    todo = [iter(node.children)]
    while todo:
        for c in todo[-1]:
            if isinstance(c, str):
                page.run.append(c)
            elif not c.shown():
                continue
            elif c.tag == "br":
                page.run.append("\0")
            elif c.tag == "pre":
                page.edge()
                raw = "".join(_plain(c)).strip("\n")
                page.lines += raw.split("\n") if raw.strip() else []
                page.edge()
            elif c.tag in BLOCK:
                page.edge() if c.tag in SPACED else page.flush()
                lines = _render(c, depth)
                if c.tag == "dd" or c.tag == "blockquote":
                    lines = [x if x is None else "  " + x for x in lines]
                page.lines += lines
                page.edge() if c.tag in SPACED else page.flush()
            else:
                todo.append(iter(c.children))
                break
        else:
            todo.pop()
    return page.done()


def _plain(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.tag == "br":
            yield "\n"
        elif c.shown():
            yield from _plain(c)


def render_text(html: str | None) -> str:
    """The visible text of a page."""
    lines = _render(parse(html.replace("\0", "")), 0) if html else []
    return "\n".join("" if x is None else x for x in lines)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the html column replaced by the visible text."""
    others = [c for c in pages.columns if c not in (html, text)]
    schema = pages.select(*others, F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, html):
            at = batch.schema.get_field_index
            out = [render_text(x) for x in batch.column(at(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in others), pa.array(out, pa.string())], [*others, text])

    return pages.select(*others, html).mapInArrow(run, schema)
