"""Visible text of HTML pages, laid out in blocks, lists and aligned tables.

A page is cut into tags, text and comments; a small tree builder supplies the tags that HTML leaves out
(a paragraph ends where a block begins, list items and table cells end each other, table rows imply a
body, the head ends before anything that cannot stand in it) and closes what stays open.  Rendering walks the tree with the display and visibility rules of the
element names and of ``hidden`` and ``style`` attributes: every visible text is emitted once, that of open
dialogs, formulas, drawings and choices too (``aria-hidden`` hides from screen readers only).  Blocks stand apart by one line break, paragraphs and headings by a blank line; list items carry a
bullet or number and an indent; the cells of a table are padded to the width of their column.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by their role in HTML: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas "
    "datalist area meta link title base param source track".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table ul caption tr tbody thead tfoot".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Start tag -> the open elements it ends, and the elements that it does not look past.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Parts of a drawing or a formula that are not shown.
UNSEEN_FOREIGN = frozenset(
    "annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split()
)
#: Elements of HTML that end an open drawing or formula, and the elements inside it that may hold them.
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
    "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: What may stand in a head; anything else, and text, ends it.
IN_HEAD = frozenset("base link meta title style script noscript noframes template head html".split())
#: Elements that an end tag inside does not close.
SCOPE = frozenset("table td th caption button template html".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def get(self, key: str) -> str | None:
        for name, *values in _ATTRIBUTE.findall(self.attributes):
            if name.lower() == key:
                return html.unescape("".join(values))
        return None


def build_tree(page: str) -> Element:
    """The tree of a page; nothing is ever refused."""
    root = Element("#root")
    open_: list[Element] = [root]
    tally: dict[str, int] = {}  # open elements by name, so that most searches need no walk

    def push(element: Element) -> None:
        open_.append(element)
        tally[element.name] = tally.get(element.name, 0) + 1

    def cut(at: int) -> None:
        for element in open_[at:]:
            tally[element.name] -= 1
        del open_[at:]

    def close_to(names, borders) -> None:
        if not any(tally.get(n) for n in names):
            return
        for at in range(len(open_) - 1, 0, -1):
            if open_[at].name in borders:
                return
            if open_[at].name in names:
                cut(at)
                # Nested kinds (a cell in a row) end together.
                close_to(names, borders)
                return

    def end_head() -> None:
        if open_[-1].name == "head":
            cut(len(open_) - 1)

    def end_foreign() -> None:
        """Close the drawings and formulas that the next element cannot stand in."""
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].name in HOLDS_HTML:
                return
            if open_[k].name in ("svg", "math"):
                cut(k)

    def text(value: str) -> None:
        if value.strip(" \t\n\r\f"):
            end_head()
        if value:
            open_[-1].children.append(value)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(html.unescape(page[at:]))
            break
        if lt > at:
            text(html.unescape(page[at:lt]))
        found = _TOKEN.match(page, lt)
        if not found:
            text("<")
            at = lt + 1
            continue
        at = found.end()
        closing, name, rest = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "br":
                end_head()
                open_[-1].children.append(Element("br"))
            elif name == "p" and not tally.get("p"):
                open_[-1].children.append(Element("p"))
            elif tally.get(name):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].name == name:
                        cut(k)
                        break
                    if open_[k].name in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if name not in IN_HEAD:
            end_head()
        if name in ENDS_FOREIGN and (tally.get("svg") or tally.get("math")):
            end_foreign()
        if name == "head" and open_[-1].name not in ("#root", "html"):
            continue
        if name in ENDS_PARAGRAPH:
            close_to({"p"}, SCOPE)
        if name in IMPLIED_END:
            close_to(*IMPLIED_END[name])
        if name in ("td", "th") and open_[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Element("tr")
            open_[-1].children.append(row)
            push(row)
        if name in ("html", "body") and tally.get(name):
            continue
        element = Element(name, rest)
        open_[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(page, at)
            content = page[at : end.start()]
            element.children.append(html.unescape(content) if name in ("textarea", "title") else content)
            at = page.find(">", end.start()) + 1 or size
        elif name not in VOID and not rest.rstrip().endswith("/") or name in BLOCK and name not in VOID:
            push(element)
    return root


def _unseen(element: Element) -> bool:
    if element.name in UNSEEN:
        return True
    if element.name == "dialog" and element.get("open") is None:
        return True
    if not element.attributes:
        return False
    low = element.attributes.lower()
    if "hidden" not in low and "none" not in low and "collapse" not in low:
        return False
    style = element.get("style")
    return element.get("hidden") is not None or bool(style and _HIDING.search(style))


def _foreign(element: Element) -> list:
    """What a drawing or a formula shows, in order; each text of a drawing between line breaks."""
    out: list = []
    work: list = [(c, element.name == "math") for c in reversed(element.children)]
    while work:
        node, shown = work.pop()
        if isinstance(node, str):
            if shown:
                out.append(node)
        elif node.name in ("#line", "foreignobject"):
            out.append(node)
        elif node.name in UNSEEN_FOREIGN or _unseen(node) or node.attributes and (
            node.get("display") == "none" or node.get("visibility") in ("hidden", "collapse")
        ):
            continue
        elif node.name in ("svg", "text") and not shown:
            line = Element("#line")
            work += [(line, True), *[(c, node.name == "text") for c in reversed(node.children)], (line, True)]
        elif node.name in ENDS_FOREIGN or node.name in BLOCK:
            out.append(node)  # HTML inside a token of a formula
        else:
            work.extend((c, shown) for c in reversed(node.children))
    return out


def _wide(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Lines of a rendering: text flows into the open line until a block breaks it."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []
        self.gap = False

    def flow(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.split("\n")
            self._add(first)
            for line in more:
                self.end(keep=True)
                self._add(line)
            return
        text = _BLANKS.sub(" ", text)
        if text.startswith(" ") and (not self.open or self.open[-1].endswith((" ", "\t"))):
            text = text[1:]
        self._add(text)

    def _add(self, text: str) -> None:
        if text:
            self.open.append(text)

    def end(self, keep: bool = False) -> None:
        """Close the open line; ``keep`` writes it even if it is empty."""
        line = "".join(self.open).rstrip()
        self.open = []
        if line or keep:
            if self.gap and self.done and line:
                self.done.append("")
            self.gap = False if line else self.gap
            self.done.append(line)

    def apart(self) -> None:
        self.end()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        self.end()
        if lines:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.extend(lines)


class _Counts:
    def __init__(self):
        self.blocks = self.lists = self.tables = 0


def _list_lines(element: Element, pre: bool, counts: _Counts) -> list[str]:
    ordered = element.name == "ol"
    start = element.get("start") if ordered else None
    number = int(start) if start and re.fullmatch(r"-?\d{1,9}", start.strip()) else 1
    lines: list[str] = []
    for child in element.children:
        if isinstance(child, Element) and _unseen(child):
            continue
        if isinstance(child, Element) and child.name == "li":
            mark = f"{number}. " if ordered else "- "
            number += 1
            inner = _render(child.children, pre, counts) or [""]
            lines.append((mark + inner[0]).rstrip())
            lines += [" " * len(mark) + x if x else "" for x in inner[1:]]
        else:
            lines += _render([child], pre, counts)
    return lines


def _rows(element: Element) -> Iterator[Element | str]:
    """Rows of a table in order; captions and stray content come as they are."""
    for child in element.children:
        if isinstance(child, Element) and child.name in ("tbody", "thead", "tfoot") and not _unseen(child):
            yield from _rows(child)
        else:
            yield child


def _span(cell: Element) -> int:
    value = (cell.get("colspan") or "1").strip()
    return max(1, min(1000, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def _table_lines(element: Element, pre: bool, counts: _Counts) -> list[str]:
    before: list[str] = []
    grid: list[list[tuple[list[str], int]]] = []
    for child in _rows(element):
        if isinstance(child, Element) and child.name == "tr":
            if _unseen(child):
                continue
            row = []
            for cell in child.children:
                if isinstance(cell, Element) and cell.name in ("td", "th"):
                    row.append(([] if _unseen(cell) else _render(cell.children, pre, counts), _span(cell)))
                else:
                    before += _render([cell], pre, counts)
            if row:
                grid.append(row)
        else:
            before += _render([child], pre, counts)
    width: dict[int, int] = {}
    for row in grid:
        at = 0
        for lines, span in row:
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(_wide, lines), default=0))
            at += span
    out = []
    for row in grid:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, span in row:
                text = lines[k] if k < len(lines) else ""
                room = sum(width.get(i, 0) for i in range(at, at + span)) + 2 * (span - 1)
                parts.append(text + " " * max(0, room - _wide(text)))
                at += span
            out.append("  ".join(parts).rstrip())
    return before + [x for x in out if x]


def _render(children: list, pre: bool, counts: _Counts) -> list[str]:
    """Lines of a run of siblings; an explicit stack keeps deep nesting off Python's own."""
    lines = _Lines()
    work: list = [("visit", c, pre) for c in reversed(children)]
    while work:
        kind, node, keep = work.pop()
        if kind == "after":
            if node.name in APART:
                lines.apart()
            else:
                lines.end()
            continue
        if isinstance(node, str):
            lines.flow(node, keep)
            continue
        if _unseen(node):
            continue
        name = node.name
        if name == "br":
            lines.end(keep=True)
        elif name == "#line":
            lines.end()
        elif name in ("svg", "math"):
            work.extend(("visit", c, False) for c in reversed(_foreign(node)))
        elif name == "hr":
            lines.apart()
        elif name == "img":
            alt = node.get("alt")
            if alt:
                lines.flow(alt, False)
        elif name in ("td", "th"):
            lines.flow(" ", False)
            work.extend(("visit", c, keep) for c in reversed(node.children))
        elif name in ("ul", "ol", "menu", "dir", "table"):
            (lines.apart if name in APART else lines.end)()
            if name == "table":
                counts.tables += 1
                lines.block(_table_lines(node, keep, counts))
            else:
                counts.lists += 1
                lines.block(_list_lines(node, keep, counts))
            lines.gap = True
        elif name in BLOCK:
            counts.blocks += 1
            (lines.apart if name in APART else lines.end)()
            work.append(("after", node, keep))
            label = node.get("label") if name in ("option", "optgroup") else None
            if label:
                lines.flow(label, False)
                if name == "option":  # shown instead of its text
                    continue
                lines.end()
            work.extend(("visit", c, keep or name == "pre") for c in reversed(node.children))
        else:
            work.extend(("visit", c, keep) for c in reversed(node.children))
    lines.end()
    while lines.done and not lines.done[-1]:
        lines.done.pop()
    while lines.done and not lines.done[0]:
        lines.done.pop(0)
    return lines.done


#: Nested lists and tables rendered inside each other; deeper ones flow into the text of this depth.
DEEPEST = 60


def _flatten_deep(root: Element) -> None:
    work = [(root, 0)]
    while work:
        node, depth = work.pop()
        for child in node.children:
            if isinstance(child, Element):
                nested = depth + (child.name in ("ul", "ol", "menu", "dir", "table"))
                if nested > DEEPEST and nested != depth:
                    child.name, nested = "div", depth
                work.append((child, nested))


def extract_text(page: str) -> tuple[str, int, int, int]:
    """(text, blocks, lists, tables) of one page."""
    root = build_tree(page.replace("\r\n", "\n").replace("\0", ""))
    _flatten_deep(root)
    counts = _Counts()
    return "\n".join(_render(root.children, False, counts)), counts.blocks, counts.lists, counts.tables


def render_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, plus ``page_text``, ``n_blocks``, ``n_lists``, ``n_tables``.

    Null and empty pages give the empty text.  Pages of any length are read whole; broken markup is
    rendered as far as its text goes.  Columns named like the new ones are replaced; rows are kept.
    """
    made = ["page_text", "n_blocks", "n_lists", "n_tables"]
    carried = [c for c in pages.columns if c != html and c not in made]
    rows = pages.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(html).cast("string"), F.lit("")).alias("page_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [extract_text(p) for p in batch.column(len(carried)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(carried)], pa.array([f[0] for f in found], pa.string()),
                        *[pa.array([f[k] for f in found], pa.int32()) for k in (1, 2, 3)],
                    ],
                    names=[*carried, *made],
                )

    kept = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = "".join(f"`{c}` {kept[c]}, " for c in carried)
    return rows.mapInArrow(run, schema + "page_text string, n_blocks int, n_lists int, n_tables int")
