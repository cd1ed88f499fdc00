"""Operator 1, HTML to text by layout.

A tolerant tokenizer feeds a tree builder with implied tags (a new block ends an open paragraph, a list item the one
before it, cells and rows likewise; stray end tags are ignored). Rendering walks the tree: invisible parts are left
out, white space collapses except in preformatted text, blocks stand on own lines and with blank lines where browsers
give them margins, list items get markers and indents, and table cells are padded to the width of their columns.

Visibility: elements without display (script, style, head, template and the like), ``hidden``, inline styles with
``display:none`` or ``visibility:hidden`` (undone below by ``visibility:visible``), closed details and dialogs. A closed
``select`` shows its chosen option; text of drawings and formulas and what stands in for an ``object`` is text.

Edge cases: null html gives null text; empty html or html without visible text gives an empty text; repeated rows stay;
an empty table gives no rows; other columns are dropped. Trees deeper than DEPTH hang further elements at that depth,
as browsers do, so no nesting exhausts the stack; text is never lost.
"""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

DEPTH = 400
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # quotes are nothing special
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("head script style template title noscript iframe audio video canvas datalist noembed noframes desc metadata defs symbol clippath mask marker annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
#: A start tag ends an open element of these, unless one of the fences stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")), "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")),
    "tr": (("tr", "caption"), ("table",)), "td": (("td", "th", "caption"), ("tr", "table")), "th": (("td", "th", "caption"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack = [root]

    def close(tags: tuple[str, ...], fences: tuple[str, ...]) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return True
            if stack[i].tag in fences:
                return False
        return False

    at, end, find, over = 0, len(source), _TAG, False
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack[-1].children.append(entities.unescape(source[at:lt]))
        if lt >= end:
            break
        if source.startswith("<!--", lt):
            stop = source.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            stop = source.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = None if over else find.match(source, lt)
        if not m and not over and source[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
            # a tag that does not end: from here on quotes do not count, and if no tag ends at all, all is text; so no
            # part of a page is read again for each of its tags
            find, over = _PLAIN_TAG, source.find(">", lt) < 0
            m = None if over else find.match(source, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in VOID and tag not in ("html", "body"):
                close((tag,), () if tag == "table" else ("table",) if tag in ("tr", "tbody", "thead", "tfoot") else ("td", "th", "table") if tag not in ("td", "th") else ("table",))
            continue
        attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])}
        if tag in ("html", "body"):
            root.attrs = attrs | root.attrs
            if stack[-1].tag == "head":
                stack.pop()
            continue
        if stack[-1].tag == "head" and tag in BLOCK:
            stack.pop()
        if tag in ENDS_P:
            close(("p",), ("td", "th", "table", "button"))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.children.append(source[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")) and len(stack) < DEPTH:
            stack.append(node)
    return root


def width(text: str) -> int:
    """Columns that a text takes."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Output under construction: lines, the parts of the open line and the margin wanted before the next one."""

    def __init__(self):
        self.done, self.open, self.margin, self.space = [], [], 0, False

    def text(self, s: str) -> None:
        if s[:1].isspace():
            self.space = True
        words = s.split()
        if words:
            if self.open and self.space:
                self.open.append(" ")
            self.open.append(" ".join(words))
            self.space = s[-1:].isspace()

    def flush(self) -> None:
        if self.open:
            self.line("".join(self.open))
        self.open, self.space = [], False

    def line(self, s: str) -> None:
        if self.done:
            self.done += [""] * self.margin
        self.margin = 0
        self.done.append(s)

    def block(self, margin: int) -> None:
        self.flush()
        self.margin = max(self.margin, margin)


def _style(node: Node) -> str:
    return node.attrs.get("style", "").lower().replace(" ", "")


def _skipped(node: Node) -> bool:
    if node.tag in GONE or "hidden" in node.attrs or "display:none" in _style(node):
        return True
    return node.tag == "dialog" and "open" not in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() not in ("submit", "button", "reset")


def _shown(node: Node, seen: bool) -> bool:
    """Whether a node's own text is visible, in a parent whose text is (or is not)."""
    style = _style(node)
    if "visibility:hidden" in style or "visibility:collapse" in style:
        return False
    return seen or "visibility:visible" in style


def _chosen(select: Node) -> list[Node]:
    """The options that a closed list shows: the last selected one, or the first; all of an open list."""
    options = [o for c in select.children if isinstance(c, Node) for o in ([c] if c.tag == "option" else c.children if c.tag == "optgroup" and not _skipped(c) else []) if isinstance(o, Node) and o.tag == "option" and not _skipped(o)]
    if "multiple" in select.attrs or select.attrs.get("size", "1") not in ("", "0", "1"):
        return options
    return [o for o in options if "selected" in o.attrs][-1:] or options[:1]


def _walk(node: Node, out: Lines, seen: bool) -> None:
    shut = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if seen and not shut:
                out.text(child)
            continue
        tag = child.tag
        if _skipped(child) or shut and tag != "summary":
            continue
        shown = _shown(child, seen)
        if tag == "br":
            if seen:
                out.line("".join(out.open))
                out.open, out.space = [], False
        elif tag == "input":
            if shown:
                out.text(child.attrs.get("value", ""))
        elif tag == "hr":
            out.block(1)
            if shown:
                out.line("---")
            out.block(1)
        elif tag in ("pre", "xmp", "textarea", "listing"):
            out.block(1)
            text = _plain(child, shown).strip("\n")
            if shown or text.strip():
                for s in text.split("\n"):
                    out.line(s.rstrip())
            out.block(1)
        elif tag == "select":
            box = Node("span", {})
            box.children = _chosen(child)
            _walk(box, out, shown)
        elif tag == "text":  # of a drawing
            out.block(0)
            _walk(child, out, shown)
            out.block(0)
        elif tag in ("ul", "ol", "menu", "dir"):
            _list(child, out, shown)
        elif tag == "table":
            out.block(1)
            for s in _table(child, shown):
                out.line(s)
            out.block(1)
        elif tag in BLOCK:
            out.block(1 if tag in SPACED else 0)
            if tag in ("blockquote", "dd"):
                for s in _inner(child, shown):
                    out.line(f"  {s}" if s else "")
            else:
                _walk(child, out, shown)
            out.block(1 if tag in SPACED else 0)
        else:
            _walk(child, out, shown)


def _plain(node: Node, seen: bool) -> str:
    """Text of preformatted content; line ends count whether they are visible or not."""
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(c if seen else re.sub(r"[^\n]+", "", c))
        elif c.tag == "br":
            parts.append("\n")
        elif not _skipped(c):
            parts.append(_plain(c, _shown(c, seen)))
    return "".join(parts)


def _inner(node: Node, seen: bool) -> list[str]:
    out = Lines()
    _walk(node, out, seen)
    out.flush()
    return out.done


def _list(node: Node, out: Lines, seen: bool) -> None:
    nested = node.attrs.get("\x00nested")
    out.block(0 if nested else 1)
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    loose = Node("div", {})

    def stray() -> None:  # what stands between items is one flow
        for s in _inner(loose, seen):
            out.line(f"  {s}" if s else "")
        loose.children = []

    for child in [*node.children, None]:
        if child is not None and (isinstance(child, str) or child.tag != "li"):
            loose.children.append(child)
            continue
        if loose.children:
            stray()
        if child is None or _skipped(child):
            continue
        if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
            number = int(child.attrs["value"])
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        for c in child.children:
            if isinstance(c, Node) and c.tag in ("ul", "ol", "menu", "dir"):
                c.attrs["\x00nested"] = "1"
        for i, s in enumerate(_inner(child, _shown(child, seen))):
            out.line((mark if i == 0 else " " * len(mark)) + s if s else "")
    out.block(0 if nested else 1)


def _rows(node: Node, seen: bool) -> Iterable[tuple[Node, bool]]:
    """The rows of a table, each with whether its text is visible unless a cell says otherwise."""
    for child in node.children:
        if isinstance(child, Node) and not _skipped(child):
            if child.tag == "tr":
                yield child, _shown(child, seen)
            elif child.tag in ("tbody", "thead", "tfoot"):
                yield from _rows(child, _shown(child, seen))


def _span(node: Node, name: str) -> int:
    got = node.attrs.get(name, "1")
    return max(1, min(1000, int(got))) if re.fullmatch(r"\d{1,5}", got) else 1


def _table(node: Node, seen: bool) -> list[str]:
    """Rows with aligned columns; what stands in the table outside its rows comes first."""
    out: list[str] = []
    stray = Node("div", {})
    stray.children = [c for c in node.children if isinstance(c, str) or c.tag not in ("tr", "tbody", "thead", "tfoot", "colgroup", "col")]
    for part in node.children:
        if isinstance(part, Node) and part.tag in ("tbody", "thead", "tfoot") and not _skipped(part):
            between = Node("span", {k: v for k, v in part.attrs.items() if k == "style"})
            between.children = [c for c in part.children if isinstance(c, str) or c.tag not in ("tr",)]
            stray.children.append(between)
    out += _inner(stray, seen)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}
    for row, row_seen in _rows(node, seen):
        col, cells = 0, []
        loose = [c for c in row.children if (isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.tag not in ("td", "th"))]
        if loose:
            stray.children = loose
            out += _inner(stray, row_seen)
        held = dict(taken)
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th") or _skipped(cell):
                continue
            while held.get(col, 0) > 0:
                col += 1
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            cells.append((col, wide, [s for s in _inner(cell, _shown(cell, row_seen)) if s]))
            for k in range(col, col + wide):
                taken[k] = max(taken.get(k, 0), high)
            col += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for wide_too in (False, True):
        for cells in grid:
            for col, wide, text in cells:
                need = max(map(width, text), default=0)
                if wide == 1:
                    widths[col] = max(widths.get(col, 0), need)
                elif wide_too:
                    have = sum(widths.get(k, 0) for k in range(col, col + wide)) + 2 * (wide - 1)
                    widths[col + wide - 1] = widths.get(col + wide - 1, 0) + max(0, need - have)
    for cells in grid:
        for i in range(max((len(t) for _, _, t in cells), default=0)):
            line, at = "", 0
            for col, _, text in cells:
                line += "".join(" " * (widths.get(k, 0) + 2) for k in range(at, col)) if at < col else ""
                begin = sum(widths.get(k, 0) + 2 for k in range(col))
                line += " " * max(0, begin - width(line))
                line += text[i] if i < len(text) else ""
                at = col + 1
                line += " " * max(0, begin + widths.get(col, 0) - width(line)) if at <= max(widths) else ""
            if line.strip():
                out.append(line.rstrip())
    return out


def extract(source: str | None) -> str | None:
    """The visible text of a page."""
    if source is None:
        return None
    if sys.getrecursionlimit() < 20 * DEPTH:
        sys.setrecursionlimit(20 * DEPTH)
    root = parse(source)
    if _skipped(root):
        return ""
    return "\n".join(_inner(root, _shown(root, True))).strip("\n")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text) of (page_id, html): one narrow pass, one page in memory besides its batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([extract(x) for x in b.column("html").to_pylist()], pa.string())], ["page_id", "text"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), run, "page_id long, text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
