"""HTML extraction as a page would show it: all visible text, laid out in lines.

A tokenizer and a tree builder with implied end tags feed a renderer that keeps
block spacing, list markers and aligned table cells.  It runs on an explicit
stack that knows where each tag is open, so its time is in proportion to the
page whatever is nested or left open, and as one Arrow function without a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fresh, slices

#: Comments, declarations and the beginnings of tags; a "<" that starts none of them is text.
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)", re.S)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas param source track area map".split())
#: What SVG and MathML don't show of their own.
HIDDEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
#: Blocks begin on a line of their own; spaced ones also keep a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt footer form header hgroup html legend li main nav option optgroup section summary search tr td th thead tbody tfoot caption figcaption".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup legend td th tr thead tbody tfoot caption".split())
#: An open element of the set ends when the key's start tag comes, unless one of the barriers lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
}
#: Start tags that a head may hold; any other, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Tags that are ignored outside tables, with their text kept.
CELLS = frozenset("td th tr thead tbody tfoot caption colgroup col".split())
_P, _LISTS = frozenset(["p"]), frozenset("ul ol menu dir".split())
#: End tags don't reach beyond these, unless they name one.
BARRIER = frozenset("table td th caption html template".split())
#: A column is padded to its widest cell; where that has more characters than this, rows whose cell is wider are pushed out.  Gap between columns.
PAD, GAP = 200, "  "
#: Levels of indentation that are shown, and of tables in tables that are laid out; deeper ones give lines like other blocks.
LEVELS, TABLES = 64, 64


@dataclass
class Flow:
    """Lines of text under way: of the page or of a table cell."""

    lines: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    blank: bool = False  # a blank line is due before the next text
    space: bool = False  # a space is due before the next word of this line
    prefix: str = ""  # list marker of the line to come

    def end(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False

    def gap(self) -> None:
        self.end()
        self.blank = bool(self.lines)

    def start(self, indent: int) -> None:
        if not self.parts:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            if indent or self.prefix:
                self.parts.append("  " * min(indent, LEVELS) + self.prefix)
            self.prefix = ""

    def text(self, data: str, indent: int, pre: bool) -> None:
        if pre:
            for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
                if i:
                    if not self.parts:
                        self.lines.append("")
                    self.end()
                if line:
                    self.start(indent)
                    self.parts.append(line)
            return
        data = _SPACE.sub(" ", data)
        if data == " " or not data:
            self.space = self.space or bool(data and self.parts)
            return
        if self.parts and (self.space or data[0] == " "):
            self.parts.append(" ")
        self.start(indent)
        self.parts.append(data.strip(" "))
        self.space = data[-1] == " "

    def finish(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass
class Element:
    tag: str
    shown: bool  # display: false hides all that is in it
    visible: bool  # visibility: may be switched on again further in
    pre: bool
    indent: int
    flow: Flow
    count: int = 0  # next number of an ordered list
    ordered: bool = False
    rows: list | None = None  # of a table: rows of (lines, colspan, rowspan)
    folded: bool = False  # closed details: only the summary shows
    foreign: bool = False  # in SVG or MathML


def attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def declarations(style: str) -> dict[str, str]:
    """The declarations of a style attribute, in lower case; the last of a name counts."""
    out: dict[str, str] = {}
    for part in style.lower().split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out[name.strip()] = value.partition("!")[0].strip()
    return out


class Tags:
    """The tags of a page in order: (name, whether it ends, attributes' source, where it starts, where it ends)."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.at = 0
        self.ends: dict[str, list[int]] | None = None
        self.known: dict[int, int] = {}

    def close(self, at: int) -> int:
        """Position of the ">" that ends a tag whose name ends at *at*, or -1: quoted strings may hold others.

        The first tag without an end makes the lists of marks by which all
        further ones are found, so that no part is searched again for each tag.
        """
        if self.ends is None:
            m = _REST.match(self.page, at)
            if m is not None:
                return m.end() - 1
            self.ends = {c: [m.start() for m in re.finditer(c, self.page)] for c in "[>\"']|>|\"|'".split("|")}
        marks, passed = self.ends["[>\"']"], []
        found = -1
        while (k := bisect_left(marks, at)) < len(marks):
            mark = marks[k]
            if mark in self.known:
                found = self.known[mark]
                break
            passed.append(mark)
            if self.page[mark] == ">":
                found = mark
                break
            same = self.ends[self.page[mark]]
            if (n := bisect_right(same, mark)) == len(same):
                break
            at = same[n] + 1
        for mark in passed:
            self.known[mark] = found
        return found

    def __iter__(self) -> Iterator[tuple[str, bool, str, int, int]]:
        search = self.at
        while (m := _MARKUP.search(self.page, search)) is not None:
            if not m[2]:
                yield "", False, "", m.start(), m.end()
                search = self.at = m.end()
            elif (end := self.close(m.end())) < 0:
                search = m.start() + 1
            else:
                self.at = end + 1  # the reader may move it on
                yield m[2].lower(), bool(m[1]), self.page[m.end() : end], m.start(), end + 1
                search = self.at


def _number(text: str | None, default: int, low: int, high: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(high, max(low, int(m[1]))) if m else default


def table_lines(rows: list[list[tuple[list[str], int, int]]], pad: int = PAD) -> list[str]:
    """Rows of cells as lines: columns start at the same place, a cell's further lines stand below its first."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    width: dict[int, int] = {}
    for row in rows:
        placed: dict[int, list[str]] = {}
        column = 0
        covered = {c: n for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in covered.items()}
        for lines, across, down in row:
            while column in covered:
                column += 1
            placed[column] = lines
            if across == 1:
                width[column] = max(width.get(column, 0), min(pad, max(map(len, lines), default=0)))
            for c in range(column, column + across):
                if down > 1:
                    taken[c] = down - 1
            column += across
        grid.append(placed)
    ends = sorted(width)
    start, at = {}, 0
    for c in range(max([*ends, *(c for r in grid for c in r)], default=-1) + 1):
        start[c] = at
        if width.get(c):
            at += width[c] + len(GAP)
    out = []
    for placed in grid:
        for k in range(max((len(x) for x in placed.values()), default=0)):
            line = ""
            for c in sorted(placed):
                cell = placed[c][k] if k < len(placed[c]) else ""
                if cell:
                    line = (line.ljust(start[c]) if len(line) + len(GAP) <= start[c] or not line else line + GAP) + cell
            out.append(line.rstrip(" "))
    return out


def render(page: str, pad: int = PAD) -> str:
    """The visible text of an HTML page; "" for a page without any.

    Hidden are elements that never show (head, scripts, templates, media),
    those with the attribute ``hidden``, ``display:none``, or hidden inputs,
    closed dialogs and what closed details hold besides their summary; text
    under ``visibility:hidden`` unless an inner element is visible again.
    White space collapses outside ``pre`` and ``textarea``.  Unclosed elements
    end with the page, unmatched end tags are skipped.  Pages of any length
    and depth are rendered in whole; only indentation and the layout of tables
    within tables end at a depth, and columns are padded to *pad* characters.
    """
    root = Element("html", True, True, False, 0, Flow())
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is open in the stack, but for the root
    tables: list[Element] = []  # open tables that are laid out

    def last(tags: frozenset[str]) -> int:
        """Stack position of the innermost element of *tags*, or 0."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(at: int) -> None:
        """End the elements from stack position *at* on."""
        while len(stack) > at:
            e = stack.pop()
            places[e.tag].pop()
            up = stack[-1]
            if e.tag in ("td", "th") and e.flow is not up.flow:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((e.flow.finish(), e.count, e.ordered))
            elif e.rows is not None:
                tables.pop()
                e.flow.gap()
                for line in table_lines(e.rows, pad):
                    e.flow.start(e.indent)
                    if line:
                        e.flow.parts.append(line)
                        e.flow.end()
                    elif e.flow.lines and e.flow.lines[-1]:
                        e.flow.lines.append("")
                e.flow.gap()
            elif e.shown and e.foreign and e.tag == "text":
                e.flow.end()
            elif e.shown and e.tag in BLOCK:
                if e.tag == "li":
                    e.flow.prefix = ""
                e.flow.gap() if e.tag in SPACED and not (e.tag in ("ul", "ol") and up.tag == "li") else e.flow.end()

    def position(tags: frozenset[str], barrier: frozenset[str]) -> int:
        """Stack position of the outermost element of *tags* above the barrier, or 0."""
        wall = last(barrier)
        return min((p[k] for t in tags if (p := places[t]) and (k := bisect_right(p, wall)) < len(p)), default=0)

    def text(data: str) -> None:
        while stack[-1].tag == "head" and data.strip():
            close(len(stack) - 1)
        top = stack[-1]
        if data and top.shown and top.visible and not top.folded:
            if top.rows is not None or top.tag in ("tr", "thead", "tbody", "tfoot"):
                if not data.strip():
                    return
            top.flow.text(html.unescape(data) if "&" in data else data, top.indent, top.pre)

    def open_(tag: str, attrs: dict[str, str]) -> None:
        while stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in CELLS and not places["table"]:
            return
        if tag in CLOSES_P and (at := position(_P, BARRIER)):
            close(at)
        if tag in IMPLIED and (at := position(*IMPLIED[tag])):
            close(at)
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
            close(len(stack) - 1)
        up = stack[-1]
        style = declarations(attrs["style"]) if "style" in attrs else {}
        shown = up.shown and not (up.folded and tag != "summary") and tag not in HIDDEN and "hidden" not in attrs and style.get("display") != "none" and style.get("content-visibility") != "hidden" and not (tag == "dialog" and "open" not in attrs) and not (tag == "input" and attrs.get("type", "").lower() == "hidden")
        foreign = (up.foreign or tag in ("svg", "math")) and tag != "foreignobject"
        shown = shown and not (foreign and tag in HIDDEN_FOREIGN)
        visible = {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""), up.visible)
        e = Element(tag, shown, visible, up.pre or tag in ("pre", "textarea"), up.indent, up.flow)
        e.folded = tag == "details" and "open" not in attrs
        e.foreign = foreign
        if shown:
            if tag == "text" and foreign:
                e.flow.end()
            elif tag in ("td", "th", "tr") and stack[places["table"][-1]].rows is not None:
                if tag == "tr":
                    tables[-1].rows.append([])
                else:
                    e.flow, e.indent = Flow(), 0
                    e.count, e.ordered = _number(attrs.get("colspan"), 1, 1, 1000), _number(attrs.get("rowspan"), 1, 1, 65534)
            elif tag == "table" and len(tables) < TABLES:
                e.rows = []
                e.flow.gap()
            elif tag == "br":
                if not e.flow.parts and e.flow.lines and not e.flow.blank:
                    e.flow.blank = True
                e.flow.end()
            elif tag in BLOCK:
                nested = tag in ("ul", "ol") and bool(places["li"])
                e.flow.gap() if tag in SPACED and not nested else e.flow.end()
                if tag in _LISTS:
                    e.ordered, e.count = tag == "ol", _number(attrs.get("start"), 1, -(10**9), 10**9)
                    if nested:
                        e.indent += 1
                elif tag == "li":
                    of = stack[last(_LISTS)]
                    if of.ordered:
                        of.count = _number(attrs.get("value"), of.count, -(10**9), 10**9)
                        e.flow.prefix = f"{of.count}. "
                        of.count += 1
                    else:
                        e.flow.prefix = "- "
                elif tag in ("blockquote", "dd"):
                    e.indent += 1
        if tag not in VOID:
            places[tag].append(len(stack))
            stack.append(e)
            if e.rows is not None:
                tables.append(e)

    at = 0
    tags = Tags(page)
    for tag, ends, source, start, end in tags:
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if ends:
            if tag == "br":
                open_("br", {})
            elif tag == "p" and not position(_P, BARRIER):
                open_("p", {})
                close(len(stack) - 1)
            elif places[tag] and (tag in BARRIER or places[tag][-1] > last(BARRIER)):
                close(places[tag][-1])
            continue
        open_(tag, attributes(source) if source and not source.isspace() else {})
        if source.endswith("/") and stack[-1].foreign and stack[-1].tag == tag:
            close(len(stack) - 1)
            continue
        if tag in RAW and stack[-1].tag == tag:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            text(page[at : m.start() if m else len(page)])
            close(len(stack) - 1)
            tags.at = at = page.find(">", m.end()) + 1 or len(page) if m else len(page)
    text(page[at:])
    close(1)
    return "\n".join(root.flow.finish())


def extract(page: Column) -> Column:
    """The visible text (see :func:`render`) of a column of HTML; null stays null."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else render(x) for part in slices(pages) for x in part.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(page)


def visible_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """*pages* with ``text``; a column of that name keeps its own and the new one gets underscores appended."""
    return by_bytes(pages).withColumn(fresh(pages, "text"), extract(F.col(page)))
