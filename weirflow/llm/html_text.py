"""HTML extraction: a tree with implied tags, visibility rules, and a text layout of what is visible.

What a page shows without scripts, plug-ins and media is visible: text of math (not its annotations) and textarea, and
what object holds for want of its data. Choices of select, text in svg, and what audio, video, canvas, iframe and noscript
hold for others are not text of the page; nor is what HIDDEN, an input that is no button, hidden, display:none, visibility or a closed details or dialog hides.
Styles count where they stand in an element's own attribute; rules of style sheets aren't applied.
Elements may nest to any depth.

Each page is one row, so pages are laid out in the tasks that read them; the helper for one page is below.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video canvas svg select annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul xmp caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset xmp".split())
#: A start tag of the key ends an open element of the values; the search for it stops at a scope.
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    **{t: (frozenset("tr td th caption colgroup thead tbody tfoot".split()), frozenset({"table"})) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
_P_SCOPE = frozenset("table td th caption button object html body".split())
#: Parts of a table, and elements that hold nothing but such parts: other content of these stands before the table.
PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
HOLDERS = frozenset("table colgroup thead tbody tfoot tr".split())
STAYS = PARTS | frozenset("script style template form".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)?)*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Lines are indented by this much at most, however deep their list: at 40 levels and more, the text of a list stands at one indent. Else a page
#: of n nested lists would have indents in proportion to n squared.
INDENT = 80
#: A column of a table, unless it is the last, is COLUMN wide at most: longer lines are wrapped within it at blanks, and a longer word has a line to
#: itself. Columns that would begin beyond ALIGNED follow the cell before them. Else a row of n cells, or one long cell, would cost all rows blanks.
COLUMN, ALIGNED, BETWEEN = 40, 1000, 2
BUTTONS = frozenset("submit button reset".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """The tree. Missing end tags, bodies and rows of tables are implied, stray end tags ignored.

    Text and elements that stand in a table outside of its cells and caption go before the table, as browsers put them.
    A tag in which the page ends is dropped, as browsers do; no part of a page is read again for it.
    """
    root = Node("#root", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # tag -> where in the stack it is open
    at = 0

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def end(place: int) -> None:
        for node in stack[place:]:
            places[node.tag].pop()
        del stack[place:]

    def end_until(tags: frozenset[str], scope: frozenset[str]) -> None:
        while (place := last(*tags)) and place > last(*scope):
            end(place)
            if not tags & {"tr", "td", "th"}:  # a new row ends the cell and the row
                break

    def add(child: Node | str) -> None:
        beside = child.strip() if isinstance(child, str) else child.tag not in STAYS
        if beside and stack[-1].tag in HOLDERS and (place := last("table")) > last("template"):
            siblings = stack[place - 1].children  # an open table is the last of them
            siblings.insert(len(siblings) - 1, child)
        else:
            stack[-1].children.append(child)

    def text(value: str) -> None:
        if value:
            add(html.unescape(value))

    def part(tag: str, place: int) -> None:
        """Back to where a part of the table at that place of the stack goes."""
        for wanted, implied in [(("thead", "tbody", "tfoot"), "tbody"), (("tr",), "tr")][: {"tr": 1, "td": 2, "th": 2}.get(tag, 0)]:
            place += 1
            if place == len(stack) or stack[place].tag not in wanted:
                end(place)
                stack[-1].children.append(Node(implied, {}))
                push(stack[-1].children[-1])
        end(place + 1)

    for m in iter(lambda: _TAG.search(source, at), None):
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("template", "body", "html"):
                bar = 0
            elif tag in PARTS:
                bar = last("table", "template")
            else:
                bar = last("template") if tag == "table" else last("td", "th", "table", "button", "template")
            if (place := last(tag)) and place >= bar:
                end(place)
            continue
        if tag in BLOCK and tag not in ("html", "body") and places.get("p"):
            end_until(frozenset({"p"}), _P_SCOPE)
        if tag in PARTS and (place := last("table")) > last("template"):
            part(tag, place)
        elif tag in ENDS:
            end_until(*ENDS[tag])
        elif tag == "table" and (place := last("table")) > last("td", "th", "caption", "template"):
            end(place)
        if tag == "body" or stack[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            end_until(frozenset({"head"}), frozenset())
        node = Node(tag, {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])})
        lone = tag in VOID or tag == "form" and stack[-1].tag in HOLDERS
        add(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(source, at)
            node.children.append(source[at : stop.start()] if tag not in ("title", "textarea") else html.unescape(source[at : stop.start()]))
            at = stop.end()
        elif not lone:
            push(node)
    text(source[at:])
    return root


def title(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return ""


class Page:
    """Lines of text under construction: words of a line, and the blank line that a block asks for before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.mark = "", False, "", ""

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.line += text

    def end(self, spaced: bool = False) -> None:
        if self.line.strip() or self.mark and spaced is None:
            self.put(self.line.rstrip(" "))
        self.line = ""
        self.gap = self.gap or bool(spaced)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead, self.mark = (self.indent[: len(self.indent) - len(self.mark)] + self.mark, "") if self.mark else (self.indent, "")
        self.lines.append(lead + line)


def visible(node: Node, shown: bool) -> bool | None:
    """Whether the text of a node shows; None if nothing below it does."""
    a = node.attrs
    style = _SPACE.sub("", a.get("style", "")).lower()
    if node.tag in HIDDEN or "hidden" in a or "display:none" in style or node.tag == "input" and a.get("type", "").lower() not in BUTTONS or node.tag == "dialog" and "open" not in a:
        return None
    if "visibility:hidden" in style or "visibility:collapse" in style:
        return False
    return True if "visibility:visible" in style else shown


def walk(steps: Iterator) -> None:
    """Runs steps that yield the steps to take before they go on, without recursion."""
    stack = [steps]
    while stack:
        more = next(stack[-1], None)
        if more is None:
            stack.pop()
        else:
            stack.append(more)


def render(node: Node, page: Page, shown: bool = True, count: list[int] | None = None, pre: bool = False) -> Iterator[Iterator]:
    """Steps for walk()."""
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if closed:
                continue
            if shown and pre:
                first, *rest = child.replace("\r\n", "\n").split("\n")
                page.line += first
                for more in rest:
                    page.put(page.line.rstrip()) if page.line.strip() or page.lines else None
                    page.line = more
            elif shown:
                page.write(child)
            continue
        shows = visible(child, shown)
        if shows is None or closed and child.tag != "summary":
            continue
        tag = child.tag
        if tag == "br":
            page.put(page.line.rstrip()) if page.line.strip() else page.lines and not page.gap and page.lines.append("") if shows else None
            page.line = ""
        elif tag == "hr":
            page.end(True)
        elif tag == "input":
            if shows and child.attrs.get("value", "").strip():
                page.write(child.attrs["value"])
        elif tag == "img":
            if shows and child.attrs.get("alt", "").strip():
                page.write(child.attrs["alt"])
        elif tag == "table":
            page.end(page.indent == "")
            yield table(child, page, shows)
            page.end(True)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and page.indent != ""
            page.end(tag in SPACED and not nested)
            before, mark = page.indent, page.mark
            if tag == "li":
                if count is not None:
                    count[0] = int(child.attrs["value"]) if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")) else count[0] + 1
                mark = "- " if count is None else f"{count[0]}. "
                page.mark, page.indent = mark, before + " " * len(mark) if len(before) < INDENT else before
            elif tag in ("dd", "blockquote"):
                page.indent = before + "  " if len(before) < INDENT else before
            start = child.attrs.get("start", "")
            numbers = [int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0] if tag == "ol" else None if tag in ("ul", "menu", "dir") else count
            yield render(child, page, shows, numbers, pre or tag in ("pre", "xmp"))
            page.end(tag in SPACED and not nested)
            page.indent = before
            if tag == "li":
                page.mark = ""
        else:
            yield render(child, page, shows, count, pre or tag == "textarea")
            if tag in ("td", "th"):  # a cell outside of a table
                page.write(" ")


def _rows(node: Node, shown: bool, caption: list[tuple[Node, bool]]) -> Iterator[tuple[Node, bool]]:
    for child in node.children:
        if isinstance(child, str) or (shows := visible(child, shown)) is None:
            continue
        if child.tag == "tr":
            yield child, shows
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, shows, caption)
        elif child.tag == "caption":
            caption.append((child, shows))


class Covered:
    """Columns of a row that cells of rows above cover, as disjoint stretches; where cells overlap, the upper one counts."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: dict[int, list[tuple[int, int]]] = {}  # row -> stretches that are free from it on

    def free(self, at: int) -> int:
        """The first free column from one on."""
        i = bisect_right(self.starts, at) - 1
        return self.ends[i] if i >= 0 and self.ends[i] > at else at

    def cover(self, start: int, end: int, row: int) -> None:
        """A cell covers these columns up to a row."""
        i = max(bisect_right(self.starts, start) - 1, 0)
        gaps, at = [], start
        while i < len(self.starts) and self.starts[i] < end:
            if self.ends[i] > at:
                if self.starts[i] > at:
                    gaps.append((at, self.starts[i]))
                at = self.ends[i]
            i += 1
        if at < end:
            gaps.append((at, end))
        for gap in gaps:
            self.until.setdefault(row, []).append(gap)
            self._join(*gap)

    def _join(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        if i < len(self.starts) and self.starts[i] == end:
            end = self.ends.pop(i)
            del self.starts[i]
        if i and self.ends[i - 1] == start:
            self.ends[i - 1] = end
        else:
            self.starts.insert(i, start)
            self.ends.insert(i, end)

    def reach(self, row: int) -> None:
        """Free what was covered up to a row."""
        for start, end in self.until.pop(row, ()):
            i = bisect_right(self.starts, start) - 1
            whole_start, whole_end = self.starts[i], self.ends[i]
            del self.starts[i], self.ends[i]
            for left, right in ((end, whole_end), (whole_start, start)):
                if left < right:
                    self.starts.insert(i, left)
                    self.ends.insert(i, right)


def wrapped(line: str, width: int) -> list[str]:
    """A line in parts of a width at most, cut at blanks; only a word can be longer."""
    out = []
    while len(line) > width:
        cut = line.rfind(" ", 0, width + 1)
        if not line[: max(cut, 0)].strip():  # the first word, or the blanks before it, go beyond the width
            cut = line.find(" ", len(line) - len(line.lstrip(" ")))
            if cut < 0:
                break
        out.append(line[:cut].rstrip(" "))
        line = line[cut:].lstrip(" ")
    return [*out, line] if line or not out else out


def side_by_side(cells: dict[int, list[str]], starts: dict[int, int], last: int) -> Iterator[str]:
    """The lines of a row. On a line with a word longer than its column, nothing stands right of it."""
    lines: list[list[tuple[int, str]]] = []
    closed: set[int] = set()
    for c in sorted(cells):
        at, overlong = 0, []
        for line in cells[c]:
            for part in wrapped(line, COLUMN) if c != last and len(line) > COLUMN else (line,):
                while at in closed:
                    at += 1
                while at >= len(lines):
                    lines.append([])
                if part:
                    lines[at].append((starts[c], part))
                if c != last and len(part) > COLUMN:
                    overlong.append(at)
                at += 1
        closed.update(overlong)
    for parts in lines:
        line = ""
        for start, part in parts:
            line += " " * max(start - len(line), BETWEEN if line else 0) + part
        if line.strip():
            yield line.rstrip()


def table(node: Node, page: Page, shown: bool) -> Iterator[Iterator]:
    """Rows with cells side by side; spans keep their columns free. Steps for walk().

    A column is as wide as its widest line, up to COLUMN; so each row is aligned, whatever else the table holds. Work and blanks are in
    proportion to cells and rows.
    """
    caption: list[tuple[Node, bool]] = []
    grid: list[dict[int, list[str]]] = []
    covered = Covered()
    span = lambda cell, name, most: min(max(int(v), 1), most) if re.fullmatch(r"\d{1,6}", v := cell.attrs.get(name, "")) else 1
    for number, (row, row_shown) in enumerate(list(_rows(node, shown, caption))):
        covered.reach(number)
        cells: dict[int, list[str]] = {}
        at, lasting = 0, []
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th") or (shows := visible(cell, row_shown)) is None:
                continue
            at = covered.free(at)
            inner = Page()
            yield render(cell, inner, shows)
            inner.end()
            cells[at] = inner.lines
            wide, high = span(cell, "colspan", 1000), span(cell, "rowspan", 65534)
            if high > 1:
                lasting.append((at, at + wide, number + high))
            at += wide
        for stretch in lasting:  # they cover rows below, not their own
            covered.cover(*stretch)
        grid.append(cells)
    for part, shows in caption:
        yield render(part, page, shows)
        page.end()
    width: dict[int, int] = {}
    for cells in grid:
        for c, lines in cells.items():
            width[c] = max(width.get(c, 0), min(COLUMN, max(map(len, lines), default=0)))
    columns = sorted(width)
    starts = dict(zip(columns, accumulate((width[c] + BETWEEN if width[c] else 0 for c in columns[:-1]), lambda a, b: min(a + b, ALIGNED), initial=0), strict=False))
    for cells in grid:
        for line in side_by_side(cells, starts, columns[-1]):
            page.put(line)


def text_of(source: str | None) -> tuple[str, str]:
    """(title, text) of a page; null and empty pages have empty ones."""
    root = parse(source or "")
    page = Page()
    walk(render(root, page))
    page.end()
    return title(root), "\n".join(page.lines).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """pages with the visible text and the title in place of the html.

    Null and empty pages have empty texts; repeated rows are laid out each; an empty table gives an empty result.
    Other columns stay; those named like text_col or title_col are replaced.
    """

    @F.pandas_udf("title string, text string")
    def laid_out(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            yield pd.DataFrame([text_of(s) for s in sources], columns=["title", "text"])

    held = unused(pages, "_made")
    made = pages.withColumn(held, laid_out(F.col(f"`{html_col}`").cast("string"))).drop(html_col)
    return made.withColumns({title_col: F.col(f"{held}.title"), text_col: F.col(f"{held}.text")}).drop(held)


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, title, text."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "title", "text")
