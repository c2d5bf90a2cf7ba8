"""HTML to text, laid out as a reader would see it.

A tag tokenizer feeds a tree builder that opens and closes implied tags; the
renderer leaves out what is not visible and keeps block spacing, list markers
and tables, whose columns are aligned. Both work with stacks of their own, so
elements may be nested to any depth and stay hidden at any depth.

Time and output are in proportion to the page: alignment inserts no run of more
than ``MOST_PAD`` blanks, so cells beyond that stand further left than their
column; and levels of lists and quotes below ``MOST_INDENT`` are indented no
further.

Defined cases: a null or empty page gives an empty text; pages of any length are
read as a whole; markup that is broken off or mis-nested is closed where a
browser would; text of SVG and MathML is visible, their descriptions are not;
repeated rows give repeated results; extra columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_texts

MOST_PAD = 120
MOST_INDENT = 40

TAG = re.compile(r"""<(?:!--(?:.*?(?:-->|--!>)|.*)|[!?][^>]*>?|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACES = re.compile(r"[ \t\n\f\r]+")
DISPLAY = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*([\w-]+)")
VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(\w+)")
SPAN = re.compile(r"[0-9]{1,9}")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist select input textarea link meta base param source track area map rp dialog desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table ul blockquote xmp caption td th tr tbody thead tfoot text foreignobject".split())
#: Blocks that stand apart by an empty line.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul dir xmp".split())
#: An opening tag ends these elements if they are open, looking no further up than the limits.
IMPLIED_ENDS = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "option": frozenset({"option"}),
    "optgroup": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "td", "th", "caption", "colgroup"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"})),
    "body": frozenset({"head"}),
}
LIMITS = {"li": frozenset({"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": frozenset({"dl", "td", "th"}), "dd": frozenset({"dl", "td", "th"}), "p": frozenset({"td", "th", "li", "dd", "button", "caption", "object"})}
TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption".split())


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def hidden(self) -> bool:
        """Neither the element nor anything in it is laid out."""
        a = self.attributes
        if self.tag in UNSEEN and not (self.tag == "dialog" and "open" in a) or "hidden" in a:
            return True
        return "style" in a and (DISPLAY.findall(a["style"]) or [""])[-1].lower() == "none"

    def seen(self, inherited: bool) -> bool:
        """Whether its own text shows: the last visibility that it or an element around it states."""
        said = VISIBILITY.findall(self.attributes.get("style", ""))
        return said[-1].lower() not in ("hidden", "collapse") if said else inherited

    def number(self, name: str, least: int, most: int) -> int:
        value = self.attributes.get(name, "")
        return min(int(value), most) if SPAN.fullmatch(value) and int(value) >= least else 1


class OpenElements:
    """The stack of open elements, with the places of each tag."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of blocks other than p

    def add(self, node: Node) -> None:
        at = len(self.nodes)
        self.places[node.tag].append(at)
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(at)
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def end_implied(self, names: frozenset[str], limits: frozenset[str]) -> None:
        """Close up to the outermost open element of ``names`` above the innermost limit."""
        limit = self.last(limits - names)
        found = [self.places[t][i] for t in names if (i := bisect_right(self.places[t], limit)) < len(self.places[t])]
        if found:
            self.cut(min(found))

    def end(self, tag: str) -> None:
        """An end tag closes its element and all inside it; not from within a cell to what is outside, nor a block by an inline tag."""
        at = self.last((tag,))
        barrier = self.last({"table"} - {tag})
        if tag != "table" and tag not in TABLE_PARTS:
            barrier = max(barrier, self.last(("td", "th", "caption")))
        if tag not in BLOCK and self.blocks:
            barrier = max(barrier, self.blocks[-1])
        if at > barrier:
            self.cut(at)


def parse(html: str) -> Node:
    """The tree of a page below a root node."""
    root = Node("", {})
    opened = OpenElements(root)
    at = 0
    last = html.rfind(">") + 1  # no tag ends later
    while m := TAG.search(html, at, last):
        if m.start() > at:
            opened.nodes[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if not m["name"]:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                at = len(html)
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "p" and not opened.places["p"]:
                opened.nodes[-1].children.append(Node("p", {}))
            elif tag not in ("html", "body"):
                opened.end(tag)
            continue
        if ends := IMPLIED_ENDS.get(tag):
            opened.end_implied(ends, LIMITS.get(tag, LIMITS["p"]) if tag not in TABLE_PARTS else frozenset({"table"}))
        attributes = {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(m["attributes"]))} if m["attributes"] else {}
        node = Node(tag, attributes)
        opened.nodes[-1].children.append(node)
        closed = m["attributes"].endswith("/") and (opened.places["svg"] or opened.places["math"] or tag in ("svg", "math"))
        if tag in RAW and not closed:
            end = re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*>?").search(html, at)
            text = html[at : end.start() if end else len(html)]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else len(html)
        elif tag not in VOID and not closed:
            opened.add(node)
    if rest := re.split(r"<[A-Za-z/!?]", html[at:], maxsplit=1)[0]:
        opened.nodes[-1].children.append(unescape(rest))
    return root


class Frame:
    """An indented element: what its first and its other lines begin with, and the gap that was open before it."""

    __slots__ = ("first", "rest", "used", "gap")

    def __init__(self, first: str, rest: str, gap: int):
        self.first, self.rest, self.used, self.gap = first, rest, False, gap


class Lines:
    """Text that flows into lines."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.frames: list[Frame] = []

    def _open(self) -> None:
        if self.now:
            return
        gap, new = self.gap, len(self.frames)
        while new and not self.frames[new - 1].used:
            new -= 1
            gap = self.frames[new].gap
        if self.done:
            self.done += [""] * gap
        around = self.frames[new - 1].rest if new else ""
        mark = around
        for frame in self.frames[new:]:
            mark += frame.first
            around = frame.rest = around + frame.rest
            frame.used = True
        self.now.append(mark)
        self.gap, self.space = 0, False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(True)
                if line:
                    self._open()
                    self.now.append(line)
            return
        words = SPACES.sub(" ", s)
        if words.startswith(" "):
            self.space = True
        if body := words.strip(" "):
            space = self.space and bool(self.now)
            self._open()
            self.now.append(" " + body if space else body)
            self.space = words.endswith(" ")

    def end(self, always: bool = False) -> None:
        """End the line; an empty one counts only if ``always``."""
        if self.now:
            self.done.append("".join(self.now).rstrip())
            self.now = []
        elif always and self.done and (not self.frames or self.frames[-1].used):
            self.gap += 1
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, int(spaced))

    def enter(self, first: str, rest: str) -> None:
        self.end()
        deep = len(self.frames) >= MOST_INDENT
        self.frames.append(Frame("" if deep else first, "" if deep else rest, self.gap))
        self.gap = 0

    def leave(self) -> None:
        self.end()
        frame = self.frames.pop()
        self.gap = 0 if frame.used else frame.gap

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.end()
            if line:
                self._open()
                self.now.append(line)
            else:
                self.end(True)
        self.end()

    def all(self) -> list[str]:
        self.end()
        return self.done


INDENTED = {"li": ("- ", "  "), "blockquote": ("  ", "  "), "dd": ("    ", "    ")}


def laid_out(children: list) -> list[str]:
    """The lines of a list of nodes and texts. Steps wait on one stack: nodes with their surroundings, and what follows them."""
    page = Lines()
    todo: list[tuple] = []

    def later(children: list, out: Lines, keep: bool, listed: int, seen: bool) -> None:
        todo.extend((c, out, keep, listed, seen) for c in reversed(children))

    later(children, page, False, 0, True)
    while todo:
        c, out, keep, listed, seen = todo.pop()
        if isinstance(c, str):
            if seen:
                out.text(c, keep)
            continue
        if not isinstance(c, Node):
            c()
            continue
        tag = c.tag
        if c.hidden():
            continue
        seen = c.seen(seen) if c.attributes else seen

        def then(f, *args) -> None:
            todo.append((lambda: f(*args), None, False, 0, True))

        if tag == "br":
            out.end(True)
        elif tag == "hr":
            out.block(False)
            if seen:
                out.add(["-" * 20])
        elif tag == "table":
            out.block(True)
            table = Table(c, seen)
            then(out.block, True)
            then(lambda out=out, table=table: out.add(table.lines()))
            for content, cell, shown in reversed(table.contents):
                later(content, cell, False, 0, shown)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(not listed)
            then(out.block, not listed)
            items = []
            start = c.attributes.get("start", "")
            number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
            for x in c.children:
                if isinstance(x, Node) and x.tag == "li" and not x.hidden():
                    value = x.attributes.get("value", "")
                    number = int(value) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", value) else number
                    mark = f"{number}. " if tag == "ol" else "- "
                    items.append((x.children, (mark, " " * len(mark)), x.seen(seen)))
                    number += 1
                else:
                    items.append(([x], None, seen))
            for content, mark, shown in reversed(items):
                if mark:
                    then(out.leave)
                later(content, out, False, listed + 1, shown)
                if mark:
                    then(out.enter, *mark)
        elif tag in INDENTED:
            out.block(tag == "blockquote")
            then(out.block, tag == "blockquote")
            then(out.leave)
            later(c.children, out, False, listed, seen)
            out.enter(*INDENTED[tag])
        elif tag in BLOCK:
            spaced = tag in SPACED
            out.block(spaced)
            then(out.block, spaced)
            shut = tag == "details" and "open" not in c.attributes
            later([x for x in c.children if isinstance(x, Node) and x.tag == "summary"] if shut else c.children, out, keep or tag in ("pre", "xmp"), listed, seen)
        elif tag == "q":
            later(['"', *c.children, '"'], out, keep, listed, seen)
        else:
            later(c.children, out, keep, listed, seen)
    return page.all()


class Table:
    """A table's rows of cells; the cells' own lines are laid out by the caller (``contents``) before ``lines``."""

    def __init__(self, table: Node, seen: bool):
        self.contents: list[tuple[list, Lines, bool]] = []
        self.above: list[Lines] = []
        self.rows: list[list[tuple[int, int, Lines]]] = []  # column, columns, lines
        busy: dict[int, int] = {}  # columns that cells from above reach into, and for how many rows
        row: list[tuple[int, int, Lines]] | None = None
        column = 0

        def new_row() -> None:
            nonlocal row, column
            if self.rows:
                for k in [k for k, n in busy.items() if n <= 1]:
                    del busy[k]
                for k in busy:
                    busy[k] -= 1
            row, column = [], 0
            self.rows.append(row)

        def held(content: list, shown: bool) -> Lines:
            lines = Lines()
            self.contents.append((content, lines, shown))
            return lines

        todo: list[tuple] = [(c, False, seen) for c in reversed(table.children)]
        while todo:
            c, in_row, seen = todo.pop()
            if isinstance(c, str):
                if c.strip():
                    self.above.append(held([c], seen))
            elif c.hidden():
                pass
            elif c.tag in ("td", "th"):
                if not in_row and (row is None or c is not None and not self.loose):
                    new_row()
                    self.loose = True
                while column in busy:
                    column += 1
                across, down = c.number("colspan", 1, 1000), c.number("rowspan", 1, 65534)
                row.append((column, across, held(c.children, c.seen(seen))))
                if down > 1:
                    busy.update((k, down) for k in range(column, column + across))
                column += across
            elif c.tag == "tr":
                new_row()
                self.loose = False
                todo.extend((x, True, c.seen(seen)) for x in reversed(c.children))
            elif c.tag in ("tbody", "thead", "tfoot"):
                busy.clear()
                row, self.loose = None, False
                todo.extend((x, False, c.seen(seen)) for x in reversed(c.children))
            elif c.tag not in ("col", "colgroup"):
                self.above.append(held([c], seen))

    loose = False  # whether cells stand in a row that no tag began

    def lines(self) -> list[str]:
        """Caption, then rows with each column as wide as its widest cell; a cell may have several lines."""
        out = [line for lines in self.above for line in lines.all()]
        widths: dict[int, int] = {}
        rows = [[(at, span, cell.all()) for at, span, cell in row] for row in self.rows]
        for row in rows:
            for at, span, lines in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
        columns = sorted(widths)
        ends = [0, *accumulate(widths[k] + 2 for k in columns)]
        for row in rows:
            cells = [(ends[bisect_left(columns, at)], lines) for at, _, lines in row]
            i = 0
            while cells := [c for c in cells if len(c[1]) > i]:
                parts, length = [], 0
                for start, lines in cells:
                    if lines[i]:
                        pad = " " * min(MOST_PAD, max(2 if length else 0, start - length))
                        parts += [pad, lines[i]]
                        length += len(pad) + len(lines[i])
                out.append("".join(parts).rstrip())
                i += 1
        return out


def html_text(html: str) -> str:
    """All visible text of a page."""
    lines = laid_out(parse(html).children)
    return "\n".join(lines).strip("\n")


def extract_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text) of every row."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [html_text(x or "") for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

        return each

    picked = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"))
    return map_texts(picked, make, "page_id long, text string", "html")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page's visible text, its length and number of lines."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
