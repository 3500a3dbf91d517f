"""Visible text of web pages, laid out: blocks apart, lists marked and indented, table cells in aligned columns.

A page is read tag by tag into a tree. The builder closes what HTML closes by implication (a paragraph before a block, an
item before the next, cells and rows, and at the end whatever is open), leaves out what is never shown, and the tree is then
rendered from the inside out. One page is one row, so pages are spread by Spark and never meet.
"""

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Generator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import mapped, query, table

# Levels of lists that still indent, and of tables that still align; and kinds of HTML elements.
INDENTED, ALIGNED = 200, 50
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes audio video canvas datalist".split())
# in svg and math: what is not drawn, what draws text in svg, and parts of formulas that stand apart
UNDRAWN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()), "math": frozenset("annotation annotation-xml".split())}
DRAWN = frozenset("text foreignobject".split())
HOSTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())           # these may hold HTML; elsewhere it ends svg and math
BREAKS_OUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s
    small span strong strike sub sup table tt u ul var""".split())
APART = frozenset("mfrac msup msub msubsup munder mover munderover mroot mtable mtr mlabeledtr mmultiscripts".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure fieldset".split())
LINES = BLOCK | DRAWN | frozenset("xmp textarea".split())        # rendered as blocks, though they leave paragraphs open
KEPT = frozenset("pre xmp textarea".split())                     # white space stays
# what a start tag closes, up to the element that bounds the search
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
          "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th", "caption", "colgroup"), ("tr", "table")), "th": (("td", "th", "caption", "colgroup"), ("tr", "table")),
          "thead": (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)),
          "caption": (("caption", "colgroup"), ("table",)), "colgroup": (("caption", "colgroup"), ("table",))}
SECTIONS = frozenset("thead tbody tfoot colgroup".split())
FOREIGN = frozenset("svg math".split())
SCOPE = frozenset("table td th caption html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_MAYBE = re.compile(r"hidden|display|visibility|&", re.I)     # only tags with one of these can hide their element
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
_PART = re.compile(r"""((?:"[^"]*"?|'[^']*'?|\([^)]*\)?|[^;"'(])*);?""")
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("name", "kids", "seen", "cells", "mute", "chosen", "span")

    def __init__(self, name: str, seen: bool, mute: bool = False):
        self.name, self.kids, self.seen, self.mute = name, [], seen, mute       # mute: text directly inside isn't shown
        self.cells, self.chosen = False, None    # rows or cells of the table around are inside; of a select: its option, or True if all show
        self.span = (1, 1)                       # columns and rows of a table cell


def attributes(tag: str) -> dict[str, str]:
    """Names and values in a start tag; of a repeated name the first counts."""
    out = {}
    for name, *values in _ATTR.findall(tag):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _hides(tag: str) -> bool:
    given = attributes(tag)
    if "hidden" in given:
        return True
    style, fixed = {}, set()
    for part in _PART.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", given.get("style", ""), flags=re.S)):
        name, _, value = part.partition(":")
        name, value, mark = name.strip().lower(), *value.lower().partition("!")[:2]
        if mark or name not in fixed:
            style[name] = value.strip()
        if mark:
            fixed.add(name)
    return style.get("display") == "none" or style.get("visibility") == "hidden"


def tree(page: str) -> Node:
    root = Node("html", True)
    stack, at, end, opened = [root], 0, len(page), Counter()

    def cut(i: int) -> None:
        opened.subtract(n.name for n in stack[i:])
        del stack[i:]

    def close(names, bounds) -> None:
        while any(opened[n] for n in names):                     # so deep pages aren't searched for what isn't open
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    cut(i)
                    break
                if stack[i].name in bounds:
                    return
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else end]
        if text and not stack[-1].mute:
            stack[-1].kids.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if not opened[name]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    cut(i)
                    break
                if stack[i].name in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                    break
            continue
        if name in BREAKS_OUT and any(opened[n] for n in FOREIGN):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in HOSTS:
                    break
                if stack[i].name in FOREIGN:
                    cut(i)
        if name in ("select", "input", "textarea") and opened["select"]:
            close(("select",), SCOPE)
            if name == "select":
                continue
        if name in ("html", "body"):
            if name == "body":
                close(("head",), ())
            continue
        if name in BLOCK:
            close(("head",), ())
            close(("p",), SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        above = stack[-1]
        node = Node(name, name not in UNSEEN and not (m[3] and _MAYBE.search(m[3]) and _hides(m[3])), above.mute)
        foreign = name in FOREIGN or any(opened[n] for n in FOREIGN)
        if foreign:
            node.seen &= not any(opened[n] and name in names for n, names in UNDRAWN.items())
            node.mute = name == "svg" or (above.mute and name not in DRAWN)
            if above.name in APART and above.kids:
                above.kids.append(" ")
        elif name == "select":
            given, node.mute = attributes(m[3]), True
            size = re.match(r"\s*(\d+)", given.get("size", ""))
            node.chosen = True if "multiple" in given or (size and int(size[1]) > 1) else None
        elif name == "option" and opened["select"]:
            box = next(n for n in reversed(stack) if n.name == "select")
            node.mute = False
            if box.chosen is not True:
                given = attributes(m[3])
                if "selected" in given or (box.chosen is None and "disabled" not in given):
                    if box.chosen:
                        box.chosen.seen = False                  # the last selected one counts, without any the first one that can be chosen
                    box.chosen = node
                else:
                    node.seen = False
            if node.seen:
                above.kids.append(" ")
        if above.name == "details" and above.mute:               # a closed one shows its summary only
            node.seen &= name == "summary"
            node.mute = False
        elif name == "details" and "open" not in attributes(m[3]):
            node.mute = True
        if name in ("td", "th") and "span" in m[3].lower():
            given = attributes(m[3])
            node.span = tuple(min(max(int(re.match(r"\s*(\d{0,6})", given.get(a, ""))[1] or 1), least), most) for a, least, most in (("colspan", 1, 1000), ("rowspan", 0, 65_534)))
        if name in ("tr", "td", "th"):
            for n in reversed(stack):
                if n.name == "table" or n.cells:
                    break
                n.cells = True
        above.kids += [" ", node, " "] if name == "select" else [node]
        if foreign and m[3].endswith("/"):
            continue
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            if name in KEPT:
                text = page[at:stop.start() if stop else end]
                node.kids.append(text if name == "xmp" else html.unescape(text.removeprefix("\r").removeprefix("\n")))
            at = stop.start() if stop else end
            stack.append(node)
            opened[name] += 1
        elif name not in VOID:
            stack.append(node)
            opened[name] += 1
    return root


class _Lines:
    """Lines of a block; words of inline text gather on the last one."""

    def __init__(self):
        self.lines, self.open, self.glue = deque(), "", False

    def text(self, s: str) -> None:
        flat = _SPACE.sub(" ", s)
        if not flat:
            return
        if flat[0] == " ":
            self.glue, flat = True, flat[1:]
        if flat:
            self.open += (" " if self.glue and self.open else "") + flat.rstrip(" ")
            self.glue = flat.endswith(" ")

    def end(self) -> None:
        if self.open:
            self.lines.append(self.open)
        self.open, self.glue = "", False

    def block(self, lines: deque[str], spaced: bool) -> None:
        """Takes the lines over; the longer side stays in place, so deep nesting doesn't copy a page at every level."""
        self.end()
        if lines:
            if spaced and self.lines and self.lines[-1]:
                self.lines.append("")
            if len(lines) > len(self.lines):
                lines.extendleft(reversed(self.lines))
                self.lines = lines
            else:
                self.lines.extend(lines)
            if spaced:
                self.lines.append("")


def _trim(lines: deque[str]) -> deque[str]:
    while lines and not lines[0]:
        lines.popleft()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _parts(table: Node) -> tuple[Node, list[list[Node]]]:
    """What a table holds outside its cells (captions, and text or elements in rows and sections), and the cells of each row.

    Cells are found through sections, rows and whatever else is put around them; cells outside any row make up one.
    """
    note, rows, group, row = Node("div", True), [], None, None
    todo = [(table, iter(table.kids))]
    while todo:
        for k in todo[-1][1]:
            if isinstance(k, str) or not (k.name in SECTIONS or k.cells or k.name in ("tr", "td", "th")):
                if group is None:
                    group = Node("div", True)
                    note.kids.append(group)
                group.kids.append(k)
            elif k.seen and k.name in ("td", "th"):
                if row is None:
                    row = []
                    rows.append(row)
                row.append(k)
                group = None
            elif k.seen:
                if k.name == "tr":
                    row = []
                    rows.append(row)
                elif k.name in SECTIONS:
                    row = None
                group = None
                todo.append((k, iter(k.kids)))
                break
        else:
            node, _ = todo.pop()
            group = None
            if node.name == "tr" or node.name in SECTIONS:
                row = None
    return note, rows


def _grid(rows: list[list[deque[str]]], spans: list[list[tuple[int, int]]]) -> deque[str]:
    """Cells one beside the other, each column as wide as its widest cell. A cell over several columns or rows keeps the cells after it and
    below it in their columns; one over more columns than it has room in widens the last. Columns in which no cell begins take no room."""
    taken, placed = {}, []                       # column: rows below that a cell still covers
    for cells, sizes in zip(rows, spans):
        at, line, covered = 0, [], {c: n for c, n in taken.items() if n}
        taken = {c: n - 1 for c, n in covered.items()}
        for cell, (wide, high) in zip(cells, sizes):
            while covered.get(at):
                at += 1
            line.append((at, at + wide, cell))
            if high != 1:
                taken.update(dict.fromkeys(range(at, at + wide), high - 1 if high else len(rows)))
            at += wide
        placed.append(line)
    column = {c: i for i, c in enumerate(sorted({c for line in placed for c, _, _ in line}))}
    starts = list(column)
    width = [0] * len(starts)
    within = lambda lo, hi: (column[lo], bisect_left(starts, hi))
    placed = [[(*within(lo, hi), cell) for lo, hi, cell in line] for line in placed]
    for lo, hi, cell in sorted((c for line in placed for c in line), key=lambda c: c[1] - c[0]):
        width[hi - 1] += max(0, max(map(len, cell)) - sum(width[lo:hi]) - 2 * (hi - lo - 1))
    offset = [0, *accumulate(w + 2 for w in width)]
    out = deque()
    for line in placed:
        cells = [(lo, list(cell)) for lo, _, cell in line]
        for k in range(max((len(cell) for _, cell in cells), default=0)):
            flat = ""
            for lo, cell in cells:
                if k < len(cell) and cell[k]:
                    flat = flat.ljust(offset[lo]) + cell[k]
            out.append(flat.rstrip())
    return out


def _lines(node: Node, lists: int, tables: int) -> Generator[tuple[Node, int, int], deque[str], deque[str]]:
    """Lines of what is inside a node; yields the blocks it needs the lines of."""
    out, number, pre = _Lines(), 0, node.name in KEPT
    todo = [iter(node.kids)]
    while todo:                                                  # inline elements, however deep, are walked here
        for k in todo[-1]:
            if isinstance(k, str):
                if pre:
                    first, *more = k.split("\n")
                    out.open += first
                    for line in more:
                        out.lines.append(out.open)
                        out.open = line
                else:
                    out.text(k)
            elif not k.seen:
                continue
            elif k.name == "br":
                out.lines.append(out.open)
                out.open, out.glue = "", False
            elif k.name in LINES:
                if k.name == "hr":
                    out.end()
                elif k.name == "table":
                    note, cells = _parts(k)
                    lines, rows = _trim((yield note, lists, tables + 1)), []
                    for row in cells:
                        rows.append([])
                        for c in row:
                            rows[-1].append(_trim((yield c, lists, tables + 1)) or deque([""]))
                    whole = _Lines()
                    whole.block(lines, False)
                    if tables < ALIGNED:
                        whole.block(_grid(rows, [[c.span for c in row] for row in cells]), False)
                    else:
                        for cell in (c for row in rows for c in row):
                            whole.block(_trim(cell), False)
                    out.block(whole.lines, True)
                elif k.name == "li":
                    number += 1
                    mark = f"{number}. " if node.name == "ol" else "- "
                    lines = _trim((yield k, lists + 1, tables))
                    if lists < INDENTED:
                        lines = deque([(mark if i == 0 else " " * len(mark)) + s if s or i == 0 else s for i, s in enumerate(lines)])
                    elif lines:
                        lines[0] = mark + lines[0]
                    out.block(lines, False)
                else:
                    nested = k.name in ("ul", "ol", "dl") and node.name in ("li", "dd")
                    lines = yield k, lists, tables
                    out.block(lines if k.name in KEPT else _trim(lines), k.name in SPACED and not nested)
            else:
                todo.append(iter(k.kids))
                break
        else:
            todo.pop()
    out.end()
    return out.lines


def render(node: Node) -> deque[str]:
    """Lines of what is inside a node, nested however deep.

    Only white space depends on depth: from 200 lists inside each other on a list no longer indents the rest of an item, and
    from 50 tables on the cells are put below each other. Text, line breaks and list marks are the same at any depth.
    """
    open_, lines = [_lines(node, 0, 0)], None
    while open_:
        try:
            open_.append(_lines(*open_[-1].send(lines)))
            lines = None
        except StopIteration as done:
            open_.pop()
            lines = done.value
    return lines


def text_of(page: str) -> str:
    return "\n".join(_trim(render(tree(page))))


def _renderer(cols):
    def start():
        def step(batch):
            text = [None if p is None else text_of(p) for p in batch.column("html").to_pylist()]
            return [*(batch.column(c) for c in cols), pa.array(text, pa.string())]
        return step
    return start


def extracted(pages: DataFrame) -> DataFrame:
    """`pages` with a column `visible_text`; all other columns stay, and no other name must be `visible_text`.

    A null page gives null, an empty one or one without visible text gives an empty text. Broken markup never fails: open
    elements end with the page, stray end tags are passed over. Repeated rows are rendered each.
    """
    schema = T.StructType([*pages.schema.fields, T.StructField("visible_text", T.StringType())])
    return mapped(pages, _renderer(pages.columns), schema)


@query("op8_html_text")
def op8_html_text(spark, sf_dir):
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", F.length("visible_text").cast("long").alias("n_chars"), F.col("visible_text").alias("text"))
