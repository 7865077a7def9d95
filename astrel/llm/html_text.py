"""HTML extraction by layout-aware rendering.

A tree builder keeps the stack of open elements, closes and opens the ones that
HTML implies, and knows which are invisible.  The renderer emits all visible text:
blocks on lines of their own with the blank lines their margins ask for, list items
with bullets or numbers and indented, table cells in aligned columns.  Both work
in one pass with an explicit stack; a block's lines are handed on as they are and
indented once, at the end, so the work is linear in the page however deep it nests.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _spark as S

_s = lambda x: frozenset(x.split())
VOID = _s("area base br col embed hr img input link meta param source track wbr")
RAW = _s("script style title textarea iframe noembed noframes xmp noscript")
HIDDEN = _s("head script style title template noscript iframe noembed noframes datalist audio video canvas object map rp area base link meta param")
#: Blank-line blocks, and blocks that only take lines of their own.
SPACED = _s("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir hr xmp")
BLOCK = SPACED | _s("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav option optgroup section summary caption search")
HEADING = _s("h1 h2 h3 h4 h5 h6")
HEAD = _s("title style script meta link base template noscript noframes")
TABLE = _s("table caption colgroup col thead tbody tfoot tr td th")
#: Start tags that close an open element of the value's kinds, up to a boundary.
_P_CLOSERS = _s("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt")
_CLOSES = {
    "li": (_s("li"), _s("ul ol menu dir table td th")), "dd": (_s("dd dt"), _s("dl table td th")), "dt": (_s("dd dt"), _s("dl table td th")),
    "option": (_s("option"), _s("select datalist")), "optgroup": (_s("option optgroup"), _s("select")), "td": (_s("td th"), _s("tr table")), "th": (_s("td th"), _s("tr table")),
    "tr": (_s("tr td th caption colgroup"), _s("table tbody thead tfoot")), "tbody": (_s("tbody thead tfoot tr td th caption colgroup"), _s("table")), "thead": (_s("tbody thead tfoot tr td th caption colgroup"), _s("table")),
    "tfoot": (_s("tbody thead tfoot tr td th caption colgroup"), _s("table")), "caption": (_s("caption"), _s("table")), "rt": (_s("rt rp"), _s("ruby")), "rp": (_s("rt rp"), _s("ruby")),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GAP = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


#: Columns of indentation; deeper blocks aren't moved or marked further.
INDENT = 80
#: Tables inside tables whose columns are aligned; deeper ones put their cells below one another.
DEPTH = 30


def width_of(s: str) -> int:
    """Columns that a line takes: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Block:
    """Lines of a block, with what stands before the first of them and before the others."""

    __slots__ = ("lines", "first", "rest")

    def __init__(self, lines, first: str, rest: str):
        self.lines, self.first, self.rest = lines, first, rest


def flat(lines: list) -> list[str]:
    """Lines and blocks as lines."""
    out: list[str] = []
    stack = [[iter(lines), "", ""]]
    while stack:
        top = stack[-1]
        for x in top[0]:
            first, top[1] = top[1], top[2]
            if isinstance(x, str):
                out.append(first + x if x else x)
            else:
                stack.append([iter(x.lines), first + x.first if len(first) < INDENT else first, top[2] + x.rest if len(top[2]) < INDENT else top[2]])
                break
        else:
            stack.pop()
    return out


class Buffer:
    """Lines of one block: inline text flows into the last line, blocks begin a new one."""

    __slots__ = ("lines", "flow", "gap", "need")

    def __init__(self):
        self.lines: list[str | Block] = []
        self.flow: list[str] = []  # pieces of the open line
        self.gap = False  # white space seen since the last piece
        self.need = 0  # blank lines wanted before the next line

    def text(self, s: str) -> None:
        t = _GAP.sub(" ", s)
        if t == " " or not t:
            self.gap |= bool(t)
            return
        if t[0] == " ":
            self.gap, t = True, t[1:]
        if self.gap and self.flow:
            self.flow.append(" ")
        self.gap = t[-1] == " "
        self.flow.append(t[:-1] if self.gap else t)

    def line(self) -> None:
        """End the open line, if there is one."""
        if self.flow:
            self.put(["".join(self.flow)])
            self.flow = []
        self.gap = False

    def put(self, lines: list[str | Block]) -> None:
        if self.lines and self.need:
            self.lines.extend([""] * self.need)
        self.need = 0
        self.lines.extend(lines)

    def block(self, blank: int) -> None:
        self.line()
        self.need = max(self.need, blank)

    def done(self) -> list[str | Block]:
        self.line()
        return self.lines


class Element:
    __slots__ = ("tag", "hidden", "pre", "buffer", "count", "rows", "closed_details")

    def __init__(self, tag, hidden, pre):
        self.tag, self.hidden, self.pre = tag, hidden, pre
        self.buffer = self.rows = None
        self.count = None
        self.closed_details = False


def _placed(rows):
    """Rows of (lines, first column, column after the last) from rows of cells (lines, columns, rows), which cells above push aside."""
    out, down = [], []  # down: (first, end, rows left) of cells that reach down, ascending
    for row in rows:
        cells, at, k, begun = [], 0, 0, []
        for lines, wide, high in row:
            while k < len(down) and down[k][0] <= at:
                at = max(at, down[k][1])
                k += 1
            cells.append((lines, at, at + wide))
            if high > 1:
                begun.append((at, at + wide, high))
            at += wide
        out.append(cells)
        down = sorted((a, z, n - 1) for a, z, n in down + begun if n > 1)
    return out


def _columns(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines of a cell, first column, column after the last) as lines with aligned columns, two spaces apart."""
    edges = sorted({x for row in rows for _, *ends in row for x in ends} | {0})
    index = {x: i for i, x in enumerate(edges)}
    width = [0] * (len(edges) - 1)
    rows = [[(lines, max(map(width_of, lines), default=0), index[a], index[z]) for lines, a, z in row] for row in rows]
    for row in rows:
        for _, w, a, z in row:
            if z == a + 1:
                width[a] = max(width[a], w)
    wide = sorted({(z, a, w) for row in rows for _, w, a, z in row if z > a + 1})
    # what a spanning cell needs beyond its columns goes to the last of them; by last column, so that sums of those before it stay
    start, done = [0], 0
    for z, a, w in wide:
        while done < z - 1:
            start.append(start[-1] + width[done] + 2)
            done += 1
        width[z - 1] = max(width[z - 1], w - (start[z - 1] - start[a]))
    start = [0, *accumulate(x + 2 for x in width)]
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, *_ in row), default=0)):
            parts, at = [], 0
            for lines, _, a, z in row:
                if i < len(lines) and lines[i]:
                    parts += [" " * (start[a] - at), lines[i]]
                    at = start[a] + width_of(lines[i])
            out.append("".join(parts).rstrip(" "))
    return out


class Renderer:
    """Feeds on tags and text; text() gives what is visible."""

    def __init__(self):
        root = Element("#root", False, False)
        root.buffer = Buffer()
        self.stack = [root]
        self.buffers = [root.buffer]
        self.title: str | None = None
        self.fresh = False  # right after <pre>: a line break here isn't shown
        self.open_tags: dict[str, list[int]] = {}  # positions in the stack, ascending
        self.tables: list[Element] = []

    # tree building

    def start(self, tag: str, attrs: str) -> None:
        if tag == "image":
            tag = "img"
        if tag in ("html", "body") and self.open_tags.get(tag):
            return
        if tag != "head" and tag not in HEAD and self.open_tags.get("head"):
            self.pop_to("head")
        if tag in _P_CLOSERS and self.open_tags.get("p"):
            self.close_within(_s_p, _BOUND)
        if tag in HEADING and self.stack[-1].tag in HEADING:
            self.pop()
        if tag == "a" and self.open_tags.get("a"):
            self.close_within(_s_a, _BOUND)
        if rule := _CLOSES.get(tag):
            self.close_within(*rule)
        if tag in TABLE and tag != "table":
            if not self.open_tags.get("table"):
                if tag in ("td", "th"):  # a cell without a table is inline text
                    self.buffers[-1].gap = True
                return
            if tag in ("td", "th") and self.stack[-1].tag != "tr":
                self.start("tr", "")
        above = self.stack[-1]
        hidden = above.hidden or tag in HIDDEN or (above.closed_details and tag != "summary")
        if attrs and not hidden and ("hidden" in attrs.lower() or "style" in attrs.lower()):
            got = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
            hidden = "hidden" in got and got["hidden"].lower() != "until-found" or bool(_NONE.search(_html.unescape(got.get("style", ""))))
        if tag == "dialog" and not re.search(r"\bopen\b", attrs):
            hidden = True
        if tag in VOID:
            if not hidden:
                self.void(tag, attrs)
            return
        e = Element(tag, hidden, above.pre or tag in ("pre", "xmp", "textarea"))
        if tag == "details" and not re.search(r"\bopen\b", attrs):
            e.closed_details = True
        self.fresh = tag in ("pre", "textarea")
        self.open_tags.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)
        if hidden:
            return
        b = self.buffers[-1]
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and any(self.open_tags.get(t) for t in ("li",))
            b.block(1 if tag in SPACED and not nested else 0)
        if tag in ("ul", "menu", "dir"):
            e.count = 0
        elif tag == "ol":
            m = re.search(r"\bstart\s*=\s*[\"']?(-?\d+)", attrs)
            e.count = int(m[1]) if m else 1
        elif tag == "table":
            e.rows = []
            self.tables.append(e)
            e.buffer = Buffer()  # text between the cells comes before the table
            self.buffers.append(e.buffer)
        elif tag == "tr":
            table = self.table()
            if table is not None:
                table.rows.append([])
        elif tag in ("td", "th"):
            m = re.search(r"\bcolspan\s*=\s*[\"']?0*(\d+)", attrs, re.I)
            wide = 1 if not m else 1000 if len(m[1]) > 3 else max(int(m[1]), 1)
            m = re.search(r"\browspan\s*=\s*[\"']?0*(\d+)", attrs, re.I)
            high = 1 if not m else 65534 if len(m[1]) > 5 else min(int(m[1]), 65534)
            e.count = (wide, high or 65534)  # 0: all rows that follow
            e.buffer = Buffer()
            self.buffers.append(e.buffer)
        elif tag in ("li", "blockquote", "dd"):
            e.buffer = Buffer()
            self.buffers.append(e.buffer)

    def table(self):
        return self.tables[-1] if self.tables else None

    def nearest(self, tags) -> int:
        """Position of the innermost open element with one of the tags, or 0."""
        return max((self.open_tags[t][-1] for t in tags if self.open_tags.get(t)), default=0)

    def close_within(self, tags, bounds) -> None:
        """Close the innermost element with one of the tags, unless a boundary is nearer; repeated for nested ones."""
        bound = self.nearest(bounds)
        found = [at[bisect_right(at, bound)] for t in tags if (at := self.open_tags.get(t)) and at[-1] > bound]
        if found:
            found = min(found)
            while len(self.stack) > found:
                self.pop()

    def pop_to(self, tag: str) -> None:
        while self.stack[-1].tag != tag:
            self.pop()
        self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.open_tags.get("p"):
            self.start("p", "")
            self.pop()
        elif tag in ("body", "html"):
            return  # what follows still belongs to the body
        elif tag in HEADING:
            if any(self.open_tags.get(h) for h in HEADING):
                while self.stack[-1].tag not in HEADING and self.stack[-1].rows is None and len(self.stack) > 1:
                    self.pop()
                if self.stack[-1].tag in HEADING:
                    self.pop()
        elif self.open_tags.get(tag):
            at = self.open_tags[tag][-1]
            if tag not in TABLE and self.nearest(("table", "td", "th")) > at:
                return
            while len(self.stack) > at:
                self.pop()

    # rendering

    def void(self, tag: str, attrs: str) -> None:
        b = self.buffers[-1]
        if tag == "br":
            if b.flow:
                b.line()
            else:
                b.put([""]) if b.lines and not b.need else None
        elif tag == "hr":
            b.block(1)
        elif tag == "input":
            got = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
            if got.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "tel", "url", "number") and got.get("value"):
                b.text(" " + _html.unescape(got["value"]) + " ")

    def text(self, raw: str) -> None:
        e = self.stack[-1]
        if self.fresh:
            self.fresh = False
            raw = raw.removeprefix("\r").removeprefix("\n")
        if e.tag == "head" and raw.strip():
            self.pop()
            e = self.stack[-1]
        if e.hidden or e.closed_details:
            return
        s = _html.unescape(raw) if "&" in raw else raw
        b = self.buffers[-1]
        if not e.pre:
            b.text(s)
            return
        lines = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, line in enumerate(lines):
            if i:
                if b.flow:
                    b.line()
                else:
                    b.put([""])
            if line:
                b.flow.append(line)

    def pop(self) -> None:
        e = self.stack.pop()
        self.open_tags[e.tag].pop()
        if e.rows is not None:
            self.tables.pop()
        if e.hidden:
            return
        if e.buffer is None:
            if e.tag in BLOCK:
                spaced = e.tag in SPACED and not (e.tag in ("ul", "ol", "menu", "dir") and self.open_tags.get("li"))
                self.buffers[-1].block(1 if spaced else 0)
            elif e.tag == "caption":
                self.buffers[-1].line()
            return
        self.buffers.pop()
        lines = e.buffer.done()
        b = self.buffers[-1]
        if e.tag in ("td", "th"):
            table = self.table()
            if table is None:
                b.put(lines)
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((lines, *(e.count or (1, 1))))
        elif e.tag == "table":
            b.block(1)
            rows = _placed(e.rows)
            single = all(len(row) < 2 and (not row or row[0][1] == 0) for row in rows)
            if single or len(self.tables) >= DEPTH:
                cells = [Block(cell[0], "", "") for row in rows for cell in row if cell[0]]
            else:
                cells = _columns([[(flat(lines), a, z) for lines, a, z in row] for row in rows])
            whole = lines + cells
            if whole:
                b.put(whole)
            b.block(1)
        else:
            b.line()
            if e.tag == "li":
                mark = "- "
                up = self.stack[self.nearest(("ul", "ol", "menu", "dir"))]
                if up.tag == "ol":
                    mark = f"{up.count}. "
                    up.count += 1
                if lines:
                    b.put([Block(lines, mark, " " * len(mark))])
            elif lines:
                pad = "  " if e.tag == "blockquote" else "    "
                b.put([Block(lines, pad, pad)])
            b.block(1 if e.tag == "blockquote" else 0)

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.pop()
        return "\n".join(flat(self.buffers[0].done())).strip("\n")


_s_p, _s_a, _BOUND = _s("p"), _s("a"), _s("table td th caption button object applet marquee template")


def render(source: str) -> tuple[str | None, str]:
    """(title, visible text) of a page; any string is a page."""
    r = Renderer()
    at, n = 0, len(source)
    find, low = source.find, None
    while at < n:
        lt = find("<", at)
        if lt < 0:
            r.text(source[at:])
            break
        if lt > at:
            r.text(source[at:lt])
        nxt = source[lt + 1 : lt + 2]
        if nxt.isalpha() or (nxt == "/" and source[lt + 2 : lt + 3].isalpha()):
            m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
            tag, attrs = m[2].lower(), m[3]
            at = m.end()
            if m[1]:
                r.end(tag)
                continue
            r.start(tag, attrs)
            if tag in RAW and r.stack[-1].tag == tag:
                low = source.lower() if low is None else low
                end = low.find("</" + tag, at) if len(low) == n else re.compile("</" + tag, re.I).search(source, at)
                end = end if isinstance(end, int) else (end.start() if end else -1)
                body = source[at : end if end >= 0 else n]
                if tag == "title" and r.title is None:
                    r.title = _GAP.sub(" ", _html.unescape(body)).strip(" ")
                if tag in ("textarea", "xmp"):
                    r.text(body)
                r.pop()
                close = find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else n
        elif source.startswith("<!--", lt):
            end = find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
        elif nxt in ("!", "?", "/"):
            end = find(">", lt)
            at = end + 1 if end >= 0 else n
        else:
            r.text("<")
            at = lt + 1
    return r.title, r.finish()


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, title and text (all visible text) of each row of pages(page_id, html, ...).

    A null or empty page has an empty text and no title.  Malformed markup is
    repaired as far as the implied tags go and never fails; repeated rows give
    repeated results; pages are rendered whole; other columns are ignored.  Layout,
    not text, has bounds: INDENT columns of indentation, DEPTH tables in tables.
    """

    def over(batch):
        out = [render(h) if h else (None, "") for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["page_id", "title", "text"])

    return S.map_arrow(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), over, "page_id long, title string, text string")
