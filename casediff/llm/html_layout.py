"""Text of web pages as a browser would lay it out.

Tags are read in order into a stack of open elements.  Implied end tags close
paragraphs, list items, definition parts, options, rows and cells, as HTML's tree
construction does; a stray end tag is ignored, an unclosed element ends with its
parent, and a head ends where something other than head content begins.  Invisible parts give nothing: head, scripts, styles, templates, hidden
elements (attribute, ``display:none``, ``visibility:hidden``), closed dialogs, data
lists, what stands in for media, frames and objects, and notes for browsers without
scripts.  Buttons, text areas, the chosen option of a select (all of a list), formulas
and the text elements of drawings are text in the line.  Blocks start on lines of their own, paragraphs, headings, lists and
tables with a blank line around; list items are marked and indented by depth;
table cells are padded so that columns line up; ``pre`` keeps its white space.

All state is a stack, the places of the open elements by tag, and the text so far,
without recursion; tags are found in one pass.  So time grows with the page, also
with deep nesting and unclosed quotes: a tag that never ends takes the rest of the
page, as in a browser.  The text is at most ``12`` times as long as the page:
a cell is padded to ``WIDE`` characters at most (a longer one breaks the alignment of
its own row), lists are indented ``DEEP_LISTS`` levels at most, and tables nested
deeper than ``DEEP_CELLS`` are laid out as blocks.

Edge cases: a null or empty page gives empty text; repeated rows each get a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN_ATTRIBUTES = re.compile(r"""[^>"']*""")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in
           ("script", "style", "textarea", "title", "noscript", "iframe", "template", "object")}
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
NUMBER = re.compile(r"\s*(\d+)")
#: Limits of the attributes, as in HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Padding of a cell, depth of indentation, and open cells at most.
WIDE, DEEP_LISTS, DEEP_CELLS = 32, 16, 32
#: Columns that line up.
COLUMNS = 100
BLANK = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div article section nav aside header footer main address form fieldset li dt dd tr td th thead tbody "
    "tfoot caption figcaption details summary hr center legend menu dir option".split())
INVISIBLE = frozenset("head datalist audio video canvas rp".split())
#: Shown in the line, set off from what stands beside them.
CONTROLS = frozenset("button textarea select".split())
#: Drawings show their text elements only, formulas all but these.
SVG_INVISIBLE = frozenset("desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient".split())
MATH_INVISIBLE = frozenset("annotation annotation-xml mphantom".split())
MATH_TEXT = frozenset("mi mo mn ms mtext".split())
#: Parts of these stand one above or beside the other.
MATH_PARTS = frozenset("mfrac mtable mtr mlabeledtr".split())
#: These end a drawing or formula that is still open.
BREAKOUT = BLOCKS | frozenset(
    "b big br code em embed head i img li listing meta nobr ruby s small span strong strike sub sup tt u var".split())
#: A start tag ends these open elements, up to the nearest of the third column.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th", "caption"), ("tr", "table")), "th": (("td", "th", "caption"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
#: Start tags that leave an open head open.
HEAD_CONTENT = frozenset("html head base basefont bgsound link meta title noframes noscript script style template".split())
#: Without an end tag these count as not there; the other raw elements then take the rest of the page, as in a browser.
ENDED = frozenset("svg math object noscript select".split())
#: End tags do not reach beyond these.
WALLS = ("td", "th", "table", "caption")
#: Blocks do not end a paragraph beyond these.
PARAGRAPH_WALLS = (*WALLS, "button", "select", "foreignobject")


def attributes(s: str) -> dict[str, str]:
    """Names in lower case and values of a start tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(s):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def style_hides(style: str) -> bool:
    """Whether a style attribute ends up with ``display: none`` or without visibility."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in CSS_COMMENT.sub("", style).split(";"):
        name, _, value = declaration.partition(":")
        name, (value, mark, rank) = name.strip().lower(), value.lower().partition("!")
        important = bool(mark) and rank.strip() == "important"
        if important or not found.get(name, (False,))[0]:
            found[name] = important, value.strip()
    return found.get("display", "  ")[1] == "none" or found.get("visibility", "  ")[1] in ("hidden", "collapse")


def number(value: str | None, least: int, most: int) -> int:
    """An attribute's whole number within bounds; the lower one where it has none."""
    found = NUMBER.match(value or "")
    return min(max(int(found[1][:9]), least), most) if found else least


class Flow:
    """Lines of laid-out text; the last one in parts."""

    def __init__(self):
        self.lines, self.gap, self.space = [], False, False
        self.set("")

    def set(self, line: str) -> None:
        self.parts, self.last, self.shows = [line], line[-1:], bool(line.strip())

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.last, self.shows = s[-1], self.shows or bool(s.strip())

    def text(self, s: str) -> None:
        words = BLANK.sub(" ", s)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if (self.space or words[0] == " ") and self.last and self.last != " ":
            self.add(" ")
        self.add(words.strip(" "))
        self.space = words[-1] == " "

    def end_line(self) -> None:
        if self.shows:
            self.put("".join(self.parts).rstrip())
        self.set("")
        self.space = False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def paragraph(self) -> None:
        self.end_line()
        self.gap = True

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def align(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns spanned, rows spanned) as lines whose first ``COLUMNS`` columns line up."""
    placed, widths, columns = [], {}, 0
    taken: dict[int, int] = {}  # for a column, the rows that a cell above still reaches into
    for row in rows:
        out, at, new = [], 0, {}
        for cell, span, down in row:
            free = at
            while taken.get(free, 0):
                free += 1
            if free > at:
                out.append((at, free, ""))
            at = free
            if span == 1 and len(cell) <= WIDE:
                widths[at] = max(widths.get(at, 0), len(cell))
            out.append((at, at + span, cell))
            columns = max(columns, min(at + 1, COLUMNS))
            if down > 1:
                new.update(dict.fromkeys(range(at, min(at + span, COLUMNS)), down - 1))
            at += span
        taken = {i: n - 1 for i, n in taken.items() if n > 1} | new
        placed.append(out)
    lines = []
    for row in placed:
        line = []
        for at, end, cell in row:
            width, i = -3, at
            while i < min(end, columns) and width < WIDE:
                width += widths.get(i, 0) + 3
                i += 1
            line.append(cell.ljust(min(max(width, 0), WIDE)))
        lines.append(" | ".join(line).rstrip())
    return [x for x in lines if x.strip(" |")]


class Layout:
    def __init__(self):
        self.flow = Flow()
        self.open: list[tuple] = []  # (tag, what to do at its end, ``foreign`` around it)
        self.places: dict[str, list[int]] = {}  # by tag, its places in ``open``
        self.flows: list[Flow] = []  # flows around the open cells, selects and options
        self.selects: list[tuple[bool, list]] = []  # (all options shown, options so far) of the open selects
        self.tables: list[list] = []  # rows of the open tables
        self.lists: list[list] = []  # [ordered, items so far] of the open lists
        self.invisible = self.pre = 0
        self.foreign = ""  # "svg", "text" in a drawing, "math", or empty in HTML

    def start(self, tag: str, attrs: str) -> None:
        if tag == "html" and self.open or tag in ("head", "body") and self.places.get(tag):
            return None
        if tag not in HEAD_CONTENT:
            self.end_head()
        if self.foreign and tag in BREAKOUT:
            while self.foreign:
                self.pop()
        if tag == "select" and self.places.get("select"):
            return self.end("select")
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            self.close_open(ends, walls)
        if tag in BLOCKS and tag not in ("html", "body", "option"):
            self.close_open(("p",), PARAGRAPH_WALLS)
        given = attributes(attrs) if attrs else {}
        hidden = tag in INVISIBLE or "hidden" in given or style_hides(given.get("style", "")) or (
            tag == "dialog" and "open" not in given)
        if self.open and isinstance(self.open[-1][1], list):  # in a closed details element only its first summary shows
            hidden = hidden or tag != "summary" or self.open[-1][1][0]
            self.open[-1][1][0] = self.open[-1][1][0] or tag == "summary"
        around, inside = self.foreign, self.foreign
        if tag in ("svg", "math"):
            inside = tag
        elif around in ("svg", "text"):
            inside = "text" if tag == "text" else "" if tag == "foreignobject" else around
            hidden = hidden or tag in SVG_INVISIBLE
        elif around == "math":
            inside = "" if tag in MATH_TEXT else around
            hidden = hidden or tag in MATH_INVISIBLE
        if around or inside:
            if attrs.endswith("/"):
                return None
            hidden = hidden or given.get("display") == "none" or given.get("visibility") in ("hidden", "collapse")
        if tag in VOID:
            if not self.invisible and not hidden:
                if tag == "br":
                    if self.flow.shows:
                        self.flow.end_line()
                elif tag == "hr":
                    self.flow.paragraph()
            return None
        if hidden:
            self.invisible += 1
        state = "hidden" if hidden else ""
        if not self.invisible:
            if tag in CONTROLS or inside == "text" or around == "math" and self.open[-1][0] in MATH_PARTS:
                self.flow.space = True
            if tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.lists):
                self.flow.paragraph()
            elif tag == "option" and self.selects:
                self.flows.append(self.flow)
                self.flow = Flow()
                state = ("option", given)
            elif tag == "select":
                self.selects.append(("multiple" in given or number(given.get("size"), 1, 1000) > 1, []))
                self.flows.append(self.flow)
                self.flow = Flow()
                state = "select"
            elif tag in BLOCKS:
                self.flow.end_line()
            if tag in ("ul", "ol", "menu", "dir"):
                self.lists.append([tag == "ol", 0])
                state = "list"
            elif tag == "li":
                mark = "- "
                if self.lists:
                    self.lists[-1][1] += 1
                    if self.lists[-1][0]:
                        mark = f"{self.lists[-1][1]}. "
                self.flow.set("  " * min(max(0, len(self.lists) - 1), DEEP_LISTS) + mark)
            elif tag == "dd":
                self.flow.set("  ")
            elif tag == "details" and "open" not in given:
                state = [False]
            elif tag == "pre":
                self.pre += 1
                state = "pre"
            elif tag == "table" and len(self.flows) < DEEP_CELLS:
                self.tables.append([])
                state = "table"
            elif tag == "tr" and self.tables and len(self.flows) < DEEP_CELLS:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and len(self.flows) < DEEP_CELLS:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.flows.append(self.flow)
                self.flow = Flow()
                # no row spanned: down to the last
                state = ("cell", number(given.get("colspan"), 1, MOST_COLUMNS),
                         (number(given.get("rowspan"), 0, MOST_ROWS) or MOST_ROWS) if "rowspan" in given else 1)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, state, around))
        self.foreign = inside
        return None

    def highest(self, tags) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end(self, tag: str) -> None:
        at = self.highest((tag,))
        if tag == "p" and at < 0:
            if not self.invisible:
                self.flow.paragraph()
            return
        if tag == "br":
            return self.start("br", "")
        if at < 0 or tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and self.highest(WALLS) > at:
            return None
        while len(self.open) > at:
            self.pop()
        return None

    def close_open(self, ends: tuple, walls: tuple) -> None:
        while (at := self.highest(ends)) > self.highest(walls):
            while len(self.open) > at:
                self.pop()
            if len(ends) < 2:
                return

    def end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.pop()

    def pop(self) -> None:
        tag, state, around = self.open.pop()
        self.places[tag].pop()
        inside, self.foreign = self.foreign, around
        if state == "hidden":
            self.invisible -= 1
            return
        if self.invisible:
            return
        if tag in CONTROLS or inside == "text" and tag == "text":
            self.flow.space = True
        if state == "list":
            self.flow.end_line()
            self.lists.pop()
            if not self.lists:
                self.flow.paragraph()
        elif state == "pre":
            self.pre -= 1
            self.flow.paragraph()
        elif state == "table":
            self.flow.paragraph()
            for line in align(self.tables.pop()):
                self.flow.put(line)
            self.flow.paragraph()
        elif state == "select":
            self.flow = self.flows.pop()
            self.choose(*self.selects.pop())
        elif state and state[0] == "option":
            text = " ".join(x.strip() for x in self.flow.result() if x.strip())
            self.flow = self.flows.pop()
            self.selects[-1][1].append((state[1].get("label") or text, state[1]))
        elif state and state[0] == "cell":
            cell = " ".join(x.strip() for x in self.flow.result() if x.strip())
            self.flow = self.flows.pop()
            self.tables[-1][-1].append((cell, *state[1:]))
        elif tag in PARAGRAPHS:
            self.flow.paragraph()
        elif tag in BLOCKS:
            self.flow.end_line()

    def choose(self, all_shown: bool, options: list[tuple[str, dict]]) -> None:
        """The text of a select: all options of a list, or else the chosen one."""
        if all_shown:
            for text, _ in options:
                self.flow.end_line()
                self.flow.text(text)
            self.flow.end_line()
            return
        chosen = [x for x, given in options if "selected" in given]
        free = [x for x, given in options if "disabled" not in given]
        self.flow.space = True
        self.flow.text((chosen[-1:] or free[:1] or [""])[0])
        self.flow.space = True

    def data(self, s: str) -> None:
        s = unescape(s) if "&" in s else s
        if s.strip(" \t\n\r\f"):
            self.end_head()
        if self.invisible or self.foreign == "svg" or not s or self.open and isinstance(self.open[-1][1], list):
            return
        if self.pre:
            first, *rest = s.split("\n")
            self.flow.add(first)
            for line in rest:
                self.flow.put("".join(self.flow.parts).rstrip())
                self.flow.set(line)
        else:
            self.flow.text(s)


def next_tag(html: str, at: int) -> tuple[int, int, str, str, str] | None:
    """(start, end, ``""``, ``"start"`` or ``"end"``, name, attributes) of the next comment or tag from ``at`` on.

    One that never ends takes the rest of the page."""
    size = len(html)
    while (i := html.find("<", at)) >= 0:
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            return i, size if end < 0 else end + 3, "", "", ""
        if html.startswith(("<!", "<?"), i):
            end = html.find(">", i)
            return i, size if end < 0 else end + 1, "", "", ""
        if name := NAME.match(html, i + 2) if html.startswith("</", i) else None:
            end = html.find(">", name.end())
            return i, size if end < 0 else end + 1, "" if end < 0 else "end", name[0].lower(), ""
        if name := NAME.match(html, i + 1):
            end = PLAIN_ATTRIBUTES.match(html, name.end()).end()
            while end < size and html[end] != ">":
                closing = html.find(html[end], end + 1)
                end = size if closing < 0 else PLAIN_ATTRIBUTES.match(html, closing + 1).end()
            return i, min(end + 1, size), "start" if end < size else "", name[0].lower(), html[name.end():end]
        at = i + 1
    return None


def render(html: str | None) -> str:
    """The visible text of a page."""
    page, at, seen = Layout(), 0, 0
    html = html or ""
    last: dict[str, int] = {}  # where the last end tag of a tag of ENDED begins
    never: set[str] = set()  # raw elements without another end tag
    while found := next_tag(html, at):
        begin, end, kind, tag, attrs = found
        if begin > seen:
            page.data(html[seen:begin])
        at = seen = end
        if kind == "end":
            page.end(tag)
        elif kind == "start":
            closed = RAW_END.get(tag)
            if tag not in HEAD_CONTENT:
                page.end_head()
            if tag in ENDED and not attrs.endswith("/"):
                if tag not in last:
                    last[tag] = max((x.start() for x in re.finditer(rf"</{tag}\s*>", html, re.I)), default=-1)
                if last[tag] < at:
                    continue
            if closed is None:
                page.start(tag, attrs)
            elif not attrs.endswith("/"):
                stop = closed.search(html, at) if tag not in never else None
                if stop is None:
                    never.add(tag)
                if tag == "textarea":
                    page.start(tag, attrs)
                    page.data(html[at:stop.start() if stop else len(html)])
                    page.end(tag)
                at = seen = stop.end() if stop else len(html)
    page.data(html[seen:])
    while page.open:
        page.pop()
    return "\n".join(page.flow.result())


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: id, ``text``, ``n_chars``, ``n_lines`` (with text)."""

    def run(batches):
        for b in batches:
            text = [render(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                 pa.array([sum(1 for x in t.split("\n") if x) for t in text], pa.int64())],
                names=[id_col, "text", "n_chars", "n_lines"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(html).cast("string").alias("html")).mapInArrow(
        run, f"`{id_col}` {kind}, text string, n_chars bigint, n_lines bigint")


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
