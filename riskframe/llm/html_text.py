"""Visible text of whole HTML pages, laid out.

A tree builder keeps the open elements, with end tags that HTML implies (p before a block, li before li, cells,
rows, options, terms), and lays out each element as it opens and closes; visibility rules drop what is never shown
(head, scripts, templates, hidden attributes, and styles, also those that a style element gives to tags, classes and
ids; rules that are nested or combine elements are not read). What is visible inside an invisible element is shown.
The head ends at its end tag or at the first text or tag that is not head content. All options of a select, the text
of a textarea, of svg text elements and of formulas are visible.

Text is written as it is laid out: collapsed white space, blank lines around blocks, list markers by depth,
preformatted text as it is, and tables with their columns aligned, cells that span columns or rows among them. A cell
wider than WIDEST characters does not widen its column, and no column begins beyond FARTHEST; cells
beyond COLUMNS columns are not moved by those that span rows. Lists are indented by DEEPEST steps at most, and tables
within NESTED others are lines of their cells, so that the text stays in proportion to the page. No nesting is too deep, and the
time grows with the length of the page: after a tag whose quotes do not close, tags end at the next ">".

Null, empty and markup-free input has defined text (null: empty); repeated rows each keep theirs, and ties do not
arise. An empty table has an empty result; other columns of any name play no part.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame

from riskframe.llm.spans import scan

# Elements by how HTML lays them out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title".split())
HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
PLAIN = frozenset("textarea xmp".split())  # raw text that is shown as it is
# In svg and math: what is not drawn, where HTML goes on, and the tags that end them elsewhere.
FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table form fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address li dt dd tr caption legend details summary figcaption center option".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "option"}
# Open elements that a start tag ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "caption", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
INLINE = frozenset("b i em strong span a font u small code".split())
BULLETS = -(10**10)
P_SCOPE = {"td", "th", "table", "caption", "button", "li", "blockquote"}

TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)")
TAG_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
DISPLAY = re.compile(r"(?i)(?<![\w-])display\s*:\s*([\w-]+)")
VISIBILITY = re.compile(r"(?i)visibility\s*:\s*(hidden|collapse|visible)")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.ASCII | re.IGNORECASE)
LONG_NUMBER = re.compile(r"&#(?:[xX][0-9a-fA-F]{8,}+|[0-9]{8,}+);?")
INTEGER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
#: Characters that a cell widens its column to, at most, and columns that cells spanning rows may block.
WIDEST, COLUMNS = 80, 1_000
#: Bounds of the layout alone, so that text stays in proportion to a page: steps of indentation that are shown, how far
#: to the right a column may begin, and tables within tables whose columns are still aligned.
DEEPEST, FARTHEST, NESTED = 16, 160, 6
SPACE = re.compile(r"[ \t\n\r\f]+")


class Page:
    """Lines of laid-out text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line ends wanted before the next text
        self.space = False
        self.prefix = ""  # a list marker that waits for its text
        self.indent = 0

    def text(self, text: str) -> None:
        words = SPACE.split(text)
        if words[0] == "" and len(words) > 1:
            self.space = True
        body = " ".join(w for w in words if w)
        if not body:
            return
        self.begin()
        if self.space and self.line and not self.line[-1].endswith(" "):
            self.line.append(" ")
        self.line.append(body)
        self.space = words[-1] == ""

    def begin(self) -> None:
        if self.gap:
            self.end_line()
            if self.gap > 1 and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
        if not self.line:
            self.space = False
            pad = "  " * min(self.indent, DEEPEST)
            self.line.append(pad + self.prefix if self.prefix else pad)
            self.prefix = ""

    def end_line(self) -> None:
        if "".join(self.line).strip():
            self.lines.append("".join(self.line).rstrip())
        self.line = []
        self.space = False

    def want(self, gap: int) -> None:
        self.gap = max(self.gap, gap)

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and self.lines[-1] != "":
            self.lines.append("")

    def put(self, lines: list[str], gap: int) -> None:
        """Lines as they are, gap lines apart from the rest."""
        if any(x.strip() for x in lines):
            self.want(gap)
            self.begin()
            pad = "".join(self.line)
            self.line = []
            self.lines += [(pad if i == 0 else " " * len(pad)) + x for i, x in enumerate(lines)]
            self.want(gap)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def unescape(text: str) -> str:
    """Character references as the characters that they stand for; those of no character as U+FFFD, however long."""
    if "&#" in text:

        def short(m: re.Match) -> str:
            mark = "&#x" if m[0][2] in "xX" else "&#"
            digits = m[0].removeprefix("&#").lstrip("xX").rstrip(";").lstrip("0") or "0"
            return html.unescape(f"{mark}{digits};") if len(digits) < 8 else "\ufffd"

        text = LONG_NUMBER.sub(short, text)
    return html.unescape(text) if "&" in text else text


def attributes_of(source: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def integer(text: str, least: int, most: int, other: int) -> int:
    m = INTEGER.match(text)
    return min(max(int(m[1]), least), most) if m else other


Rule = tuple[str, frozenset[str]]  # a tag (or ""), and the classes and ids (".x", "#x") that it must have


def not_displayed(style: str) -> bool:
    """Whether the last word on display is none."""
    return [x.lower() for x in DISPLAY.findall(style)][-1:] == ["none"]


def style_rules(css: str) -> tuple[list[Rule], list[Rule]]:
    """The selectors that a style sheet does not display, and those that it makes invisible."""
    gone, unseen, depth, start, head = [], [], 0, 0, ""
    first, *commented = css.split("/*")
    for m in re.finditer(r"[{}]", first + "".join(c.partition("*/")[2] for c in commented)):
        part = m.string[start : m.start()]
        start = m.end()
        if m[0] == "{":
            depth += 1
            head = part if depth == 1 else ""
            continue
        depth = max(0, depth - 1)
        if depth or not head or "@" in head:
            continue
        shown = VISIBILITY.findall(part)
        into = gone if not_displayed(part) else unseen if shown and shown[-1].lower() != "visible" else None
        if into is not None:
            for selector in head.split(","):
                if (own := SELECTOR.fullmatch(selector.strip())) and own[0]:
                    into.append(((own[1] or "").lower(), frozenset(re.findall(r"[.#][\w-]+", own[2]))))
        head = ""
    return gone, unseen


def aligned(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of cells (columns and rows spanned, lines) with columns as wide as their widest line, two spaces apart."""
    placed: list[list[tuple[int, list[str]]]] = []
    width: dict[int, int] = {}
    blocked: dict[int, int] = {}  # columns that cells of earlier rows span, for how many more rows
    for row in rows:
        now, blocked = blocked, {c: n - 1 for c, n in blocked.items() if n > 1}
        column, out = 0, []
        for columns, down, lines in row:
            while column in now:
                column += 1
            out.append((column, lines))
            own = max(map(len, lines), default=0)
            width[column] = max(width.get(column, 0), own if columns == 1 and own <= WIDEST else 0)
            if down > 1:
                blocked |= dict.fromkeys(range(column, min(column + columns, COLUMNS)), down - 1)
            column += columns
        placed.append(out)
    offset, at = {}, 0
    for column in sorted(width):
        offset[column] = min(at, FARTHEST)
        at += width[column] + 2
    text = []
    for row in placed:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line, size = [], 0
            for column, lines in row:
                if k < len(lines) and lines[k]:
                    gap = max(offset[column] - size, 2 if size else 0)
                    line += [" " * gap, lines[k]]
                    size += gap + len(lines[k])
            text.append("".join(line).rstrip())
    return text


class Layout:
    def __init__(self) -> None:
        self.page = Page()
        self.open: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each tag: where it stands among the open elements
        self.blocks: list[int] = []  # where blocks and cells stand
        self.seen: list[bool] = [True]  # visibility of the open elements
        self.off = 0  # depth of the outermost element that is not displayed, 0 if none
        self.rules: tuple[list[Rule], list[Rule]] = ([], [])
        self.lists: list[int] = []  # counters of open lists; BULLETS: none
        # Of each open table: the page around it, its rows, the lists around it, and its captions and loose text.
        self.tables: list[tuple[Page, list[list[tuple[int, int, list[str]]]], list[int], Page]] = []
        self.spans: list[tuple[int, int]] = []  # columns and rows of the open cells
        self.flat = 0  # open tables that are nested too deep to be aligned: rows are lines there
        self.pre = 0
        self.roots = 0  # open svg and math elements

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of tags, -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def foreign(self) -> int | None:
        """The place of the svg or math element whose content the open element is, not HTML."""
        if self.roots:
            root = self.last(("svg", "math"))
            if root > self.last(INTEGRATION):
                return root
        return None

    def style(self, css: str) -> None:
        for own, more in zip(self.rules, style_rules(css), strict=True):
            own += more

    def push(self, tag: str, seen: bool) -> None:
        if tag in BLOCK or tag in ("td", "th"):
            self.blocks.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        self.seen.append(seen)

    def shown(self, tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
        """Whether an element is displayed, and whether it is visible."""
        style = attributes.get("style", "")
        own = {f".{c}" for c in attributes.get("class", "").split()} | {f"#{i}" for i in attributes.get("id", "").split()}

        def meets(rules: list[Rule]) -> bool:
            return any((not t or t == tag) and need <= own for t, need in rules)

        gone = tag in UNSEEN or "hidden" in attributes or not_displayed(style) or tag == "dialog" and "open" not in attributes or meets(self.rules[0])
        said = VISIBILITY.findall(style)
        seen = said[-1].lower() == "visible" if said else self.seen[-1] and not meets(self.rules[1])
        return not gone, seen

    def end_head(self) -> None:
        if self.open and self.open[-1] == "head":
            self.pop()

    def start(self, tag: str, attributes: str) -> bool:
        """Whether raw text follows, which is no markup up to the end tag."""
        if tag not in HEAD:
            self.end_head()
        while tag in BREAKOUT and (root := self.foreign()) is not None:
            while len(self.open) > root:
                self.pop()
        foreign = tag not in ("svg", "math") and self.foreign() is not None
        self.begin(tag, attributes)
        if (foreign or tag in ("svg", "math")) and attributes.endswith("/"):
            if self.open[-1] == tag:
                self.pop()
            return False
        return tag in RAW and (not foreign or tag in ("script", "style"))

    def begin(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and self.places.get("p"):
            self.end_within({"p"}, P_SCOPE)
        if tag in ENDS:
            self.end_within(*ENDS[tag])
        if tag in ("td", "th") and self.tables and not self.in_row():
            self.begin("tr", "")
        if tag in VOID:
            if not self.off:
                self.void(tag, attributes)
            return
        found = attributes_of(attributes) if attributes and not attributes.isspace() else {}
        displayed, seen = self.shown(tag, found)
        self.push(tag, seen)
        self.roots += tag in ("svg", "math")
        if self.off:
            return
        if not displayed or self.roots and tag in FOREIGN_UNSEEN:
            self.off = len(self.open)
        elif tag == "table" and len(self.tables) >= NESTED:
            self.flat += 1
            self.page.want(2)
        elif self.flat and tag in ("tr", "td", "th"):
            self.page.want(1 if tag == "tr" else 0)
            self.page.space = True
        elif tag == "table":
            own = Page()
            self.tables.append((self.page, [], self.lists, own))
            self.page, self.lists = own, []
        elif tag == "tr" and self.tables:
            self.tables[-1][1].append([])
        elif tag in ("td", "th") and self.tables:
            self.page = Page()
            self.spans.append((integer(found.get("colspan", ""), 1, 1_000, 1), integer(found.get("rowspan", ""), 1, 65_534, 1)))
        elif tag in ("ul", "ol"):
            self.page.want(1 if self.lists else 2)
            self.lists.append(integer(found.get("start", ""), -(10**9), 10**9, 1) if tag == "ol" else BULLETS)
        elif tag == "li":
            self.page.want(1)
            self.page.indent = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] != BULLETS:
                self.page.prefix = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            else:
                self.page.prefix = "- "
        elif tag == "dd":
            self.page.want(1)
            self.page.indent += 1
        elif tag == "pre":
            self.page.want(2)
            self.pre += 1
        elif tag == "q":
            self.text('"')
        elif tag == "optgroup":
            self.page.want(1)
            self.text(found.get("label", ""))
        elif tag in BLOCK:
            self.page.want(2 if tag in SPACED else 1)
        elif tag in PLAIN or tag == "text" and self.roots:
            self.page.want(1)

    def in_row(self) -> bool:
        return self.last(("tr",)) > self.last(("table",))

    def void(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.page.line_break()
        elif tag in ("hr", "img"):
            found = attributes_of(attributes)
            if all(self.shown(tag, found)):
                if tag == "hr":
                    self.page.put(["---"], 2)
                else:
                    self.page.text(found.get("alt", ""))

    def end_within(self, tags: set[str], stop: set[str]) -> None:
        """Ends the open elements down to the outermost of tags that no element of stop encloses."""
        stop_at = self.last(stop)
        inside = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, stop_at)) < len(p)]
        if inside:
            last = min(inside)
            while len(self.open) > last:
                self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.places.get(tag):
            if tag in INLINE and self.blocks and self.blocks[-1] > self.places[tag][-1]:
                return  # an inline end tag does not end a block
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        tag = self.open.pop()
        self.seen.pop()
        self.places[tag].pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        self.roots -= tag in ("svg", "math")
        if self.off:
            if len(self.open) < self.off:
                self.off = 0
            return tag
        if self.flat and tag in ("td", "th", "tr", "table"):
            self.flat -= tag == "table"
            self.page.want(2 if tag == "table" else 0)
        elif tag in ("td", "th") and self.tables:
            cell = self.page.done()
            self.page = self.tables[-1][3]
            if not self.tables[-1][1]:
                self.tables[-1][1].append([])
            self.tables[-1][1][-1].append((*self.spans.pop(), cell))
        elif tag == "table" and self.tables:
            self.page, rows, self.lists, own = self.tables.pop()
            loose = own.done()
            self.page.put(loose, 1)
            self.page.put(aligned(rows), 2)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.page.indent = max(0, len(self.lists) - 1)
            self.page.prefix = ""
            self.page.want(1 if self.lists else 2)
        elif tag == "dd":
            self.page.indent = max(0, self.page.indent - 1)
            self.page.want(1)
        elif tag == "pre":
            self.pre -= 1
            self.page.want(2)
        elif tag == "q":
            self.text('"')
        elif tag in BLOCK:
            self.page.want(2 if tag in SPACED else 1)
        elif tag in PLAIN or tag == "text" and self.roots:
            self.page.want(1)
        return tag

    def plain(self, text: str) -> None:
        """Text of a textarea or the like: its line ends stay."""
        self.pre += 1
        self.text(text.removeprefix("\r").removeprefix("\n"))
        self.pre -= 1

    def text(self, text: str) -> None:
        if self.off and text.strip():
            self.end_head()
        if (root := self.foreign()) is not None and self.open[root] == "svg" and self.last(("text",)) < root:
            return  # svg draws only its text elements
        if self.off or not self.seen[-1] or self.tables and self.open and self.open[-1] in ("table", "tr", "thead", "tbody", "tfoot") and not text.strip():
            return
        if self.pre:
            lines = text.replace("\r\n", "\n").split("\n")
            for i, line in enumerate(lines):
                if i:
                    self.page.end_line()
                if line:
                    self.page.begin()
                    self.page.line.append(line)
        else:
            self.page.text(text)


def visible_text(source: str) -> str:
    layout, at, n, quotes = Layout(), 0, len(source), True
    end_of: dict[str, re.Pattern] = {}
    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            layout.text(unescape(source[at:mark]))
        if mark == n:
            break
        if source.startswith("<!--", mark):
            close = source.find("-->", mark + 4)
            at = n if close < 0 else close + 3
        elif source[mark + 1 : mark + 2] in ("!", "?"):
            close = source.find(">", mark)
            at = n if close < 0 else close + 1
        elif m := TAG.match(source, mark):
            end = TAG_END.match(source, m.end()) if quotes else None
            if end is None:
                quotes = False
            stop = end.end() if end else source.find(">", m.end()) + 1
            if not stop:  # a tag that never ends is no text either
                break
            tag, attributes, at = m[1].lower(), source[m.end() : stop - 1], stop
            if source[mark + 1] == "/":
                layout.end(tag)
            elif layout.start(tag, attributes):
                if tag not in end_of:
                    end_of[tag] = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])")
                close = end_of[tag].search(source, at)
                stop = close.start() if close else n
                if tag in PLAIN:
                    layout.plain(unescape(source[at:stop]) if tag == "textarea" else source[at:stop])
                elif tag == "style":
                    layout.style(source[at:stop])
                at = stop
        else:
            layout.text("<")
            at = mark + 1
    while layout.open:
        layout.pop()
    return "\n".join(layout.page.done())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the visible text of each page."""

    def rows_of():
        return lambda columns: [columns[0], columns[1], [visible_text(h or "") for h in columns[2]]]

    return scan(pages.withColumn("page_id", pages["page_id"].cast("long")), ("page_id", "url", "html"), "page_id long, url string, text string", rows_of)
