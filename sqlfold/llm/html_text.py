"""Layout-aware text of HTML pages: the text a reader sees, in the blocks it is seen in.

Markup goes through a stack of open elements that adds the end tags HTML leaves out
(paragraphs, list items, table parts, options); what scripts, styles, templates, hidden
elements and comments hold is not visible and not emitted. Blocks become lines, with a
blank line where a margin is; list items get markers and indents; the cells of a table
are set in aligned columns. Of svg and math, the labels and the formula are text of the
line they stand in. Everything runs in one pass over a page without recursion,
so depth and length are bounded by the page itself.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

# Element names of the HTML standard, by what they do here.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe noembed noframes object audio video canvas title datalist rp head".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing xmp table figure fieldset hr form".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog div dd dt figcaption footer header hgroup legend li main nav option optgroup search section select summary caption".split())
ENDS_P = (SPACED | frozenset("address article aside center details dialog div figcaption footer header hgroup main nav search section summary".split())) - {"fieldset"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if open, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "button": ({"button"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "caption": ({"tr", "caption"}, {"table"}),
    "rp": ({"rb", "rp", "rt"}, {"ruby", "table"}), "rt": ({"rb", "rp", "rt"}, {"ruby", "table"}),
    "rb": ({"rb", "rp", "rt", "rtc"}, {"ruby", "table"}), "rtc": ({"rb", "rp", "rt", "rtc"}, {"ruby", "table"}),
}
#: HTML start tags that end open svg and math, and what holds HTML inside them.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = {"svg": frozenset({"foreignobject", "desc", "title"}), "math": frozenset("mi mo mn ms mtext".split())}
#: Elements of svg and math that show nothing, and parts of a formula that stand apart.
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask pattern marker filter lineargradient radialgradient style script".split()),
    "math": frozenset("annotation annotation-xml mphantom style script".split()),
}
APART = frozenset("mfrac mtable mtr mlabeledtr".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
BARRIER = frozenset("table td th caption button object template html foreignobject desc mi mo mn ms mtext".split())

_TAG = re.compile(
    r"<(?:!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z)|/>"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
    # a quote opens a value right after the equals sign only
    r"(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?+)?+)*+)(>|\Z))"
)
_ATTR = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+))?+)?+")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_DEEPEST = 60
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
_HIDES = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_SHADE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)


class _Flow:
    """Lines of one column of text: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.buf: list[str] = []
        self.space = False
        self.gap = False
        self.indent = ""
        self.marker: str | None = None

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s == " ":
            self.space = True
            return
        if not s:
            return
        if s[0] == " " or self.space:
            s = (" " if self.buf else "") + s.lstrip(" ")
        self.space = s[-1] == " "
        self.buf.append(s[:-1] if self.space else s)

    def kept(self, s: str) -> None:
        """Text whose line ends and spaces count."""
        head, *rest = s.replace("\r\n", "\n").split("\n")
        self.buf.append(head)
        for line in rest:
            self.line(always=True)
            self.buf.append(line)
        self.space = False

    def line(self, always: bool = False) -> None:
        line = "".join(self.buf)
        self.buf, self.space = [], False
        if line or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            prefix, self.marker = self.indent if self.marker is None else self.marker, None
            self.lines.append((prefix + line).rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap |= spaced

    def item(self, marker: str) -> None:
        self.line()
        if self.marker is not None:
            self.line(always=True)
        self.marker = self.indent + marker
        self.deeper(len(marker))

    def deeper(self, by: int) -> None:
        # no further than that, or deep nesting would make output of the square of the page
        self.indent += " " * min(by, max(0, _DEEPEST - len(self.indent)))


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def lines(self, widest: int) -> list[str]:
        """The rows with cells from one column edge to the next; a cell wider than ``widest`` stands out of its column."""
        taken: dict[int, int] = {}
        placed, width = [], {}
        for row in self.rows:
            col, cells = 0, []
            for lines, span, down in row:
                while taken.get(col, 0) > 0:
                    col += 1
                cells.append((col, lines))
                size = min(widest, max(map(len, lines), default=0))
                if span == 1:
                    width[col] = max(width.get(col, 0), size)
                for c in range(col, col + span):
                    taken[c] = max(taken.get(c, 0), down)
                col += span
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            placed.append(cells)
        edge, at = {}, 0
        for c in range(max((c for cells in placed for c, _ in cells), default=-1) + 1):
            edge[c] = at
            at += width[c] + 2 if width.get(c) else 0
        out = list(self.caption)
        for cells in placed:
            for i in range(max((len(lines) for _, lines in cells), default=0)):
                line = ""
                for col, lines in cells:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(edge[col]) if len(line) + 2 <= edge[col] or not line else line + "  "
                        line += lines[i]
                out.append(line)
        return out


def _number(value: str | None, default: int, low: int, high: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(high, max(low, int(m[1]))) if m else default


def render(page: str, widest: int = 60) -> str:
    """The visible text of one page."""
    flow = _Flow()
    #: (tag, hidden before, shaded before, what ending it has to put back, what its content is:
    #: "" for HTML, "math", "svg" (only text elements show text), "label" for such an element)
    stack: list[tuple] = []
    count: dict[str, int] = {}
    hidden = shaded = False
    pre = 0
    flows: list[_Flow] = []
    tables: list[_Table] = []
    counters: list[list] = []

    def close() -> None:
        nonlocal hidden, shaded, pre, flow
        tag, was_hidden, was_shaded, back, foreign = stack.pop()
        count[tag] -= 1
        if foreign:
            if tag == "text":
                flow.space = True
            hidden, shaded = was_hidden, was_shaded
            return
        if tag in ("td", "th", "caption") and back is not None:
            flow.line()
            lines = flow.lines
            while lines and not lines[-1]:
                lines.pop()
            flow = flows.pop()
            if not hidden and tag == "caption":
                tables[-1].caption += lines
            elif not hidden:
                tables[-1].rows[-1].append((lines, *back))
        elif tag == "table" and back is not None:
            rows = tables.pop().lines(widest)
            flow.block(True)  # stray text of the table comes before it
            for row in rows:
                flow.buf.append(row)
                flow.line(always=True)
            flow.block(True)
        elif not hidden and tag in BLOCK:
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and count.get("li", 0)))
            if tag == "option":
                flow.line()
        if tag == "li" and back is not None:
            flow.line()
            flow.indent, flow.marker = back, None
        elif tag in ("blockquote", "dd") and back is not None:
            flow.indent = back
        elif tag in ("ol", "ul", "menu", "dir") and back is not None:
            counters.pop()
        elif tag in ("pre", "listing", "xmp"):
            pre -= 1
        hidden, shaded = was_hidden, was_shaded

    def close_to(tags, barrier=frozenset()) -> bool:
        if not any(count.get(t) for t in tags):
            return False
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    close()
                return True
            if stack[i][0] in barrier:
                return False
        return False

    def put(s: str, marked: bool = True) -> None:
        if stack and stack[-1][0] == "head" and html.unescape(s).strip(" \t\n\f\r"):
            close()  # its end tag may be left out
        if hidden or shaded or not s:
            return
        if marked and "&" in s:
            s = html.unescape(s)
        inside = stack[-1] if stack else ("", False, False, None, "")
        if inside[4] == "svg" or inside[4] == "math" and not s.strip(" \t\n\f\r"):
            return
        if inside[0] == "details" and inside[3] == "shut":
            return  # its summary is shown, text right under it is not
        if inside[0] in ("table", "tbody", "thead", "tfoot", "tr") and not s.strip(" \t\n\f\r"):
            return
        if pre:
            flow.kept(s)
        else:
            flow.text(s)

    pos = 0
    page = page.replace("\0", "")
    while True:
        m = _TAG.search(page, pos)
        put(page[pos : m.start() if m else len(page)])
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            if stack and stack[-1][4] and page.startswith("<![CDATA[", m.start()):
                end = page.find("]]>", m.start() + 9)
                put(page[m.start() + 9 : end if end >= 0 else len(page)], marked=False)
                pos = end + 3 if end >= 0 else len(page)
            continue
        if m[4] != ">":
            break  # the page ends inside a tag
        tag = m[2].lower()
        if tag == "br" or m[1] and tag == "p":
            while stack and stack[-1][4]:
                close()
        if m[1] and tag != "br":  # </br> is read as <br>
            if count.get(tag):
                # an end tag closes nothing outside the cell it stands in, but for table parts
                close_to({tag}, {"table"} - {tag} if tag in PARTS else {"td", "th", "caption", "table"})
            elif tag in HEADINGS:
                close_to(HEADINGS, BARRIER)
            elif tag == "p" and not hidden:
                flow.block(True)
            continue
        given = dict()
        a = None
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                given.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        # implied ends
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close()
        if tag in BREAKOUT or tag == "font" and given.keys() & {"color", "face", "size"}:
            while stack and stack[-1][4]:
                close()
        around = stack[-1][4] if stack else ""
        foreign = around or (tag if tag in ("svg", "math") else "")
        if foreign:
            style = given.get("style", "")
            kind = "math" if foreign == "math" else "svg"
            gone = tag in FOREIGN_UNSEEN[kind] or "hidden" in given or bool(style and _HIDES.search(style))
            gone = gone or kind == "svg" and given.get("display", "").strip().lower() == "none"
            gone = gone or not around and bool(stack) and stack[-1][0] == "details" and stack[-1][3] == "shut"
            shade = _SHADE.search(style or (f"visibility:{given['visibility']}" if kind == "svg" and "visibility" in given else ""))
            if kind == "math" and around and stack[-1][0] in APART or tag == "text" or tag == "tspan" and given.keys() & {"x", "y", "dy"}:
                flow.space = True
            if m[3].endswith("/") and not (a and a.end() == len(m[3])):
                continue  # <path/> has no content
            if kind == "svg":
                foreign = "label" if tag == "text" or around == "label" and tag in ("tspan", "textpath", "a") else "svg"
            stack.append((tag, hidden, shaded, None, "" if tag in HOLDS_HTML[kind] else foreign))
            count[tag] = count.get(tag, 0) + 1
            hidden, shaded = hidden or gone, shade[1].lower() != "visible" if shade else shaded
            continue
        if tag in ENDS_P and count.get("p"):
            close_to({"p"}, BARRIER)
        if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
            close()
        if tag in CLOSES:
            close_to(*CLOSES[tag])
        if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "col", "colgroup") and not tables:
            continue
        if tag in ("td", "th") and (not stack or stack[-1][0] != "tr") and tables and not hidden:
            while stack and stack[-1][0] not in ("table", "tbody", "thead", "tfoot", "tr"):
                close()
            if not stack or stack[-1][0] != "tr":
                stack.append(("tr", hidden, shaded, None, ""))
                count["tr"] = count.get("tr", 0) + 1
                tables[-1].rows.append([])

        style = given.get("style", "")
        gone = tag in UNSEEN or "hidden" in given and given["hidden"].lower() != "until-found" or bool(style and _HIDES.search(style))
        gone = gone or tag == "dialog" and "open" not in given or tag == "input" and given.get("type", "").lower() == "hidden"
        if stack and stack[-1][0] == "details" and stack[-1][3] == "shut" and tag != "summary":
            gone = True
        shade = _SHADE.search(style) if style else None
        now_hidden, now_shaded = hidden or gone, shade[1].lower() != "visible" if shade else shaded

        if tag in VOID:
            if now_hidden or now_shaded:
                continue
            if tag == "br":
                flow.line(always=True)
            elif tag == "hr":
                flow.block(True)
            elif tag == "input" and given.get("type", "text").lower() in ("text", "submit", "reset", "button", "search", "email", "tel", "url", "number"):
                flow.text(given.get("value", ""))
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, pos)
            body = page[pos : end.start() if end else len(page)]
            pos = _TAG.search(page, end.start()).end() if end else len(page)
            if not now_hidden and not now_shaded and tag in ("textarea", "xmp"):
                flow.block(tag == "xmp")
                flow.kept((html.unescape(body) if tag == "textarea" else body).removeprefix("\n"))
                flow.block(tag == "xmp")
            continue

        back = None
        if not now_hidden:
            if tag in BLOCK and not tables or tag in BLOCK and tag not in ("table", "caption"):
                nested = tag in ("ul", "ol", "menu", "dir") and count.get("li", 0)
                flow.block(tag in SPACED and not nested)
            if tag == "table":
                flow.block(True)
                tables.append(_Table())
                back = True
            elif tag == "tr":
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables and tables[-1].rows:
                flows.append(flow)
                flow = _Flow()
                back = (_number(given.get("colspan"), 1, 1, 1000), _number(given.get("rowspan"), 1, 1, 65534))
            elif tag == "caption":
                flows.append(flow)
                flow = _Flow()
                back = True
            elif tag in ("ul", "menu", "dir", "ol"):
                back = True
                counters.append([_number(given.get("start"), 1, -(10**9), 10**9)] if tag == "ol" else [None])
            elif tag == "li":
                back = flow.indent
                no = counters[-1] if counters else [None]
                if no[0] is None:
                    flow.item("- ")
                else:
                    no[0] = _number(given.get("value"), no[0], -(10**9), 10**9)
                    flow.item(f"{no[0]}. ")
                    no[0] += 1
            elif tag in ("blockquote", "dd"):
                back = flow.indent
                flow.deeper(4)
        if tag == "details":
            back = None if "open" in given else "shut"
        if tag in ("pre", "listing"):
            pre += 1
            if page.startswith("\n", pos):
                pos += 1
        stack.append((tag, hidden, shaded, back, ""))
        count[tag] = count.get(tag, 0) + 1
        hidden, shaded = now_hidden, now_shaded
    while stack:
        close()
    flow.line()
    lines = flow.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract_text(df: DataFrame, id_col: str, html_col: str, carry: list[str] | None = None, widest: int = 60) -> DataFrame:
    """(id, carried columns, text): one row per page, in one pass without a shuffle.

    A null page has empty text. Bytes of text are kept whole: columns of tables are aligned
    up to ``widest`` characters, longer cells are not cut.
    """
    names = [id_col, *(carry or [])]
    common.session(df)

    def run(batches):
        for batch in batches:
            # by the row: a page of any length is held once, beside its own text
            texts = pa.array((render(p.as_py() or "", widest) for p in batch.column(len(names))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], texts], [*names, "text"])

    picked = df.select(*names, F.col(html_col).cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, text string")
