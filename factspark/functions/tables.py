"""Tables of HTML pages as grids of cells: spans are filled in, so every row has every column."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard: the most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SECTIONS = ("thead", "tbody", "tfoot")
UNSEEN = ("script", "style", "template", "noscript")
#: What `read_plain` does with a tag; it leaves pages with RAW ones, whose content may be no markup or is not seen, to `Reader`.
CELL, ROW, SECTION, TABLE, BREAK, HEAD, RAW = range(1, 8)
KINDS = {"td": CELL, "th": CELL, "tr": ROW, "table": TABLE} | dict.fromkeys(SECTIONS, SECTION) | dict.fromkeys(("br", "p", "div", "li"), BREAK) | dict.fromkeys(("h1", "h2", "h3"), HEAD)
KINDS |= dict.fromkeys((*UNSEEN, "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext"), RAW)
#: A tag as most are: a plain name, and attributes whose values hold neither markup nor references. One that closes itself has none.
TAG = re.compile(
    r"""<(/?+)([a-zA-Z][a-zA-Z0-9]*+)(?:((?:[ \t\n\r\f]++[a-zA-Z][a-zA-Z0-9-]*+(?:=(?:"[^"<>&]*+"|'[^'<>&]*+'|[a-zA-Z0-9_#%.-]++))?+)*+)[ \t\n\r\f]*+>|[ \t\n\r\f]*+(/)>)"""
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*+)(?:=(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f]++)))?+""")


def span(attrs: dict[str, str | None], name: str, most: int) -> int:
    """A span attribute; what is no number counts as 1, and rowspan 0 reaches to the end of its section."""
    value = (attrs.get(name) or "1").strip()
    n = int(value) if value.isascii() and value.isdigit() else 1
    return min(n, most) if n or name == "rowspan" else 1


def filled(rows: list[tuple[int, list[tuple[str, int, int]]]]) -> list[list[str]]:
    """The grid of rows (section, cells (text, rows, columns)). A cell that spans rows is carried down within its section; short rows end in empty cells."""
    grid, carried, section = [], {}, None
    for of, cells in rows:
        if of != section:
            carried, section = {}, of
        if not carried and all(deep == wide == 1 for _, deep, wide in cells):
            grid.append([text for text, _, _ in cells])
            continue
        row, down = {}, {}
        for at, (text, left) in carried.items():
            row[at] = text
            if left != 1:
                down[at] = (text, left - 1)
        at = 0
        for text, deep, wide in cells:
            while at in row:
                at += 1
            for column in range(at, at + wide):
                row.setdefault(column, text)
                if deep != 1:
                    down.setdefault(column, (text, deep - 1))
            at += wide
        carried = down
        grid.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
    width = max(map(len, grid), default=0)
    return [r + [""] * (width - len(r)) for r in grid]


class Reader(HTMLParser):
    """Collects the grids of all tables, in the order in which they open, and the text outside of tables. A table in a cell is a table of its own and no part of the cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.outside: list[str] = []
        self.unseen = 0

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "table":
            self.open.append({"rows": [], "section": 0, "row": None, "cell": None})
            self.tables.append(self.open[-1])
        elif self.open:
            t = self.open[-1]
            if tag in (*SECTIONS, "tr", "td", "th"):
                t["cell"] = None
            if tag in SECTIONS:
                t["section"], t["row"] = t["section"] + 1, None
            if tag == "tr" or (tag in ("td", "th") and t["row"] is None):
                t["row"] = []
                t["rows"].append((t["section"], t["row"]))
            if tag in ("td", "th"):
                a = dict(attrs)
                t["cell"] = [[], span(a, "rowspan", MOST_ROWS), span(a, "colspan", MOST_COLUMNS)]
                t["row"].append(t["cell"])
            elif t["cell"] is not None:
                t["cell"][0].append(" " if tag in ("br", "p", "div", "li") else "")
        else:
            self.outside.append("\n" if tag in ("br", "p", "div", "li", "h1", "h2", "h3") else "")

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif self.open:
            t = self.open[-1]
            if tag == "table":
                self.open.pop()
            elif tag in ("td", "th"):
                t["cell"] = None
            elif tag in ("tr", *SECTIONS):
                t["row"] = t["cell"] = None

    def handle_data(self, data):
        if self.unseen:
            return
        if not self.open:
            self.outside.append(data)
        elif self.open[-1]["cell"] is not None:
            self.open[-1]["cell"][0].append(data)


    def read(self, html: str) -> tuple[list[str], list[list]]:
        """(texts outside of tables, rows of each table) of a page."""
        self.feed(html)
        self.close()
        return self.outside, [t["rows"] for t in self.tables]


def read_plain(html: str) -> tuple[list[str], list[list]] | None:
    """What `Reader` reads, several times faster, of a page each of whose "<" begins a tag as TAG has it; None of other pages."""
    parts = TAG.split(html)
    if html.count("<") != len(parts) // 5:
        return None
    # of the innermost open table: its rows, section, open row, and the texts of its open cell; outside of tables, texts are those outside
    outside, tables, above, rows, section, row = [unescape(parts[0])], [], [], [], 0, None
    texts: list[str] | None = outside
    for closing, tag, attributes, alone, text in zip(parts[1::5], parts[2::5], parts[3::5], parts[4::5], parts[5::5], strict=True):
        kind = KINDS.get(tag) or KINDS.get(tag.lower())
        if kind == RAW or (closing and (attributes or alone)) or (alone and kind in (CELL, ROW, SECTION, TABLE)):
            return None
        if kind == TABLE:
            if not closing:
                above.append((rows, section, row, texts))
                rows, section, row, texts = [], 0, None, None
                tables.append(rows)
            elif above:
                rows, section, row, texts = above.pop()
        elif not above:
            if kind in (BREAK, HEAD) and not closing:
                outside.append("\n")
        elif kind == CELL:
            texts = None
            if not closing:
                if row is None:
                    row = []
                    rows.append((section, row))
                texts = []
                if attributes:
                    a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
                    row.append((texts, span(a, "rowspan", MOST_ROWS), span(a, "colspan", MOST_COLUMNS)))
                else:
                    row.append((texts, 1, 1))
        elif kind in (ROW, SECTION):
            texts = row = None
            if not closing and kind == ROW:
                row = []
                rows.append((section, row))
            elif not closing:
                section += 1
        elif kind == BREAK and not closing and texts is not None:
            texts.append(" ")
        if text and texts is not None:
            texts.append(unescape(text) if "&" in text else text)
    return outside, tables


def read_html(html: str) -> tuple[str, list[list[list[str]]]]:
    """(text outside of tables, grids) of a page; markup that is never closed ends with the page."""
    outside, found = read_plain(html) or Reader().read(html)
    grids = [filled([(s, [(" ".join("".join(c[0]).split()), c[1], c[2]) for c in cells]) for s, cells in rows]) for rows in found]
    return "\n".join(x for line in "".join(outside).split("\n") if (x := " ".join(line.split()))), grids


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_tables(html: pd.Series) -> pd.Series:
    """All tables of each page; none of a null page."""
    return html.map(lambda x: read_html(x)[1] if isinstance(x, str) else [])


# so that pages are read once: a filter on the tables, such as Spark adds below an explode of them, would else be pushed down and read all pages for itself
html_tables = html_tables.asNondeterministic()
