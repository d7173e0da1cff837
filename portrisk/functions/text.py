"""Text, elements and tables of HTML held in a column.

HTML nests, leaves out end tags and names hundreds of entities, which built-in string
functions can't follow, so a page is read by the standard library's parser inside an
Arrow UDF: one small state machine a page, spread by Spark like any other column
expression, in batch and in streams.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ColumnOrName, _c

# Fixed values of HTML: elements without content, elements whose text is not page text,
# and for table parts the open elements that a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(("script", "style", "template"))
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
        "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot")}
_SPACE = re.compile(r"[\r\n]+|\s{2,}")
#: A start tag without attributes, of an element whose content is markup.
_BARE = re.compile(r"<(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)>)([a-z][a-z0-9]*)>")

#: A cell without attributes, markup or references, to its end tag or to the cell or row that ends it.
_PLAIN = re.compile(r"<td>([^<&]*)(?:</td>|(?=<t[dr]>))")


class _Reader(HTMLParser):
    """Open elements of a page; an end tag closes up to the last open one of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []

    def read(self, page: str | None):
        if page:
            self.feed(page)
            self.close()
        while self.open:
            self._pop()
        return self

    def updatepos(self, i: int, j: int) -> int:
        return j  # nothing asks for line numbers

    def parse_starttag(self, i: int) -> int:
        if (bare := _BARE.match(self.rawdata, i)) is None:
            return super().parse_starttag(i)
        self.lasttag = bare[1]
        self.handle_starttag(bare[1], [])
        return bare.end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open.append(tag)
        self.started(tag, dict(attrs))
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open.append(tag)
        self.started(tag, dict(attrs))
        self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag = self.open.pop()
        self.ended(tag)
        return tag

    def handle_data(self, data: str) -> None:
        if NO_TEXT.isdisjoint(self.open):
            self.text(data)

    def started(self, tag: str, attrs: dict[str, str | None]) -> None: ...

    def ended(self, tag: str) -> None: ...

    def text(self, data: str) -> None: ...


class _Text(_Reader):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def text(self, data: str) -> None:
        self.parts.append(data)


class _Elements(_Reader):
    """Texts of the elements with a tag (and class), nested ones too, by their start tags."""

    def __init__(self, tag: str, cls: str | None) -> None:
        super().__init__()
        self.tag, self.cls = tag, cls
        self.found: list[list[str]] = []
        self.inside: list[tuple[int, list[str]]] = []  # depth and text of each open match

    def started(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag == self.tag and (self.cls is None or self.cls in (attrs.get("class") or "").split()):
            self.found.append([])
            self.inside.append((len(self.open), self.found[-1]))

    def ended(self, tag: str) -> None:
        if self.inside and self.inside[-1][0] > len(self.open):
            self.inside.pop()

    def text(self, data: str) -> None:
        for _, parts in self.inside:
            parts.append(data)


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[bool, str, int, int]]] = []  # header?, text, colspan, rowspan
        self.heads = 0  # rows inside thead
        self.cell: list[str] | None = None
        self.kind = (False, 1, 1)


class _Tables(_Reader):
    """Rows and cells of all tables; a nested table is part of the text of its cell."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[_Table] = []
        self.stack: list[tuple[int, _Table]] = []  # open tables with their depth

    def parse_starttag(self, i: int) -> int:
        if self.open and self.open[-1] == "tr" and len(self.stack) == 1 and (cell := _PLAIN.match(self.rawdata, i)):
            table = self.stack[0][1]
            if table.cell is None and NO_TEXT.isdisjoint(self.open):  # a run of cells that open and close nothing else
                self.lasttag = "td"
                while cell:
                    table.rows[-1].append((False, _SPACE.sub(" ", cell[1]).strip(), 1, 1))
                    i = cell.end()
                    cell = _PLAIN.match(self.rawdata, i)
                return i
        return super().parse_starttag(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack and (ends := ENDS.get(tag)):
            for k in range(self.stack[-1][0], len(self.open)):  # implied end tags, inside the innermost table
                if self.open[k] in ends:
                    while len(self.open) > k:
                        self._pop()
                    break
        super().handle_starttag(tag, attrs)

    def started(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag == "table":
            self.tables.append(_Table())
            self.stack.append((len(self.open), self.tables[-1]))
        elif self.stack:
            depth, table = self.stack[-1]
            if tag == "tr":
                table.rows.append([])
                table.heads += "thead" in self.open[depth:]
            elif tag in ("td", "th") and table.cell is None:
                if not table.rows:
                    table.rows.append([])
                span = lambda k: int(v) if (v := (attrs.get(k) or "").strip()).isdecimal() and int(v) > 0 else 1
                table.cell, table.kind = [], (tag == "th", *((span("colspan"), span("rowspan")) if attrs else (1, 1)))

    def ended(self, tag: str) -> None:
        if not self.stack:
            return
        depth, table = self.stack[-1]
        if tag in ("td", "th") and table.cell is not None:
            text = _SPACE.sub(" ", "".join(table.cell)).strip()
            table.rows[-1].append((table.kind[0], text, table.kind[1], table.kind[2]))
            table.cell = None
        elif tag == "table" and depth > len(self.open):
            self.stack.pop()

    def text(self, data: str) -> None:
        for _, table in self.stack:
            if table.cell is not None:
                table.cell.append(data)


def _grid(table: _Table) -> tuple[list[str], list[list[str]]]:
    """Header texts and data rows, spans written out; a row without cells is none."""
    below: dict[int, tuple[str, bool, int]] = {}  # column -> cell that reaches into later rows
    grid: list[list[tuple[str, bool]]] = []
    heads = 0
    for at, row in enumerate(table.rows):
        if row and not below and all(cols == 1 == down for _, _, cols, down in row):
            grid.append([(text, th) for th, text, _, _ in row])
            heads += at < table.heads
            continue
        out: list[tuple[str, bool]] = []
        cells = iter(row)
        while True:
            if (held := below.get(len(out))) is not None:
                text, th, rest = held
                if rest > 1:
                    below[len(out)] = (text, th, rest - 1)
                else:
                    del below[len(out)]
                out.append((text, th))
                continue
            cell = next(cells, None)
            if cell is None:
                if any(c > len(out) for c in below):  # a span further right: fill the gap
                    out.append(("", False))
                    continue
                break
            th, text, cols, down = cell
            for _ in range(cols):
                if down > 1:
                    below[len(out)] = (text, th, down - 1)
                out.append((text, th))
        if out:
            grid.append(out)
            heads += at < table.heads
    if not table.heads:
        while heads < len(grid) and all(th for _, th in grid[heads]):
            heads += 1
    width = max((len(r) for r in grid), default=0)
    if heads:
        levels = [[t for t, _ in r] + [""] * (width - len(r)) for r in grid[:heads]]
        header = [" ".join(c).strip() for c in zip(*levels)]
    else:
        header = [str(k) for k in range(width)]
    return header, [[t for t, _ in r] for r in grid[heads:]]


def read_text(page: str | None, sep: str = "") -> str:
    return sep.join(_Text().read(page).parts)


def read_elements(page: str | None, tag: str, cls: str | None = None) -> list[str]:
    return ["".join(p) for p in _Elements(tag, cls).read(page).found]


def read_table(page: str | None, index: int = 0) -> tuple[list[str], list[list[str]]] | None:
    """(header, data rows) of the ``index``-th table by start tags, or None."""
    tables = _Tables().read(page).tables
    return _grid(tables[index]) if index < len(tables) else None


def page_text(html: ColumnOrName, sep: str = "", lower: bool = False) -> Column:
    """Visible text of a page, text nodes joined by ``sep``.

    The title is text; scripts, styles, templates, comments and declarations are not.
    Entities are decoded once; a reference to no character becomes U+FFFD.  NULL stays NULL.
    """
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else read_text(p, sep))
    out = text(_c(html))
    return F.lower(out) if lower else out


def elements(html: ColumnOrName, tag: str, cls: str | None = None) -> Column:
    """Texts of the elements with this tag, and this class if given, in document order."""
    @F.pandas_udf("array<string>")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: read_elements(p, tag, cls))
    return found(_c(html))


def table(html: ColumnOrName, index: int = 0) -> Column:
    """struct(header array<string>, rows array<array<string>>) of a page's table, or NULL.

    Header rows are those of ``<thead>``, else the leading rows of ``<th>`` only; their texts
    are joined by a space per column.  Without header rows the columns are numbered.
    """
    @F.pandas_udf("header array<string>, rows array<array<string>>")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        got = [read_table(p, index) or (None, None) for p in pages]
        return pd.DataFrame(got, columns=["header", "rows"])
    return parsed(_c(html))
