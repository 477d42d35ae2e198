"""Tables inside landed HTML pages. Reading the markup needs Python; it runs in
Arrow batches beside the scan, one page at a time, and each page comes back as
one row with all its tables. Which table is wanted is then decided page by page
with array expressions: nothing is shuffled and no page is read twice."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES_TYPE = (
    "array<struct<table_no:int,path:string,sibling_no:int,width:int,"
    "lines:array<struct<is_header:boolean,cells:array<string>>>>>"
)
ARROW_TABLES = pa.list_(
    pa.struct(
        {
            "table_no": pa.int32(),
            "path": pa.string(),
            "sibling_no": pa.int32(),
            "width": pa.int32(),
            "lines": pa.list_(
                pa.struct({"is_header": pa.bool_(), "cells": pa.list_(pa.string())})
            ),
        }
    )
)

# Pages, and about so many cells, handed back to the JVM at a time. Until then they are
# Python objects, of some hundred bytes a cell.
OUTPUT_PAGES = 500
OUTPUT_CELLS = 30_000

# HTML elements without an end tag, and start tags that end an
# open element of the named kinds.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
}
CLOSED_BY = {
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"td", "th", "tr"},
    "tbody": {"td", "th", "tr", "thead", "tbody"},
    "li": {"li"},
    "p": {"p"},
    "div": {"p"},
    "table": {"p"},
    "ul": {"p"},
    "ol": {"p"},
}
SCOPES = {"table", "tr", "td", "th", "ul", "ol", "div"}

# Elements whose content is no text.
UNREAD = {"script", "style"}

TABLE = re.compile("<table", re.IGNORECASE)


def html_tables(
    pages: DataFrame, key: str, html: str, partitions: int | None = None, widest: int = 10_000
) -> DataFrame:
    """The page key and the page's tables in document order. A table has its
    number in the page (from 1), the path from the nearest ancestor with an id,
    its number among its siblings, its width and its lines. Cells that span rows
    or columns are repeated in each place they cover; a cell that spans more than
    ``widest`` columns raises an error.

    ``partitions`` deals the pages out anew, for few large files: reading markup
    costs far more than moving it. Without it the scan decides (see
    spark.sql.files.maxPartitionBytes); spark.sql.execution.arrow.maxRecordsPerBatch
    and maxBytesPerBatch bound the markup that a worker holds at once, and OUTPUT_PAGES
    and OUTPUT_CELLS the tables, beside those of one page."""
    pages = pages.select(key, html)
    if partitions:
        pages = pages.repartition(partitions)
    key_type = pages.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for tables in _portions(batch.column(1), widest):
                keys = batch.column(0).slice(start, len(tables))
                start += len(tables)
                yield pa.RecordBatch.from_arrays([keys, tables], [key, "tables"])

    return pages.mapInArrow(extract, f"`{key}` {key_type}, tables {TABLES_TYPE}")


def _portions(texts: pa.Array, widest: int) -> Iterator[pa.Array]:
    """The tables of each page, of some pages at a time."""
    portion: list[list[dict]] = []
    cells = 0
    for text in texts:
        portion.append(tables := page_tables(text.as_py() or "", widest))
        cells += sum(table["width"] * len(table["lines"]) for table in tables)
        if len(portion) == OUTPUT_PAGES or cells >= OUTPUT_CELLS:
            yield pa.array(portion, ARROW_TABLES)
            portion, cells = [], 0
    if portion:
        yield pa.array(portion, ARROW_TABLES)


def first_table() -> Column:
    return F.try_element_at("tables", F.lit(1))


def table_at(path: str, sibling_no: int) -> Column:
    """The first table whose ancestors, from the nearest one with an id down,
    match ``path`` (such as ``main_content/div/div[1]``; a step without a number
    matches any) and that is the given one among its sibling tables."""
    root, *steps = path.split("/")
    parts = ["\\Q" + root + "\\E"]
    for step in steps:
        name, _, number = step.partition("[")
        parts.append(f"{name}\\[{number.rstrip(']') or '[0-9]+'}\\]")
    pattern = "^" + "/".join(parts) + "$"
    there = F.filter(
        "tables", lambda t: t["path"].rlike(pattern) & (t["sibling_no"] == sibling_no)
    )
    return F.try_element_at(there, F.lit(1))


def only_table_of_width(width: int) -> Column:
    """The table of that many columns, if the page has exactly one."""
    fitting = F.filter("tables", lambda t: t["width"] == width)
    return F.when(F.size(fitting) == 1, F.try_element_at(fitting, F.lit(1)))


def lines_of(tables: DataFrame, key: str, wanted: Column) -> DataFrame:
    """One row per line of the wanted table of each page: key, row_no, is_header,
    cells. Pages without it give none."""
    return (
        tables.select(key, wanted.alias("wanted"))
        .select(key, F.posexplode("wanted.lines").alias("at", "line"))
        .select(
            key,
            (F.col("at") + 1).alias("row_no"),
            F.col("line.is_header").alias("is_header"),
            F.col("line.cells").alias("cells"),
        )
    )


def all_lines(tables: DataFrame, key: str) -> DataFrame:
    """One row per line of every table of each page."""
    each = tables.select(key, F.explode("tables").alias("found"))
    return each.select(
        key,
        "found.table_no",
        "found.path",
        F.posexplode("found.lines").alias("at", "line"),
    ).select(
        key,
        "table_no",
        "path",
        (F.col("at") + 1).alias("row_no"),
        F.col("line.is_header").alias("is_header"),
        F.col("line.cells").alias("cells"),
    )


def body_lines(lines: DataFrame) -> DataFrame:
    """Without a leading line of header cells."""
    return lines.filter(~((F.col("row_no") == 1) & F.col("is_header")))


def cell(index: int) -> Column:
    """The index-th cell of a line (from 1), null past its end."""
    return F.try_element_at("cells", F.lit(index))


def named_lines(
    tables: DataFrame, key: str, chosen: Column, wanted: list[str], width: int
) -> DataFrame:
    """Lines of a table whose second line holds the column names, in any case and
    order; the first line is its header. The wanted ones among the first
    ``width`` columns are kept, for the lines after that."""
    lines = tables.select(key, chosen["lines"].alias("lines"))
    names = F.transform(
        F.slice(F.try_element_at("lines", F.lit(2))["cells"], 1, width), lambda n: F.lower(n)
    )
    rows = lines.select(key, names.alias("names"), F.posexplode("lines").alias("at", "line"))
    picked = [
        F.try_element_at(
            F.col("line.cells"), F.nullif(F.array_position("names", F.lit(n)).cast("int"), F.lit(0))
        ).alias(n)
        for n in wanted
    ]
    return rows.filter(F.col("at") >= 2).select(key, *picked)


def page_tables(html: str, widest: int = 10_000) -> list[dict]:
    """All tables of one page."""
    if not TABLE.search(html):
        return []
    page = _Page(widest)
    page.feed(html)
    page.close()
    return [page.finished(number, table) for number, table in enumerate(page.tables, start=1)]


class _Page(HTMLParser):
    """What is open at the current place of a page."""

    def __init__(self, widest: int) -> None:
        super().__init__(convert_charrefs=True)
        self.widest = widest
        self.open: list[dict] = [_element("", None, 1)]
        self.tables: list[dict] = []
        self.inside: list[dict] = []

    def handle_data(self, data: str) -> None:
        cell = self.inside[-1]["cell"] if self.inside else None
        if cell is not None and self.open[-1]["tag"] not in UNREAD:
            cell["text"].append(data)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = dict(attrs) if attrs else {}
        if tag in CLOSED_BY:
            self._close_before(tag)
        children = self.open[-1]["children"]
        nth = children[tag] = children.get(tag, 0) + 1 if children else 1
        if tag == "table":
            self._start_table(nth)
        elif self.inside and tag == "tr":
            self.inside[-1]["rows"].append([])
        elif self.inside and tag in ("td", "th"):
            self._start_cell(tag, attributes)
        elif tag == "br":
            self.handle_data("\n")
        if tag not in VOID:
            self.open.append(_element(tag, attributes.get("id"), nth))

    def handle_endtag(self, tag: str) -> None:
        depth = len(self.open) - 1
        while depth:
            kind = self.open[depth]["tag"]
            if kind == tag:
                self._close_to(depth)
                return
            if kind == "table":
                return
            depth -= 1

    def finished(self, number: int, table: dict) -> dict:
        lines = [{"is_header": head, "cells": cells} for head, cells in _spread(table["rows"])]
        return {
            "table_no": number,
            "path": table["path"],
            "sibling_no": table["nth"],
            "width": max((len(line["cells"]) for line in lines), default=0),
            "lines": lines,
        }

    def _close_before(self, tag: str) -> None:
        ends = CLOSED_BY[tag]
        depth = len(self.open) - 1
        while depth:
            kind = self.open[depth]["tag"]
            if kind in ends:
                self._close_to(depth)
                if tag not in ("tr", "tbody"):
                    return
            elif kind in SCOPES:
                return
            depth -= 1

    def _close_to(self, depth: int) -> None:
        for element in self.open[depth:]:
            tag = element["tag"]
            if tag == "table" and self.inside:
                self.inside.pop()
            elif (tag == "td" or tag == "th") and self.inside:
                self.inside[-1]["cell"] = None
        del self.open[depth:]

    def _start_table(self, sibling_no: int) -> None:
        path: list[str] = []
        for element in reversed(self.open[1:]):
            if element["id"]:
                path.append(element["id"])
                break
            path.append(f"{element['tag']}[{element['nth']}]")
        table = {"path": "/".join(reversed(path)), "nth": sibling_no, "rows": [], "cell": None}
        self.tables.append(table)
        self.inside.append(table)

    def _start_cell(self, tag: str, attributes: dict[str, str | None]) -> None:
        table = self.inside[-1]
        if not table["rows"]:
            table["rows"].append([])
        table["cell"] = {
            "head": tag == "th",
            "text": [],
            "wide": self._width(attributes.get("colspan")) if attributes else 1,
            "deep": _span(attributes.get("rowspan")) if attributes else 1,
        }
        table["rows"][-1].append(table["cell"])

    def _width(self, value: str | None) -> int:
        width = _span(value)
        if width > self.widest:
            raise ValueError(f"a cell spans {width} columns; the limit is {self.widest}")
        return width


def _spread(rows: list[list[dict]]) -> Iterator[tuple[bool, list[str]]]:
    """Repeat spanning cells in every place they cover."""
    below: dict[int, tuple[int, str]] = {}
    for row in rows:
        texts: list[str] = []
        waiting = iter(row)
        item = next(waiting, None)
        while item is not None or len(texts) in below:
            at = len(texts)
            if at in below:
                left, text = below.pop(at)
                if left > 1:
                    below[at] = (left - 1, text)
                texts.append(text)
                continue
            text = "".join(item["text"]).strip()
            if item["deep"] > 1:
                below.update((place, (item["deep"] - 1, text)) for place in range(at, at + item["wide"]))
            texts += [text] * item["wide"]
            item = next(waiting, None)
        if texts:
            yield bool(row) and all([item["head"] for item in row]), texts


def _element(tag: str, id_: str | None, nth: int) -> dict:
    return {"tag": tag, "id": id_, "nth": nth, "children": {}}


def _span(value: str | None) -> int:
    """A span that is no number is 1. Rows beyond the table's last are never made."""
    return max(int(value), 1) if value and value.isdecimal() else 1
