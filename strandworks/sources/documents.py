"""Grids of tables in documents: XML with spans, word-processor files and workbooks, as a table function.

A document gives a row (tbl, row, col, text) for each cell, rows and columns from 0. Tables of XML articles go
by the id of what wraps them, those of word-processor files by their number, sheets by their name in the file.
XML and sheets are streamed: what a table function holds is one row and the spans that reach into the next.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CELL = T.StructType([T.StructField("tbl", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("text", T.StringType())])
#: The namespaces of word-processor and workbook files.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def squeezed(node: ElementTree.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def span(cell: ElementTree.Element, name: str) -> int:
    n = int(cell.get(name, "1"))
    if n < 1:
        raise ValueError(f"{name} of {n}")
    return n


class Spans:
    """Places the cells of rows in turn: ``held`` are the columns that cells from above reach into."""

    def __init__(self):
        self.held: dict[int, tuple[int, str]] = {}

    def row(self, cells: list[tuple[str, int, int]]) -> dict[int, str]:
        """(text, rows, columns) of each cell of a row -> its text by column."""
        out = {c: text for c, (_, text) in self.held.items()}
        after = {c: (n - 1, text) for c, (n, text) in self.held.items() if n > 1}
        at = 0
        for text, down, across in cells:
            while at in out:
                at += 1
            for c in range(at, at + across):
                if c in out:
                    raise ValueError("spans overlap")
                out[c] = text
                if down > 1:
                    after[c] = (down - 1, text)
            at += across
        self.held = after
        return out


def xml_tables(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Cells of the tables that a table-wrap with an id holds; a table in a cell belongs to the cell's text."""
    wraps: list[str | None] = []
    depth, spans, at, cells = 0, Spans(), 0, []
    for event, node in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        tag = node.tag.rpartition("}")[2]
        if event == "start":
            if tag == "table-wrap":
                wraps.append(node.get("id"))
            elif tag == "table":
                depth += 1
                if depth == 1:
                    spans, at = Spans(), 0
            continue
        if tag == "table":
            depth -= 1
        if depth == 1 and wraps and wraps[-1] is not None:
            if tag in ("td", "th"):
                cells.append((squeezed(node), span(node, "rowspan"), span(node, "colspan")))
            elif tag == "tr":
                for col, text in sorted(spans.row(cells).items()):
                    yield wraps[-1], at, col, text
                at, cells = at + 1, []
                node.clear()
        if tag == "table-wrap":
            wraps.pop()
            node.clear()


def word_tables(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Physical cells: merged ones keep their places and may be empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    for k, table in enumerate(root.iter(f"{WORD}tbl")):
        for i, row in enumerate(table.findall(f"{WORD}tr")):
            for j, cell in enumerate(row.findall(f"{WORD}tc")):
                yield str(k), i, j, "".join(t.text or "" for t in cell.iter(f"{WORD}t"))


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Cells that hold a value; a formula's value is refused, since it was measured nowhere."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            with archive.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{SHEET}si":
                        shared.append(squeezed(node))
                        node.clear()
        for name in sorted(archive.namelist()):
            m = re.fullmatch(r"xl/worksheets/(sheet[1-9][0-9]*)\.xml", name)
            if not m:
                continue
            with archive.open(name) as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{SHEET}c":
                        if (inline := node.find(f"{SHEET}is")) is not None:
                            value = squeezed(inline)
                        elif (value := node.findtext(f"{SHEET}v")) is not None and node.get("t") == "s":
                            value = shared[int(value)]
                        if value is not None:
                            if node.find(f"{SHEET}f") is not None:
                                raise ValueError(f"{m[1]}!{node.get('r')} holds a formula")
                            place = re.fullmatch("([A-Z]+)([1-9][0-9]*)", node.get("r", ""))
                            if not place:
                                raise ValueError(f"{m[1]}: {node.get('r')!r} is no address")
                            yield m[1], int(place[2]) - 1, column_number(place[1]), value
                    elif node.tag == f"{SHEET}row":
                        node.clear()


READERS = {".xml": xml_tables, ".docx": word_tables, ".xlsx": sheets}


class DocumentGrid:
    """document_grid(name, content): the cells of a document, by its name's ending; a null document has none."""

    def eval(self, name: str, content: bytes):
        if name is None or content is None:
            return
        ending = name[name.rfind(".") :].lower()
        if ending not in READERS:
            raise ValueError(f"no reader of {ending!r} documents")
        yield from READERS[ending](bytes(content))


document_grid = F.udtf(DocumentGrid, returnType=CELL)


def grids(documents: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(name, content, ..) -> the rows' other columns, name, tbl, row, col, text."""
    return documents.lateralJoin(document_grid(F.col(name).outer(), F.col(content).outer())).drop(content)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, tbl, row, col, text) of all documents of a folder, a document a task at most."""
    return grids(spark.read.format("binaryFile").load(path).select("path", "content"))
