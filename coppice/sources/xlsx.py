"""Workbooks: a zip of XML, read as it is parsed and written in one pass.

A sheet is one compressed stream, so one task reads it and yields batches of rows.
The file comes through Spark's own reader.  The old binary format isn't read.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
BATCH_ROWS = 5_000
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


class WorkbookError(ValueError):
    """A workbook that can't be read or written."""


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole file through Spark's own reader, wherever the path leads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def open_book(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise WorkbookError("not an xlsx workbook") from error


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names in workbook order, with the part that holds each."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): "xl/" + links[s.get(LINK)].removeprefix("/xl/").removeprefix("xl/") for s in sheets}


def sheet_names(data: bytes) -> list[str]:
    return list(sheet_parts(open_book(data)))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def plain_number(text: str) -> str:
    """A stored number without a trailing ``.0``, and never in exponent form where it is whole."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)


def cell_text(cell: ElementTree.Element, strings: list[str]) -> str:
    """A cell as a string: shared and inline strings, numbers, booleans, errors, ISO dates as stored."""
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    text = (value.text or "") if value is not None else ""
    if not text:
        return ""
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    return plain_number(text) if kind == "n" else text


def sheet_rows(data: bytes, sheet: str) -> Iterator[list[str]]:
    """Rows of a sheet from the first that has cells; gaps are empty cells, missing rows are empty rows."""
    book = open_book(data)
    parts = sheet_parts(book)
    if sheet not in parts:
        raise WorkbookError(f"no such worksheet: {sheet}")
    strings, expected = shared_strings(book), None
    with book.open(parts[sheet]) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{MAIN}row":
                continue
            number = int(row.get("r", expected or 1))
            cells: list[str] = []
            for cell in row.iter(f"{MAIN}c"):
                at = column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                cells[at] = cell_text(cell, strings)
            row.clear()
            if expected is None and not cells:
                continue
            for _ in range(number - (expected or number)):
                yield []
            expected = number + 1
            yield cells


def filled_rows(data: bytes, sheet: str) -> Iterator[list[str]]:
    """Rows from the first that holds a value."""
    return itertools.dropwhile(lambda cells: not any(cells), sheet_rows(data, sheet))


def header_of(spark: SparkSession, path: str, sheet: str) -> tuple[list[str], int]:
    """The header over all columns from the first to the last that holds a value in any row, and that first column."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                header, first, end = None, MOST_COLUMNS, 0
                for cells in filled_rows(data, sheet):
                    header = cells if header is None else header
                    held = [i for i, c in enumerate(cells) if c]
                    if held:
                        first, end = min(first, held[0]), max(end, held[-1] + 1)
                header = [*(header or []), *[""] * (end - len(header or []))]
                found = [header[first:end]] if end else [[]]
                arrays = [pa.array(found, pa.list_(pa.string())), pa.array([first if end else 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["header", "first"])

    content = spark.read.format("binaryFile").load(path).select("content")
    header, first = content.mapInArrow(find, "header array<string>, first long").first()
    return header, first


def read_sheet(spark: SparkSession, path: str, sheet: str, first: int, width: int) -> DataFrame:
    """Rows (row_index, c0...) after the header: ``width`` cells from column ``first`` on, empty where there are none."""
    names = ["row_index", *[f"c{i}" for i in range(width)]]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = enumerate(filled_rows(data, sheet), -1)
                next(rows, None)
                while part := list(itertools.islice(rows, BATCH_ROWS)):
                    cells = [[c[i] if i < len(c) else "" for _, c in part] for i in range(first, first + width)]
                    arrays = [pa.array([i for i, _ in part], pa.int64()), *(pa.array(c, pa.string()) for c in cells)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join(["row_index long", *[f"{c} string" for c in names[1:]]])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(path: str, headers: list[str], rows: Iterable[Iterable], sheet: str = "Sheet1") -> int:
    """Write one sheet, streaming rows; strings as inline strings, numbers as numbers. Returns the rows written."""
    fixed = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
        f'<sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }

    def xml_row(number: int, values: Iterable) -> str:
        cells = []
        for i, value in enumerate(values):
            at = f"{column_letters(i)}{number}"
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                cells.append(f'<c r="{at}"><v>{value}</v></c>')
            else:
                text = escape(CONTROL.sub("", "" if value is None else str(value)))
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        return f'<row r="{number}">{"".join(cells)}</row>'

    written = 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in fixed.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            out.write(xml_row(1, headers).encode())
            for written, values in enumerate(rows, 1):
                if written >= MOST_ROWS:
                    raise WorkbookError("more rows than a worksheet holds; write CSV or Parquet instead")
                out.write(xml_row(written + 1, values).encode())
            out.write(b"</sheetData></worksheet>")
    return written
