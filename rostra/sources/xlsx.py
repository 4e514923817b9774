"""SRC-1/2/7, FLT-16, JOIN-4: workbooks, on the standard library alone.

    files = workbook_files(spark, "/data")        # path and content, through Spark's file systems
    book = read_workbooks(files)                  # cells of all sheets, and what can't be read
    records = to_records(standard_rows(book))     # standardize.py

First sheet, first row as header. Every cell comes out as text with its kind: numbers without a needless ".0", date cells as
"yyyy-MM-dd HH:mm:ss", booleans as True/False, missing markers (fixed values below) as null. Listing, reading and parsing are
distributed; the driver opens no workbook. A file that can't be read is one error row and stops nothing.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.schema import ALIASES

# Texts that a spreadsheet reader takes for missing cells.
MISSING = set(
    ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BUILTIN_DATES = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node) -> str:
    """All text runs below a node, phonetic hints left out."""
    if node.tag == _MAIN + "rPh":
        return ""
    return (node.text or "" if node.tag == _MAIN + "t" else "") + "".join(map(_text, node))


class Workbook:
    """Rows of the first sheet of a workbook, read as a stream."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        sheet = book.find(f"{_MAIN}sheets/{_MAIN}sheet")
        rels = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == sheet.get(f"{_REL}id"))
        self.sheet = target.lstrip("/") if target.startswith("/") else "xl/" + target
        properties = book.find(f"{_MAIN}workbookPr")
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
        shared = "xl/sharedStrings.xml"
        self.strings = [_text(s) for s in ElementTree.fromstring(self.zip.read(shared))] if shared in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {}
        for f in styles.iter(_MAIN + "numFmt"):
            bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
            own[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", bare, re.IGNORECASE)) and "general" not in bare.lower()
        cells = styles.find(_MAIN + "cellXfs")
        kinds = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
        return {i for i, k in enumerate(kinds) if own.get(k, k in _BUILTIN_DATES)}

    def _value(self, cell) -> tuple[str, str] | None:
        """(kind, text) of a cell: int, float, bool, date or str; null for a missing one."""
        kind, v = cell.get("t", "n"), cell.find(_MAIN + "v")
        if kind == "inlineStr":
            return "str", "".join(map(_text, cell.findall(_MAIN + "is")))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return "str", self.strings[int(v.text)]
        if kind == "b":
            return "bool", "True" if v.text == "1" else "False"
        if kind != "n":
            return "str", v.text
        number = float(v.text)
        if int(cell.get("s", 0)) in self.dates:
            return "date", str((self.epoch + timedelta(days=number)).replace(microsecond=0))
        return ("int", str(int(number))) if number.is_integer() and abs(number) < 1e15 else ("float", repr(number))

    def rows(self) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
        """(row number, column index to kind and text of the cells that aren't missing); rows without any are skipped."""
        with self.zip.open(self.sheet) as f:
            number = 0
            for _, node in ElementTree.iterparse(f):
                if node.tag != _MAIN + "row":
                    continue
                number = int(node.get("r", number + 1))
                cells, at = {}, -1
                for cell in node.findall(_MAIN + "c"):
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    value = self._value(cell)
                    if value is not None and value[1] not in MISSING:
                        cells[at] = value
                node.clear()
                if cells:
                    yield number, cells


def column_names(header: dict[int, tuple[str, str]]) -> list[str]:
    """The names of the columns: one without a name gets that of its position, one whose name is taken a number behind it."""
    names: list[str] = []
    for i in range(max(header) + 1):
        name = bare = header[i][1] if i in header else f"Unnamed: {i}"
        n = 0
        while name in names:
            n += 1
            name = f"{bare}.{n}"
        names.append(name)
    return names


_CELLS = "array<struct<column:string,kind:string,value:string>>"
BOOK_SCHEMA = f"source_file string, part string, row_index int, cells {_CELLS}, error string"
_ARROW = pa.schema([
    ("source_file", pa.string()), ("part", pa.string()), ("row_index", pa.int32()),
    ("cells", pa.list_(pa.struct([("column", pa.string()), ("kind", pa.string()), ("value", pa.string())]))), ("error", pa.string()),
])
_BUFFERED_BYTES = 8_000_000  # larger files are parsed twice, rather than their rows held until the last one is known to be good
_ROWS = 2_000  # rows of a batch


def _sheet(name: str, content: bytes) -> Iterator[tuple]:
    columns: list[str] | None = None
    for number, cells in Workbook(content).rows():
        if columns is None:
            columns = column_names(cells)
            yield name, "header", number, [{"column": c, "kind": None, "value": None} for c in columns], None
        else:
            known = [(c, *cells.get(i, (None, None))) for i, c in enumerate(columns)]
            yield name, "row", number, [{"column": c, "kind": k, "value": v} for c, k, v in known], None


def _whole_sheet(name: str, content: bytes | None) -> Iterator[tuple]:
    """The rows of a file, or a single error row: nothing comes of a file that is damaged further down."""
    try:
        if content is None:
            raise ValueError("no content")
        if len(content) <= _BUFFERED_BYTES:
            rows = iter(list(_sheet(name, content)))
        else:
            for _ in _sheet(name, content):
                pass
            rows = _sheet(name, content)
    except Exception as e:  # noqa: BLE001 - whatever is wrong with one file, the others are read
        yield name, "error", None, None, f"{type(e).__name__}: {e}"[:500]
        return
    yield from rows


def workbook_files(spark: SparkSession, path: str, pattern: str = "*.{xlsx,XLSX}") -> DataFrame:
    """SRC-1: (path, content) of the workbooks of a folder, on any file system that Spark reads. Files of no bytes have no row in
    Spark's file scans and so are not listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def file_name(path: Column) -> Column:
    return F.try_url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def workbook_digests(files: DataFrame) -> DataFrame:
    """SRC-7, JOIN-4: (name, digest) of workbooks of either kind (pattern "*.{xls,xlsx}"): the MD5 of the bytes, which
    ingest.file_changes compares."""
    return files.select(file_name(F.col("path")).alias("name"), F.md5("content").alias("digest"))


def read_workbooks(files: DataFrame) -> DataFrame:
    """SRC-2, FLT-16: (source_file, part, row_index, cells, error) of workbooks (path, content), in no particular order.

    part: header (once a file that has any row: the columns in their order, without values), row (every cell of the header's
    columns, in their order, null if missing), or error (the file can't be read: damaged, empty, of the older binary
    format; nothing else comes of it). row_index is the sheet's row number. Rows without any value are left out. No shuffle;
    a task holds the files of one partition at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                for row in _whole_sheet(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    held.append(row)
                    if len(held) == _ROWS:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in held], _ARROW)
                        held = []
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in held], _ARROW)

    return files.select(file_name(F.col("path")).alias("name"), F.col("content").cast("binary").alias("content")).mapInArrow(run, BOOK_SCHEMA)


def standard_rows(book: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """PRJ-1/2: (source_file, row_index, standard fields) of the rows of workbooks, whatever columns each of them has: of each field
    the first alias among the columns of the row's sheet, also where its cell is missing."""
    rows = book.filter("part = 'row'").select("source_file", "row_index", F.col("cells.column").alias("_c"), F.col("cells.value").alias("_v"))

    def value(names: list[str]) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("_c", n), F.lit(0)) for n in names])
        return F.try_element_at("_v", at.cast("int"))

    return rows.select("source_file", "row_index", *[value(names).alias(f) for f, names in aliases.items()])


def failed_files(book: DataFrame) -> DataFrame:
    """FLT-16: (source_file, error) of the files that can't be read."""
    return book.filter("part = 'error'").select("source_file", "error")


def workbook_bytes(columns: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet: a header and rows of texts, numbers, booleans and missing cells."""

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        text = re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", str(v))  # what XML can't hold
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'

    sheet = "".join(f'<row r="{i}">{"".join(map(cell, r))}</row>' for i, r in enumerate([columns, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()
