"""Spreadsheet statements: the first sheet of each workbook as rows of cells.

A workbook is a zip of XML parts and is read whole by the task that has it; workbooks are spread over tasks.  What the exports of one
program have in common, their styles and names, is parsed once for neighbours that are equal in it.
"""

from __future__ import annotations

import datetime
import functools
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans import views
from tallyforge.plans.catalog import query
from tallyforge.sources.statements import HEADERS, read_sheets

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # of the formats that need no definition
_EPOCH = datetime.date(1899, 12, 30)
_SHEET_HEADERS = {k: v for k, v in HEADERS.items() if k != "remittance"}


#: Rows of a sheet that go on together, and rows of sheets in a batch.
_PART, _BATCH = 1000, 5000


def _tag(name: str) -> str:
    return f"{{{_NS['m']}}}{name}"


_DATA, _ROW, _CELL, _VALUE, _TEXT = map(_tag, ("sheetData", "row", "c", "v", "t"))


#: A part's row in an archive's directory, its own head, and the directory's end.
_LISTED, _HEAD, _END = "<4s4B4H3L5H2L", "<4s2B4H3L2H", "<4s4H2LH"
_LISTED_SIZE, _HEAD_SIZE, _END_SIZE = map(struct.calcsize, (_LISTED, _HEAD, _END))


class _Archive:
    """The parts of a zip by name.  A plain archive's are taken from its bytes, all else, and what is not as it should be, is left to ``zipfile`` and its errors."""

    def __init__(self, content: bytes):
        self.content, self.book = content, None
        self.parts = self._listed()
        if self.parts is None:
            self.book = zipfile.ZipFile(io.BytesIO(content))
            self.parts = dict.fromkeys(self.book.NameToInfo)

    def _listed(self) -> dict[str, tuple] | None:
        """What is needed of each part, if all stand one after the other before a directory that ends the archive."""
        content = self.content
        if len(content) < _END_SIZE:
            return None
        sign, *disks, n, size, at, comment = struct.unpack_from(_END, content, len(content) - _END_SIZE)
        end = len(content) - _END_SIZE
        if sign != b"PK\5\6" or disks != [0, 0, n] or comment or at + size != end:
            return None
        rows, free = [], 0
        while at < end:
            if end - at < _LISTED_SIZE:
                return None
            sign, _, _, version, _, flags, method, _, _, crc, packed, whole, long, *more, _, _, start = struct.unpack_from(_LISTED, content, at)
            name = content[at + _LISTED_SIZE : at + _LISTED_SIZE + long]
            if sign != b"PK\1\2" or version > 20 or flags & ~0x80E or method not in (0, 8) or more != [0, 0, 0] or not name.isascii() or b"\0" in name or start < free:
                return None
            free = start + _HEAD_SIZE + long + packed
            rows.append((name, method, crc, packed, whole, start))
            at += _LISTED_SIZE + long
        if at != end or free > end - size or len(rows) != n:
            return None
        return {x[0].decode(): x for x in rows}

    def read(self, name: str) -> bytes | None:
        if name not in self.parts:
            return None
        if self.book is None:
            if (data := self._taken(*self.parts[name])) is not None:
                return data
            self.book = zipfile.ZipFile(io.BytesIO(self.content))
        return self.book.read(name)

    def _taken(self, name: bytes, method: int, crc: int, packed: int, whole: int, start: int) -> bytes | None:
        sign, _, _, flags, *_, long, extra = struct.unpack_from(_HEAD, self.content, start)
        at = start + _HEAD_SIZE
        if sign != b"PK\3\4" or flags & ~0x80E or extra or self.content[at : at + long] != name:
            return None
        data = self.content[at + long : at + long + packed]
        if method:
            try:
                data = zlib.decompressobj(-15).decompress(data, whole + 1)
            except zlib.error:
                return None
        return data if len(data) == whole and zlib.crc32(data) == crc else None


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(_TEXT))


@functools.lru_cache(4)
def _strings(part: bytes | None) -> list[str]:
    return [] if part is None else [_text(x) for x in ElementTree.fromstring(part).iterfind("m:si", _NS)]


@functools.lru_cache(4)
def _date_styles(part: bytes | None) -> frozenset[int]:
    """Numbers of the cell styles that show a date."""
    if part is None:
        return frozenset()
    styles = ElementTree.fromstring(part)
    own = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", _NS) if re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    return frozenset(i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own)


@functools.lru_cache(4)
def _sheet_names(order: bytes | None, related: bytes | None) -> list[str]:
    """The parts of the sheets in the workbook's order, by their relationships."""
    if order is None or related is None:
        return []
    targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(related)}
    found = [targets.get(x.get(_RELATION), "") for x in ElementTree.fromstring(order).iterfind("m:sheets/m:sheet", _NS)]
    return [x[1:] if x.startswith("/") else f"xl/{x}" for x in found if x]


def _first_sheet_part(book: _Archive) -> str | None:
    """The part of the first sheet in the workbook's order; where its relationships lead nowhere, the sheet file of the smallest number."""
    for name in _sheet_names(book.read("xl/workbook.xml"), book.read("xl/_rels/workbook.xml.rels")):
        if name in book.parts:
            return name
    names = [x for x in book.parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)]
    return min(names, key=lambda x: int(re.search(r"\d+", x)[0]), default=None)


@functools.lru_cache(1 << 14)
def _column(place: str) -> int:
    """The number of the column of a cell's place, from 1; 0 without letters."""
    at = 0
    for letter in _LETTERS.match(place)[0]:
        at = at * 26 + ord(letter) - 64
    return at


@functools.lru_cache(4096)
def _day(number: int) -> str:
    return str(_EPOCH + datetime.timedelta(days=number))


_LETTERS = re.compile("[A-Z]*")


def first_sheet(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as text: dates in ISO form, whole numbers without a point."""
    book = _Archive(content)
    strings = _strings(book.read("xl/sharedStrings.xml"))
    dates = _date_styles(book.read("xl/styles.xml"))
    name = _first_sheet_part(book)
    sheet = ElementTree.fromstring(book.read(name)) if name else ()
    rows = []
    for row in (x for data in sheet if data.tag == _DATA for x in data if x.tag == _ROW):
        cells: list[str] = []
        for c in row:
            if c.tag != _CELL:
                continue
            at = _column(c.get("r", ""))
            cells += [""] * ((at or len(cells) + 1) - len(cells))
            kind = c.get("t", "n")
            value = _text(c) if kind == "inlineStr" else c.findtext(_VALUE, "")
            if kind == "s":
                value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
            elif kind == "n" and value:
                number = float(value)
                value = _day(int(number)) if int(c.get("s", 0)) in dates else str(int(number)) if number.is_integer() else repr(number)
            cells[-1] = value.strip()
        if any(cells):
            rows.append(cells)
    return rows


def parse_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions of workbooks (``path``, ``content``), and a row on each one's success; one that can't be read, or has no rows, has a row that says so."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("names", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("problem", pa.string())])

    def parts(file: str, content: bytes | None) -> Iterator[tuple]:
        try:
            rows = first_sheet(content or b"")
            unread = None if rows else "The workbook has no rows"
        except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError):
            rows, unread = [], "Could not read the workbook"
        for at in range(1, max(len(rows), 2), _PART):
            yield file, at, rows[0] if rows else None, rows[at : at + _PART], unread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                for part in parts(file.as_py(), content.as_py()):
                    made.append(part)
                    n += 1 + len(part[3])
                    if n >= _BATCH:
                        yield packed()
                        made, n = [], 0
        if made:
            yield packed()

    rows = files.select("path", "content").mapInArrow(run, "file string, at long, names array<string>, rows array<array<string>>, problem string")
    return read_sheets(rows, _SHEET_HEADERS)


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_workbooks`` of all files below ``path`` that are named as workbooks; those of the old binary format can't be read."""
    return parse_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xls,xlsx}").load(path))


_MAIN, _REL = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def written_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` and ``content`` of a workbook for each statement: its rows in the sheet that comes first but whose file has not the smallest number; every fiftieth is torn."""
    rows = views.transactions(spark, sf_dir, "id", "statement_id", "booking_date", "amount_cents", "description")
    cell = lambda letter, at, more, inner: F.concat(F.lit(f'<c r="{letter}'), at, F.lit(f'"{more}>'), inner, F.lit("</c>"))
    value = lambda c: F.concat(F.lit("<v>"), c, F.lit("</v>"))
    texts = rows.select("statement_id", F.struct("id", "booking_date", "amount_cents", "description").alias("x"))

    def row(x: Column, i: Column) -> Column:
        at = (i + 2).cast("string")
        return F.concat(
            F.lit("<row>"), cell("A", at, ' s="1"', value(F.datediff(x["booking_date"], F.lit("1899-12-30")))), cell("B", at, "", value((x["amount_cents"] / 100).cast("decimal(18,2)"))),
            cell("D", at, ' t="inlineStr"', F.concat(F.lit("<is><t>"), x["description"], F.lit("</t></is>"))), F.lit("</row>"),
        )

    sheets = texts.groupBy("statement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), row), "").alias("xml"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>77</v></c><c r="D1" t="s"><v>2</v></c></row>'
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:  # what all have in common
            z.writestr("xl/workbook.xml", f'<workbook {_MAIN} {_REL}><sheets><sheet name="a" sheetId="1" r:id="rId9"/><sheet name="b" sheetId="2" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}><si><t>Datum</t></si><si><r><t>Bet</t></r><r><t>rag</t></r></si><si><t>Text</t></si></sst>")
            z.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>")
            own = zipfile.ZipInfo("xl/worksheets/sheet7.xml")
            z.writestr(own, "")
        common, listed = held.getvalue(), _LISTED_SIZE + len(own.filename) + _END_SIZE
        start = own.header_offset + _HEAD_SIZE + len(own.filename)
        # the sheet's checksum and sizes, in its head and in the directory's last row, and where the directory begins are all that differs
        parts = [common[: own.header_offset + 14], common[own.header_offset + 26 : start], common[start : -listed + 16], common[-listed + 28 : -6], common[-2:]]

        def packed(sheet: bytes) -> bytes:
            sizes = struct.pack("<3L", zlib.crc32(sheet), len(sheet), len(sheet))
            return b"".join((parts[0], sizes, parts[1], sheet, parts[2], sizes, parts[3], struct.pack("<L", start + len(sheet)), parts[4]))

        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                contents = []
                for i, xml in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    content = packed(f"<worksheet {_MAIN}><sheetData>{head}{xml}</sheetData></worksheet>".encode())
                    contents.append(content[:40] if i % 50 == 0 else content)
                yield pa.RecordBatch.from_arrays([pa.array([f"s{i}.xlsx" for i in part.column(0).to_pylist()], pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return sheets.mapInArrow(pack, "path string, content binary")


@query("SELECT 's' || statement_id || '.xlsx' AS file, booking_date, CAST(amount_cents AS DOUBLE) / 100.0 AS amount, description FROM live WHERE statement_id % 50 <> 0")
def workbook_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements as workbooks, read again; those that are torn give no rows."""
    return parse_workbooks(written_workbooks(spark, sf_dir))[0].select("file", "booking_date", "amount", "description")


@query("SELECT 's' || statement_id || '.xlsx' AS file, statement_id % 50 <> 0 AS success, CASE WHEN statement_id % 50 <> 0 THEN count(*) ELSE 0 END AS rows, CASE WHEN statement_id % 50 = 0 THEN 'Could not read the workbook' END AS error_message FROM live GROUP BY statement_id")
def workbook_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_workbooks(written_workbooks(spark, sf_dir))[1].select("file", "success", "rows", "error_message")
