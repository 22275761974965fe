import datetime
import io
import random
import zipfile
import zlib

from tallyforge.operators import pages
from tallyforge.sources import spreadsheets

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}><si><t>Datum</t></si><si><r><t>Bet</t></r><r><t>rag</t></r></si><si><t>Text</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {_MAIN}><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    head = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>'
    body = '<row><c r="A2" s="1"><v>45306</v></c><c r="B2"><v>-12.5</v></c><c r="D2" t="inlineStr"><is><t>Coffee</t></is></c></row><row><c r="A3" t="str"><v>16.01.2024</v></c><c r="B3"><f>1+1</f><v>2</v></c></row><row/>'
    workbook(tmp_path / "a.xlsx", head + body)
    workbook(tmp_path / "b.xlsx", head.replace("<v>1</v>", "<v>2</v>"))
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    rows, status = spreadsheets.read_workbooks(spark, str(tmp_path))
    assert [(r.booking_date, r.amount, r.description) for r in rows.orderBy("place").collect()] == [(datetime.date(2024, 1, 15), -12.5, "Coffee"), (datetime.date(2024, 1, 16), 2.0, "")]
    assert {r.file[-6:]: (r.success, r.rows) for r in status.collect()} == {"a.xlsx": (True, 2), "b.xlsx": (False, 0), "c.xlsx": (False, 0)}
    assert {r.error_message for r in status.collect() if r.file.endswith("c.xlsx")} == {"Could not read the workbook"}


def test_transactions_find_their_lines(spark):
    lines = spark.createDataFrame([("f", 1, 1, "Saldo 12,50"), ("f", 1, 2, "Rewe Markt -12,50 EUR"), ("f", 2, 1, "Miete 1.200,00"), ("g", 1, 1, "Rewe 12,50")], "file string, page int, line_no int, text string")
    rows = spark.createDataFrame([("f", 1, -1250, "REWE Berlin"), ("f", 2, -120000, "something else"), ("f", 3, 99, "none")], "file string, id int, amount_cents long, description string")
    got = {r.id: (r.page, r.line_no, r.sure) for r in pages.match_lines(rows, lines).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, False)}


def test_each_workbook_is_written_and_parsed_once(spark):
    files = spreadsheets.written_workbooks(spark, "/root/testdata/sf0.001")
    for frame in spreadsheets.parse_workbooks(files):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 2 and plan.count("Relation ") == 2  # lines and parts


def test_a_long_sheet_comes_in_parts(spark, tmp_path):
    n = 2 * spreadsheets._PART + 1
    head = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    workbook(tmp_path / "a.xlsx", head + "".join(f'<row><c r="A{i}" s="1"><v>45306</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(2, n + 2)))
    workbook(tmp_path / "b.xlsx", head)
    rows, status = spreadsheets.read_workbooks(spark, str(tmp_path))
    assert [(r.place, r.amount) for r in rows.orderBy("place").collect()] == [(i - 1, float(i)) for i in range(2, n + 2)]
    assert {r.file[-6:]: (r.success, r.rows, r.statement_period) for r in status.collect()} == {"a.xlsx": (True, n, "JAN 2024 - JAN 2024"), "b.xlsx": (True, 0, None)}


def archives():
    """Archives of several makes, and damaged ones."""
    held, draw = [], random.Random(4)
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        for comment, name, streamed in ((b"", "xl/a.xml", False), (b"said", "xl/a.xml", False), (b"", "xl/\u00e4.xml", False), (b"", "xl/a.xml", True)):
            out = io.BytesIO()
            if streamed:
                out.seekable = lambda: False
            with zipfile.ZipFile(out, "w", method) as z:
                z.comment = comment
                for n, text in ((name, "x" * 300), ("xl/b.xml", ""), ("xl/c.xml", "\u00e4bc"), ("xl/c.xml", "again")):
                    z.writestr(n, text)
            held.append(out.getvalue())
    held += [b"before" + held[0], held[0] + b"behind", b"", held[0][:40]]
    for whole in held[:8]:
        for _ in range(150):
            damaged = bytearray(whole)
            damaged[draw.randrange(len(whole))] ^= 1 << draw.randrange(8)
            held.append(bytes(damaged))
    return held


def outcome(open_archive, names, read):
    try:
        book = open_archive()
        return {n: read(book, n) for n in names(book)}
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError, zlib.error) as e:
        return type(e)


def test_archives_are_read_as_zipfile_reads_them():
    for content in archives():
        want = outcome(lambda: zipfile.ZipFile(io.BytesIO(content)), lambda z: list(z.NameToInfo), lambda z, n: z.read(n))
        assert outcome(lambda: spreadsheets._Archive(content), lambda z: list(z.parts), lambda z, n: z.read(n)) == want


def test_plain_archives_are_taken_from_their_bytes(spark, monkeypatch):
    row = spreadsheets.written_workbooks(spark, "/root/testdata/sf0.001").where("length(content) > 40").first()
    with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
        assert z.testzip() is None and z.read("xl/worksheets/sheet7.xml").startswith(b"<worksheet")
        assert len(z.namelist()) == 6
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert spreadsheets.first_sheet(bytes(row.content))[0] == ["Datum", "Betrag", "", "Text"]
