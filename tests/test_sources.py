import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import values
from tallyforge.sources import exports, statements


def load(spark, folder, **files):
    for name, content in files.items():
        (folder / f"{name}.csv").write_text(content, encoding="utf-8")
    rows, status = statements.read_csv(statements.read_lines(spark, str(folder)))
    name = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    return {r.name: r for r in status.withColumn("name", name).collect()}, rows.withColumn("name", name).orderBy("name", "place").collect()


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, mark):
    status, rows = load(spark, tmp_path, a=mark.join(["Date", "Amount", "Description"]) + "\n" + mark.join(["15.01.2024", "-12.50", "Coffee"]) + "\n")
    assert status["a"].success and status["a"].statement_period == "JAN 2024 - JAN 2024"
    assert [(r.booking_date, r.amount, r.description, r.currency) for r in rows] == [(datetime.date(2024, 1, 15), -12.5, "Coffee", "EUR")]


def test_quotes_and_ragged_rows(spark, tmp_path):
    text = 'Buchungsdatum;Betrag;Verwendungszweck;Auftraggeber\n01.02.2024;"1.234,56";"a; b ""c""";X\n\n29.02.2023;1,00;no such day;X\n29.02.2024;1,00\nbad;row\n2024-03-01;€ 5;"un;closed\n'
    status, rows = load(spark, tmp_path, a=text)
    assert [(r.amount, r.description, r.counterparty_name) for r in rows] == [(1234.56, "a; b c", "X"), (1.0, "", None), (5.0, "un;closed", None)]
    assert rows[0].raw_text == "01.02.2024;1.234,56;a; b c;X" and status["a"].rows == 3


def test_a_line_break_within_quotes_ends_the_row(spark, tmp_path):
    _, rows = load(spark, tmp_path, a='Date,Amount,Description\n01.02.2024,5,"first\nsecond"\n')
    assert [r.description for r in rows] == ["first"]


def test_problems_of_files(spark, tmp_path):
    status, rows = load(spark, tmp_path, a="Amount,Text\n1,x\n", b="Date,Text\n01.02.2024,x\n", c="Date,Amount\n")
    assert status["a"].error_message == "Could not find date column in CSV" and status["b"].error_message == "Could not find amount column in CSV"
    assert status["c"].success and status["c"].rows == 0 and not rows


@pytest.mark.parametrize(
    ("text", "amount"),
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("-12,5", -12.5), ("12.5", 12.5), ("€ 1 000,00", 1000.0), ("5 EUR", 5.0), ("$7", 7.0), ("abc", None), ("", None), ("1,2,3", None)],
)
def test_amounts(spark, text, amount):
    assert spark.range(1).select(values.parse_amount(F.lit(text))).first()[0] == amount


@pytest.mark.parametrize(
    ("text", "date"), [("am 15.01.2024 um", (2024, 1, 15)), ("2024-01-15", (2024, 1, 15)), ("15/01/2024", (2024, 1, 15)), ("31.02.2024 2024-01-15", None), ("none", None)]
)
def test_dates(spark, text, date):
    assert spark.range(1).select(values.parse_date(F.lit(text))).first()[0] == (date and datetime.date(*date))


def test_short_years_and_missing_ones(spark):
    got = spark.range(1).select(*(values.german_date(F.lit(x), 2024) for x in ("1.2.99", "01.02.24", "5.12.", "x"))).first()
    assert list(got) == [datetime.date(1999, 2, 1), datetime.date(2024, 2, 1), datetime.date(2024, 12, 5), None]


def test_file_types(spark, tmp_path):
    for name, content in {"a.PDF": b"%PDF-1.4", "b.xlsx": b"PK\x03\x04", "c.csv": b"x;y", "d.bin": b"\x00\x01", "e.xls": b"\xd0\xcf\x11\xe0"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file.rsplit("/", 1)[1]: (r.by_name, r.by_content) for r in statements.detect(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": ("PDF", "PDF"), "b.xlsx": ("EXCEL", "EXCEL"), "c.csv": ("CSV", "CSV"), "d.bin": (None, None), "e.xls": ("EXCEL", "EXCEL")}


def test_dimension_files(spark):
    lines = spark.createDataFrame([("category,keyword",), ("RENT,miete, kalt",), ("OTHER,x",), ("NONE,y",), ("broken",)], "line string")
    assert [tuple(r) for r in statements.load_keywords(lines, ["RENT", "OTHER"]).collect()] == [("RENT", "miete, kalt")]
    lines = spark.createDataFrame([("SM,de,Rewe Markt",), ("XX,de,No",), ("SM,de,A!",)], "line string")
    assert [(r.category, r.country_code, r.name_normalized) for r in statements.load_merchants(lines, {"SM": "SUPERMARKET"}).collect()] == [("SUPERMARKET", "DE", "rewe markt")]


def test_export_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.date(2024, 1, 15), 'a "b", c', None, "RENT", -5, "EUR", "Main")], "booking_date date, description string, counterparty_name string, auto_category string, amount_cents long, currency string, account_name string")
    exports.write_lines(exports.transaction_lines(rows.coalesce(1)), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == exports.HEADER + '\n15.01.2024,"a ""b"", c",,RENT,-0.05,EUR,Main\n'
    assert exports.transaction_lines(rows, "Other").count() == 0 and exports.transaction_lines(rows, "All Accounts").count() == 1


def test_lines_stay_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Amount\n15.01.2024,5\n", encoding="utf-8")
    rows, _ = statements.read_csv(statements.read_lines(spark, str(tmp_path)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
