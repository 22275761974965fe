import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import strategies as st


def lines(spark, *documents):
    rows = [(f"f{i}", n * 10, line) for i, d in enumerate(documents) for n, line in enumerate(d.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, text string").repartition(3)


def found(df):
    return [(r.strategy, r.booking_date.isoformat(), r.amount, r.description) for r in df.orderBy("file", "strategy", "line_no").collect()]


def reading(spark, name, text, year=2024):
    return [r[1:] for r in found(st.german_readings(lines(spark, text), year).where(F.col("strategy") == name))]


DETAILS = "\n".join(f"Zeile {i}" for i in range(12))


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("table", "Kopf\nMiete Mai 02.05.2024 03.05.2024 - 500,00 EUR 1.000,00\nHausverwaltung\n\nnicht mehr dabei\n04.05.24 Lohn 900,00", [("2024-05-02", -500.0, "Miete Mai Hausverwaltung"), ("2024-05-04", 900.0, "Lohn")]),
        ("table", "02.05.2024 Neuer Saldo 5,00\n31.02.2024 kein Tag 7,00\n03.05.2024 5,00", []),
        ("date_amount", "02.05.2024 03.05.2024 Miete Mai -500,00 €\nDetails zur Miete\n04.05.2024 nur Datum\nText 05.05.2024 5,00", [("2024-05-02", -500.0, "Miete Mai Details zur Miete")]),
        ("date_amount", "02.05.2024 Kaffee 3,00\n02.05.2024 Kaffee 3,00", [("2024-05-02", 3.0, "Kaffee")] * 2),
        ("block", "Betrag 12,00 EUR\nSeite 1 von 2\nBäckerei Huber\nam 02.05.2024\n\n\nohne Datum 5,00\n\n03.05.24 +7,00 Kino", [("2024-05-02", 12.0, "Betrag Bäckerei Huber am"), ("2024-05-03", 7.0, "Kino")]),
        ("multiline", "04.03.2023\nKartenzahlung REWE\nBerlin\n- 2,18\n27.01./28.01. SDD Lastschr\nStrom - 48,37 EUR", [("2023-03-04", -2.18, "Kartenzahlung REWE Berlin"), ("2024-01-27", -48.37, "SDD Lastschr Strom")]),
        ("multiline", f"04.03.2023\n{DETAILS}\n+ 2,18\n05.03.2023 Anfang\n06.03.2023 Ende - 1,00", [("2023-03-04", 2.18, " ".join(f"Zeile {i}" for i in range(12))), ("2023-03-05", -1.0, "Anfang 06.03.2023 Ende")]),
        ("multiline", f"04.03.2023\n{DETAILS}\n{DETAILS}\n+ 2,18", []),
        ("comprehensive", "02.05.\n2024 Miete", [("2024-05-02", None, "")][:0]),
        ("comprehensive", "03.05. REWE Markt 25,49 S\n04.05. ACME AG Zahlung 100,00 H\n05.05.\n2023\nBäckerei Huber 3,00-\n06.05.2023 Gehalt Mai 2.000,00", [("2024-05-03", -25.49, "REWE Markt"), ("2024-05-04", 100.0, "ACME AG Zahlung"), ("2023-05-05", -3.0, "Bäckerei Huber"), ("2023-05-06", 2000.0, "Gehalt Mai")]),
        ("comprehensive", "03.05.2024 Anfang\n" + DETAILS + "\n5,00", []),
    ],
)
def test_each_reading(spark, name, text, expected):
    assert reading(spark, name, text) == expected


def test_a_document_takes_the_first_reading_with_enough_rows(spark):
    three = "\n".join(f"Einkauf Nummer {i} am 0{i}.05.2024 {i},00" for i in range(1, 5))  # table 4, comprehensive 1
    one = "Einkauf am 02.05.2024 7,00"  # table and comprehensive tie: the earlier one stays
    twice = "02.05.2024 Kaffee gross 3,00\n02.05.2024 Kaffee gross 3,00"  # only one reading keeps both
    none = "nichts"
    got = found(st.read_german(lines(spark, three, one, twice, none), 2024))
    assert got[:4] == [("table", f"2024-05-0{i}", float(i), f"Einkauf Nummer {i} am") for i in range(1, 5)]
    assert got[4:] == [("comprehensive", "2024-05-02", -7.0, "Einkauf am")] + [("date_amount", "2024-05-02", 3.0, "Kaffee gross")] * 2


def test_types_and_counterparties(spark):
    rows = st.read_german(lines(spark, "02.05.2024 SEPA Lastschrift Stadtwerke GmbH -5,00\n03.05.2024 Überweisung an Max Muster 6,00\n04.05.2024 Irgendwas Anderes -7,00"), 2024).orderBy("line_no").collect()
    assert [r.transaction_type for r in rows] == ["SEPA-Lastschrift", "Überweisung", "Buchung"]
    assert [r.counterparty for r in rows] == ["SEPA Lastschrift Stadtwerke GmbH", "Max Muster", "Irgendwas Anderes"]
    assert {r.currency for r in rows} == {"EUR"}


@pytest.mark.parametrize(
    ("forms", "text", "expected"),
    [
        (("MM_DD_YYYY", "DOT_DECIMAL", "USD"), "05/02/2024 Coffee shop 1,234.56\nmore of it\nPage 1 of 2\n\nno more\n13/02/2024 no month 5.00", [("table", "2024-05-02", 1234.56, "Coffee shop more of it")]),
        (("DD_MMM_YYYY", "DOT_DECIMAL", "GBP"), "2 May 2024 £3.00\nTea house", [("table", "2024-05-02", 3.0, "Tea house")]),
        (("DD_MM_YYYY", "COMMA_DECIMAL", "EUR"), "02.05.2024\nCafé Central\n-1.234,56\n\n03.05.24 nichts", [("block", "2024-05-02", -1234.56, "Café Central")]),
        (("MMM_DD_YYYY", "SPACE_DECIMAL", "EUR"), "May 2, 2024 Tea house 1 234.56", [("table", "2024-05-02", 1234.56, "Tea house")]),
        (("YYYY_MM_DD", "SPACE_DECIMAL", "EUR"), "2024-05-02 Tea house 34,56", [("table", "2024-05-02", 34.56, "Tea house")]),
    ],
)
def test_international(spark, forms, text, expected):
    rows = lines(spark, text).withColumns({c: F.lit(v) for c, v in zip(("date_form", "amount_form", "currency"), forms, strict=True)})
    assert found(st.read_international(rows)) == expected


def test_empty_table(spark):
    assert st.read_german(spark.createDataFrame([], "file string, line_no int, text string"), 2024).count() == 0


def test_long_documents_and_null_lines(spark):
    rows = [("f", i, f"{1 + i // 4 % 28:02}.05.2024 Einkauf {i}  -{i},00" if i % 4 == 0 else None) for i in range(4000)]
    got = st.read_german(spark.createDataFrame(rows, "file string, line_no int, text string"), 2024).collect()
    assert len(got) == 1000 and {r.strategy for r in got} == {"comprehensive"} and sum(r.amount for r in got if r.line_no < 400) == -sum(range(0, 400, 4))
    assert got[0].booking_date.year == 2024 and isinstance(got[0].booking_date, datetime.date)


def test_a_reading_is_made_once_a_block(spark):
    text = lines(spark, "02.05.2024 Kaffee 3,00")
    forms = text.withColumns({"date_form": F.lit("DD_MM_YYYY"), "amount_form": F.lit("DOT_DECIMAL"), "currency": F.lit("EUR")})
    for df in (st.german_readings(text, 2024), st.international_readings(forms)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_" in x]  # a filter that has to make it to see whether it is one


def test_spans_go_on_in_the_next_batch(spark):
    rows = [("a", 0, 4, 2), ("a", 1, None, None), ("a", 2, 9, 9), ("a", 3, None, None), ("a", 4, 6, None), ("a", 5, 6, 9), ("b", 0, None, None), ("b", 1, 2, 3), ("b", None, 9, 9), ("b", 2, 3, 2), ("b", 3, None, None), (None, 0, 1, 1), (None, 1, None, None)]
    df = spark.createDataFrame([(f, i, *x) for i, (f, *x) in enumerate(rows)], "file string, line_no int, idx int, x_next int, x_last int").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    try:
        for most in (1, 2, 3, 100):
            spark.conf.set(name, most)
            got = {r.line_no: r.x_block for r in st.blocks_of(df, [("x", "idx")]).collect()}
            assert [got[i] for i in range(13)] == [0, 0, 0, None, None, None, None, 1, None, 2, None, 0, 0]
    finally:
        spark.conf.set(name, held)
