import pytest

from tallyforge.sources import layouts


def lines(spark, *documents):
    rows = [(f"f{i}", n * 10, line) for i, d in enumerate(documents) for n, line in enumerate(d.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, text string").repartition(3)


def found(df, *more):
    return [(str(r.booking_date), str(r.value_date), r.amount, r.description, *(r[c] for c in more)) for r in df.orderBy("file", "line_no").collect()]


def test_a_header_dates_what_follows(spark):
    text = """COMMERZBANK
02.01 zu früh    02.01    1,00
Buchungsdatum: 30.12.2022
AMAZON EU S.A R.L., NIEDERLASSUNG D    29.12    7,99-
EUTSCHLAND

D01-0693031-6475854 AMZNPrime DE 39
Miete Januar 28.12 1.500,00-
Alter Kontostand 5,00
das gehört zu nichts
buchungsdatum: 02.01.2023
Gehalt ACME    01.01    2 500,00
Details dazu"""
    got = found(layouts.commerzbank(lines(spark, text), 2020))
    assert got == [
        ("2020-01-02", "2020-01-02", 1.0, "02.01 zu früh"),
        ("2022-12-30", "2022-12-29", -7.99, "AMAZON EU S.A R.L., NIEDERLASSUNG D EUTSCHLAND D01-0693031-6475854 AMZNPrime DE 39"),
        ("2022-12-30", "2022-12-28", -1500.0, "Miete Januar"),
        ("2023-01-02", "2023-01-01", 2500.0, "Gehalt ACME Details dazu"),
    ]


def test_types_with_the_year_of_the_header(spark):
    text = """Datum 30.04.22 Konto
LASTSCHRIFT                        25.04. 8999   26.04.         14,41-
VISA 26466011 ALSBACH-HAEH
LIDL DIENSTLEISTUNG
22.04. 10355411
*** Kontostand zum 25.04. 1,00+
D-GUTSCHRIFT 27.04. 8999 27.04. 1.000,00 +
64404 Bickenbach
LASTSCHRIFT ohne Tag 5,00-
GEHALT 28.04. 8999 2.000,00+
ACME AG"""
    got = found(layouts.consorsbank(lines(spark, text, "GEHALT 28.04. 8999 2.000,00+"), 2020))
    assert got == [("2022-04-25", "2022-04-26", -14.41, "LIDL DIENSTLEISTUNG"), ("2022-04-27", "2022-04-27", 1000.0, "D-GUTSCHRIFT"), ("2022-04-28", "2022-04-28", 2000.0, "ACME AG"), ("2020-04-28", "2020-04-28", 2000.0, "GEHALT")]


def test_dates_behind_the_amount(spark):
    text = """Kontoauszug vom 27.02.2021 bis 31.03.2021
Bargeldauszahlung GAA - 440,00
01.03. 02.03.
Verwendungszweck/ Kundenreferenz
Postbank//Darmstadt/DE
SEPA Überweisung von + 150,00
Max Muster

03.03. 03.03.
Verwendungszweck/ Kundenreferenz
Geschenk
für dich
Kartenzahlung − 12,50
ohne Tag
noch immer
neuer Saldo + 5,00
Lastschrift - 9,00
05.03. 05.03."""
    got = found(layouts.norisbank(lines(spark, text), 2020), "counterparty")
    assert got == [
        ("2021-03-01", "2021-03-02", -440.0, "Postbank//Darmstadt/DE", "ATM Darmstadt"),
        ("2021-03-03", "2021-03-03", 150.0, "Geschenk für dich", "Max Muster"),
        ("2021-03-05", "2021-03-05", -9.0, "Lastschrift", None),
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (
            "01.02.2024 Lastschrift VISA Netflix -12,99\n02.02.2024 Valuta Text\nMandat: X1\nReferenz: R2\nmehr dazu\nSeite 1 von 2\n03.02.2024 Gehalt/Rente ACME 2.000,00\n\n04.02.2024 Gutschrift Oma 5,00\n05.02.2024 Entgelt 1,00\nnoch etwas",
            [("2024-02-01", "2024-02-02", -12.99, "Lastschrift: VISA Netflix Valuta Text mehr dazu"), ("2024-02-03", "2024-02-04", 2000.0, "Gehalt: /Rente ACME Gutschrift Oma 5,00"), ("2024-02-05", "2024-02-05", 1.0, "Entgelt: noch etwas")],
        ),
        ("01.02.2024 Netflix - 12,99 100,00\nmehr dazu\n5,00 ohne Datum\n\nnicht dazu\n02.02.2024 nichts\n03.02.2024 + 7,00 Oma", [("2024-02-01", "2024-02-01", -12.99, "Netflix mehr dazu"), ("2024-02-03", "2024-02-03", 7.0, "Oma")]),
        ("Kauf 5,00\nam 01.02.24 bei REWE\n- 12,99 EUR\n\nohne Betrag 02.02.2024\n\nam 03.02.2024 7,00\nSeite 1 von 3", [("2024-02-01", "2024-02-01", -12.99, "bei REWE"), ("2024-02-03", "2024-02-03", 7.0, "Transaction")]),
        ("nichts", []),
    ],
)
def test_three_readings(spark, text, expected):
    got = found(layouts.ing(lines(spark, text), 2024))
    assert got == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Date Description Money out Money in Balance\nMar 19, 2024 Transfer €700.00 €1,000.00\nTo: Jane Doe\nMar 20, 2024 Payment from ACME €2,500.00 €3,500.00\nReference: Salary\n€1.00 alone\nApr 1, 2024 Coffee €3.50", [(-700.0, "Transfer To: Jane Doe", "EUR"), (2500.0, "Payment from ACME Reference: Salary", "EUR"), (-3.5, "Coffee", "EUR")]),
        ("Datum Beschreibung Geldausgang Geldeingang Kontostand\n02.01.2024 Kauf REWE €12.50\nBerlin\n03.01.2024 Zahlung von Oma €5.00\n\n04.01.2024 Bäcker €1.00", [(-12.5, "Kauf REWE Berlin", "EUR"), (5.0, "Zahlung von Oma", "EUR"), (-1.0, "Bäcker", "EUR")]),
        ("2 Jan coffee house £3.50\n3 Jan 2023 refund +£4.00\n4 Jan tea -£1.25", [(-3.5, "coffee house", "GBP"), (4.0, "refund", "GBP"), (-1.25, "tea", "GBP")]),
        ("2 Jan 2024\ncoffee house\n$3.50\n\n3 Jan\nold town museum\n+4.00\n\nwithout a date 5.00", None),
    ],
)
def test_revolut(spark, text, expected):
    got = layouts.revolut(lines(spark, text), 2024).orderBy("line_no").collect()
    if expected is None:
        assert [(r.strategy, r.amount, r.currency) for r in got] == [("block", -3.5, "USD"), ("block", 4.0, "USD")]
    else:
        assert [(r.amount, r.description, r.currency) for r in got] == expected


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "file string, line_no int, text string")
    for f in (layouts.commerzbank, layouts.consorsbank, layouts.norisbank, layouts.ing, layouts.revolut):
        assert f(empty, 2024).count() == 0
