import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import references
from tallyforge.sources import pdf_text


DOCUMENTS = [
    ("Sparkasse Musterstadt\n15.01.2024 REWE Markt -12,50\nKartenzahlung\n16.01.2024 Gehalt 1.234,56", "Sparkasse", [((2024, 1, 15), -12.5, "REWE Markt Kartenzahlung"), ((2024, 1, 16), 1234.56, "Gehalt")]),
    ("DKB AG, dkb.de\nAuszug 01.02.2023\n03.02. 03.02. Zahlungseingang ACME 100,00\n04.02. 04.02. Lidl 20,00\nmehr", "DKB", [((2023, 2, 3), 100.0, "Zahlungseingang ACME"), ((2023, 2, 4), -20.0, "Lidl mehr")]),
    ("VR-Bank\n03.02. 03.02. Miete 500,00 S\n04.02. 04.02. Lohn 900,00 H", "Volksbank/VR-Bank", [((2024, 2, 3), -500.0, "Miete"), ((2024, 2, 4), 900.0, "Lohn")]),
    ("Tomorrow Bank\n05.03.2024 / Bio Company 12,00 €\n06.03.2024 / Refund +3,00 €", "Tomorrow", [((2024, 3, 5), -12.0, "Bio Company"), ((2024, 3, 6), 3.0, "Refund")]),
    ("www.bunq.com\n2024-03-05 Coffee -3.50\n2024-03-05 Coffee -3.50", "bunq", [((2024, 3, 5), -3.5, "Coffee")]),
    ("nothing known\n05.03.2024 Something −3,50", None, [((2024, 3, 5), -3.5, "Something")]),
    ("Sparkasse\nno transactions here", "Sparkasse", []),
    ("Sparkasse\nEinkauf eins am 05.03.2024 1,00\nEinkauf zwei am 06.03.2024 2,00", "Sparkasse", [((2024, 3, 5), 1.0, "Einkauf eins am"), ((2024, 3, 6), 2.0, "Einkauf zwei am")]),
    ("C24 Bank\nText vorweg\nam 03.04.2024 bezahlt 5,00-", "C24 Bank", [((2024, 4, 3), -5.0, "am bezahlt")]),
    ("Commerzbank AG\nBuchungsdatum: 05.03.2024\nMiete 04.03 500,00-", "Commerzbank", [((2024, 3, 5), -500.0, "Miete")]),
    ("Volksbank\n03.02.2024 Miete 500,00 S", None, [((2024, 2, 3), -500.0, "Miete")]),
    ("by hand\n2 Jan 2024 tea €1.00\n3 Jan 2024 coffee €2.00\n4 Jan 2024 cake +€3.00\n5 Jan 2024 pie €4.00", "Revolut", None),
]


def test_layouts(spark):
    rows = [(f"f{i:02}", n, line) for i, (d, _, _) in enumerate(DOCUMENTS) for n, line in enumerate(d.split("\n"))]
    lines = spark.createDataFrame(rows, "file string, line_no int, text string").repartition(3)
    by_hand = spark.createDataFrame([(f"f{len(DOCUMENTS) - 1:02}", "Revolut")], "file string, bank string")
    got = {}
    for r in pdf_text.read_statements(lines, 2024, by_hand).orderBy("file", "line_no").collect():
        got.setdefault(r.file, []).append((r.bank, r.booking_date, r.amount, r.description))
    for i, (_, bank, expected) in enumerate(DOCUMENTS):
        own = got.get(f"f{i:02}", [])
        if expected is None:
            assert {r[0] for r in own} == {bank} and len(own) == 4
        else:
            assert own == [(bank, datetime.date(*d), a, t) for d, a, t in expected]


def test_institutions_read_their_notation(spark):
    by = {x.bank: x for x in pdf_text.international()}
    assert len(by) == 47
    lines = spark.createDataFrame([("f", 1, "03/04/2024 Shop 1,234.56"), ("g", 1, "05 Mar 2024 Tea -2.00")], "file string, line_no int, text string")
    assert pdf_text.scan(lines.where("file = 'f'"), by["TD Bank"], 2024).first().booking_date == datetime.date(2024, 3, 4)
    assert pdf_text.scan(lines.where("file = 'f'"), by["Westpac"], 2024).first().booking_date == datetime.date(2024, 4, 3)
    assert pdf_text.scan(lines.where("file = 'g'"), by["Lloyds Bank"], 2024).first().amount == -2.0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sepa_tags(spark):
    got = value(spark, references.sepa(F.lit("EREF+ABC-1 MREF+M 2 SVWZ+Rechnung 77 IBAN: DE89370400440532013000 BIC+COBADEFFXXX")))
    assert (got.eref, got.mref, got.iban, got.bic) == ("ABC-1", "M 2", "DE89370400440532013000", "COBADEFFXXX") and got.purpose.startswith("Rechnung 77")
    assert value(spark, references.sepa(F.lit("EREF+X plain  words"))).purpose == "plain words"


@pytest.mark.parametrize(
    ("counterparty", "description", "name"),
    [
        ("PayPal Europe", "PP.1234.PP, Ihr Einkauf bei Preply Inc", "PayPal · Preply Inc"), ("PayPal", "12345", "PayPal"), ("Rewe", "x", "Rewe"), (None, "LASTSCHRIFT Stadtwerke", "Stadtwerke"),
        ("ab", "1234567890 " * 10, ("1234567890 " * 10)[:50] + "…"),
    ],
)
def test_display_names(spark, counterparty, description, name):
    assert value(spark, references.display_name(F.lit(counterparty).cast("string"), F.lit(description))) == name


@pytest.mark.parametrize(
    ("counterparty", "description", "name"),
    [("Bank", "VISA Netflix Kaufumsatz 3", "Netflix"), ("Bank", "Kartenzahlung EDEKA 123//Berlin/DE", "EDEKA 123"), ("Shop", "x", "Shop"), ("S", "x", None), (None, "x", None), ("Bank", "Rewe Mastercard • Lebensmittel", "Rewe")],
)
def test_effective_merchants(spark, counterparty, description, name):
    texts = F.lit(description), F.lit(counterparty).cast("string")
    whole = references.whole_text(*texts)
    assert value(spark, references.effective_merchant(references.kind(F.lower(whole)), texts[1], whole)) == name


def test_only_what_the_own_layout_left_is_read_again(spark, monkeypatch):
    from tallyforge.sources import strategies

    n26 = ["N26 Bank", "Rewe 15.01.2024 -12,50€", "Miete 16.01.2024 -700,00€"]
    rows = [(f, i, t) for f, lines in {"sure": n26, "few": n26[:2], "none": ["kein Name", "15.01.2024 Kaffee 3,50"]}.items() for i, t in enumerate(lines)]
    seen, german = [], strategies.german_readings
    monkeypatch.setattr(strategies, "german_readings", lambda lines, year: seen.append(lines) or german(lines, year))
    got = pdf_text.read_statements(spark.createDataFrame(rows, "file string, line_no int, text string"), 2024)
    assert sorted((r.file, r.amount) for r in got.collect()) == [("few", -12.5), ("none", -3.5), ("sure", -700.0), ("sure", -12.5)]
    assert {r.file for r in seen[0].collect()} == {"few", "none"}
