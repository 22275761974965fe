import pytest

from tallyforge.sources import banks


def chosen(spark, *documents):
    rows = [(f"f{i:02}", n, t) for i, d in enumerate(documents) for n, t in enumerate(d.split("\n"))]
    got = banks.choose_bank(spark.createDataFrame(rows, "file string, line_no int, text string").repartition(3)).orderBy("file").collect()
    return [(r.bank, r.best, r.score, r.second_score) for r in got]


def test_tiers_and_margin(spark):
    documents = {
        "Deutsche Bank AG\nBIC: DEUTDEFF\nKontoauszug": ("Deutsche Bank", "Deutsche Bank", 100, 25),
        "Generic banking text without clear bank indicators": (None, None, None, None),
        "": (None, None, None, None),
        "HASPA Hamburger Sparkasse Kontoauszug": ("Sparkasse", "Sparkasse", 100, None),
        "spk helaba": ("Sparkasse", "Sparkasse", 75, None),
        "Volksbank": (None, "Volksbank/VR-Bank", 50, None),
        "Volksbank\nBu-Tag": ("Volksbank/VR-Bank", "Volksbank/VR-Bank", 75, None),
        "Bu-Tag": (None, "Volksbank/VR-Bank", 25, None),
        "Bu-Tag PN:931": (None, "Volksbank/VR-Bank", 50, None),
        "ing-diba": ("ING DiBa", "ING DiBa", 75, None),
        "extra-konto": (None, "ING DiBa", 50, None),
        "NORIS\nyour bank": ("Norisbank", "Norisbank", 100, None),
        "noris only": (None, None, None, None),
        "Postbank AG\nDeutsche Bank AG": (None, "Deutsche Bank", 100, 100),
    }
    assert chosen(spark, *documents) == list(documents.values())


@pytest.mark.parametrize("own", [(banks.Bank("Mine", ("my.bank",)), banks.Bank("Other", medium=("x", "y")))])
def test_own_identifiers_are_plain_text(spark, own):
    rows = [("a", "myxbank"), ("b", "MY.BANK x y"), ("c", None)]
    got = banks.choose_bank(spark.createDataFrame(rows, "file string, text string"), own).orderBy("file").collect()
    assert [(r.bank, r.best, r.score, r.second_score) for r in got] == [(None, "Other", 50, None), (None, "Mine", 100, 50), (None, None, None, None)]


def test_empty_table(spark):
    assert banks.choose_bank(spark.createDataFrame([], "file string, text string")).count() == 0
