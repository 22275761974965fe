"""Dates and amounts in text, and how they are shown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """The first date in a text: day.month.year, else ISO, else day/month/year.  Of a date that is none, null, whatever stands behind it."""
    found = F.lit(None).cast("date")
    for pattern, form in ((r"(\d{2}/\d{2}/\d{4})", "dd/MM/yyyy"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{2}\.\d{2}\.\d{4})", "dd.MM.yyyy")):
        text = F.regexp_extract(c, pattern, 1)
        found = F.when(text != "", F.try_to_timestamp(text, F.lit(form)).cast("date")).otherwise(found)
    return found


def short_year(two: Column) -> Column:
    """Years of two digits: above 50 of the last century."""
    n = two.cast("int")
    return F.when(n >= 100, n).when(n > 50, n + 1900).otherwise(n + 2000)


def german_date(c: Column, as_of_year: int) -> Column:
    """day.month.[year], a missing year being ``as_of_year``."""
    part = lambda i: F.regexp_extract(c, r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})?", i)
    year = F.when(part(3) == "", F.lit(as_of_year)).otherwise(short_year(F.nullif(part(3), F.lit(""))))
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(part(1) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def parse_amount(c: Column) -> Column:
    """A number in German or English notation, without spaces and currency; else null.

    The later of comma and dot is the decimal sign; a comma alone is one too.
    """
    x = F.regexp_replace(c, r"\s|€|\$|EUR|USD", "")
    comma, dot = F.length(x) - F.instr(F.reverse(x), ","), F.length(x) - F.instr(F.reverse(x), ".")
    has_comma, has_dot = x.contains(","), x.contains(".")
    german = F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")
    plain = F.when(has_comma & has_dot, F.when(comma > dot, german).otherwise(F.regexp_replace(x, ",", ""))).when(has_comma, F.regexp_replace(x, ",", ".")).otherwise(x)
    return plain.try_cast("double")


def german_number(cents: Column) -> Column:
    """Cents as 1.234,56."""
    text = F.format_number(F.abs(cents) / 100, 2)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.translate(text, ",.", ".,"))


def month_label(c: Column) -> Column:
    """``yyyy-MM`` as ``Jan yyyy``; other texts as they are."""
    names = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    number = F.regexp_extract(c, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.get(names, number - 1), F.lit(" "), F.substring(c, 1, 4)), c)


def period(first: Column, last: Column) -> Column:
    """A statement's period, as JAN 2024 - MAR 2024."""
    name = lambda d: F.upper(F.date_format(d, "MMM yyyy"))
    return F.concat(name(first), F.lit(" - "), name(last))


# Banks by what file names, header lines and texts contain, in order.
BANKS_BY_FILE = [("revolut", "Revolut"), ("ing", "ING"), ("dkb", "DKB"), ("sparkasse", "Sparkasse"), ("deutsche", "Deutsche Bank"), ("commerzbank", "Commerzbank"), ("n26", "N26")]
BANKS_BY_TEXT = [
    ("ing-diba", "ING DiBa"), ("ing diba", "ING DiBa"), ("deutsche bank", "Deutsche Bank"), ("sparkasse", "Sparkasse"), ("commerzbank", "Commerzbank"), ("dkb", "DKB"), ("n26", "N26"), ("revolut", "Revolut"),
]
# How statements write their period, by the language of the bank.
PERIODS = {
    "german": [
        r"(?i)Kontoauszug\s+(?:Nr\.?\s*\d+\s+)?(?:vom\s+)?(\d{2}\.\d{2}\.\d{4})(?:\s*[-–bis]+\s*(\d{2}\.\d{2}\.\d{4}))?",
        r"(?i)Auszug\s+(\w+\s+\d{4})", r"(?i)Zeitraum[:\s]+(\d{2}\.\d{2}\.\d{4})\s*[-–bis]+\s*(\d{2}\.\d{2}\.\d{4})", r"(?i)(\w+)\s+(\d{4})\s*Kontoauszug",
    ],
    "international": [
        r"(?i)(?:Statement Period|Period|Período|Période)[:\s]*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\s*(?:to|-|–)\s*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})",
        r"(?i)(?:From|Desde|Du)[:\s]*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\s*(?:To|Hasta|Au)[:\s]*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})", r"(?i)(\w+\s+\d{4})",
    ],
    "revolut": [r"(?i)von\s+(\d{1,2}\.?\s+\w+\s+\d{4})\s+bis\s+(\d{1,2}\.?\s+\w+\s+\d{4})", r"(?i)(\d{1,2}\.?\s+\w+\s+\d{4})\s*[-–to]+\s*(\d{1,2}\.?\s+\w+\s+\d{4})"],
}


def _first_bank(low: Column, banks: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(low.contains(part), name) for part, name in banks), F.lit("Unknown Bank"))


def bank_of_file(name: Column) -> Column:
    return _first_bank(F.lower(name), BANKS_BY_FILE)


def bank_of_header(header: Column) -> Column:
    """By the header line of a delimited file; null if it tells none."""
    low = F.lower(header)
    return F.when(low.contains("revolut") | (low.contains("product") & low.contains("started date")), "Revolut").when(low.contains("ing"), "ING")


def bank_of_text(text: Column) -> Column:
    return _first_bank(F.lower(text), BANKS_BY_TEXT)


def period_in_text(text: Column, style: str) -> Column:
    """A statement's period as its text has it, the parts joined by a dash; null without one."""
    found = []
    for pattern in PERIODS[style]:
        parts = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, len(re.findall(r"\((?!\?)", pattern)) + 1)]
        found.append(F.nullif(F.concat_ws(" - ", *parts), F.lit("")))
    return F.coalesce(*found)
