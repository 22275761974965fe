"""Statements as lines of text: ordered scans, one window a document.

A bank's layout is a row of a table: which lines begin a transaction, where its date, amount and
sign stand, and how many lines may follow.  One scan serves all layouts: a running count of the
beginning lines numbers the transactions of a document, and each takes the lines up to the next.
Banks whose transactions have no such line are read by ``layouts``, unknown ones by ``strategies``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import collapse, contains_any
from tallyforge.functions.values import german_date, parse_amount
from tallyforge.plans.catalog import query
from tallyforge.plans.folders import shared_folder
from tallyforge.sources import banks, layouts, strategies

_GERMAN = r"\d{1,3}(?:\.\d{3})*,\d{2}"
_ENGLISH = r"\d{1,3}(?:,\d{3})*\.\d{2}"
_FULL, _SHORT, _TWO = r"\d{2}\.\d{2}\.\d{4}", r"\d{2}\.\d{2}\.", r"\d{2}\.\d{2}\.\d{2}"
# Words that tell income from expense where no sign does.
INCOME_WORDS = ["zahlungseingang", "gutschrift", "eingang", "gehalt", "lohn"]


@dataclass(frozen=True)
class Layout:
    """``sign`` says what an amount without one is: "+", "-", or "words" for what the text says."""

    bank: str
    start: str
    date: str
    look: int = 15
    last_amount: bool = True
    sign: str = "words"
    english: bool = False
    key: int = 30
    currency: str = "EUR"

    @property
    def number(self) -> str:
        return _ENGLISH if self.english else _GERMAN


# Layouts of single banks.
LAYOUTS = (
    Layout("Sparkasse", rf"^{_FULL}\s", rf"^({_FULL})", 20, True, "+", key=20),
    Layout("DKB", rf"^{_SHORT}\s+{_SHORT}\s+\S", rf"^({_SHORT})", 20),
    Layout("Deutsche Bank", rf"^{_SHORT}\s+{_SHORT}\s+.*[+-]\s*{_GERMAN}", rf"^({_SHORT})", 15),
    Layout("Postbank", rf"^{_SHORT}/{_SHORT}", rf"^({_SHORT})", 15),
    Layout("Commerzbank", rf"^{_FULL}\s.*{_GERMAN}\s*EUR", rf"^({_FULL})", 10, sign="+"),
    Layout("Volksbank/VR-Bank", rf"^{_SHORT}\s+{_SHORT}\s+.*[SH]$", rf"^({_SHORT})", 20),
    Layout("C24 Bank", rf"^{_SHORT}\s+{_SHORT}\s+\S", rf"^({_SHORT})", 15),
    Layout("TARGOBANK", r"^\d{2}\.\d{2}\s+[A-Z]{2}\w*\s", r"^(\d{2}\.\d{2})", 15, last_amount=False),
    Layout("1822direkt", rf"^{_FULL}\s.*{_GERMAN}\s*€", rf"^({_FULL})", 5, sign="+", key=20),
    Layout("Tomorrow", rf"^{_FULL}\s*/", rf"^({_FULL})", 10, sign="-", key=20),
    Layout("N26", rf"^.+\s{_FULL}\s+[+-]?\s*{_GERMAN}\s*€", rf"({_FULL})", 10, sign="+", key=20),
    Layout("apoBank", rf"^{_FULL}\s", rf"^({_FULL})", 30, key=20),
    Layout("bunq", r"^\d{4}-\d{2}-\d{2}", r"^(\d{4}-\d{2}-\d{2})", 5, sign="+", english=True, key=20),
    Layout("Sparda-Bank", rf"^{_FULL}\s+.*{_FULL}\s+.*{_GERMAN}", rf"^({_FULL})", 30, sign="+", key=20),
    Layout("Oldenburgische Landesbank", rf"^{_TWO}\s+{_SHORT}", rf"^({_TWO})", 30, key=20),
)
# Institutions by currency and notation of amounts; their dates are day first, but for the last group.
INSTITUTIONS = {
    ("XAF", False): ["Afriland First Bank"], ("NGN", True): ["UBA Bank"], ("USD", True): ["Jaha"], ("KES", True): ["Nairobi Bank", "KCB Bank"], ("SGD", True): ["POSB"],
    ("INR", True): ["HDFC Bank", "State Bank of India", "Canara Bank"], ("RUB", False): ["Alfa Bank"], ("MYR", True): ["Maybank", "CIMB Bank"], ("PKR", True): ["NayaPay", "MCB Bank"], ("BDT", True): ["AB Bank", "UCB Bank"],
    ("PLN", False): ["ING Poland"], ("EUR", False): ["ABN AMRO", "Fineco Bank", "Banco BPM", "illimity Bank", "UniCredit", "Société Générale", "Nickel", "Banca March", "Banco CTT"], ("EUR", True): ["Wise", "Bank of Ireland"],
    ("PEN", False): ["BCP Peru"], ("COP", False): ["Banco de Occidente"], ("ARS", False): ["Grupo Inversores", "BBVA Francés", "Banco Provincia"], ("GBP", True): ["Metro Bank", "Virgin Money", "Lloyds Bank"], ("AUD", True): ["Bankwest", "Westpac"],
}
MONTH_FIRST = ["Bank TRN", "Dave", "US Bank", "TD Bank", "Walmart MoneyCard", "Scotiabank", "Royal Bank of Canada", "SunTrust", "Bank of America"]


def international() -> tuple[Layout, ...]:
    """Layouts of the institutions: a date, a text and an amount in one line."""
    start = r"^(?:\d{2}[./-]\d{2}[./-]\d{4}|\d{2} [A-Za-z]{3} \d{4}|\d{4}-\d{2}-\d{2})\s"
    date = r"^(\d{2}[./-]\d{2}[./-]\d{4}|\d{2} [A-Za-z]{3} \d{4}|\d{4}-\d{2}-\d{2})"
    out = [Layout(name, start, date, 3, True, "+", english, currency=currency) for (currency, english), names in INSTITUTIONS.items() for name in names]
    return (*out, *(Layout(name, start, date, 3, True, "+", True, currency="CAD" if name in ("Scotiabank", "Royal Bank of Canada") else "USD") for name in MONTH_FIRST))


def _date(raw: Column, month_first: Column, year: Column) -> Column:
    """A layout's date; one without a year gets ``year``."""
    iso = F.try_to_timestamp(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    named = F.try_to_timestamp(F.regexp_extract(raw, r"^(\d{2} [A-Za-z]{3} \d{4})", 1), F.lit("dd MMM yyyy"))
    dotted = F.regexp_replace(raw, r"[./-]", ".")
    dotted = F.when(month_first, F.regexp_replace(dotted, r"^(\d{2})\.(\d{2})\.", r"$2.$1.")).otherwise(dotted)
    dotted = F.concat(F.rtrim(dotted, F.lit(".")), F.when(F.length(raw) <= 6, F.concat(F.lit("."), year.cast("string"))).otherwise(""))
    long = F.try_to_timestamp(dotted, F.lit("dd.MM.yyyy"))
    return F.when(raw.rlike(r"^\d{2}\.\d{2}\.\d{2}$"), german_date(raw, 0)).when(raw.rlike(r"^\d{4}-"), iso.cast("date")).when(raw.rlike(" "), named.cast("date")).otherwise(long.cast("date"))


def _as_columns(layout: Layout) -> dict[str, Column]:
    values = {"bank": layout.bank, "start": layout.start, "date_at": layout.date, "look": layout.look, "which": -1 if layout.last_amount else 1, "default": layout.sign, "number": layout.number, "key": layout.key, "currency": layout.currency, "month_first": layout.bank in MONTH_FIRST}
    return {k: F.lit(v) for k, v in values.items()}


def scan(lines: DataFrame, layout: Layout, default_year: int) -> DataFrame:
    """Transactions of ``lines`` (``file``, ``line_no``, ``text``) by one layout.

    A year that a date lacks is that of the document's first full date, else ``default_year``.  Rows without a
    date or an amount are left out, as are later rows of the same date, amount and beginning of the description.
    """
    return _scan(lines.select("file", "line_no", "text").withColumns(_as_columns(layout)), default_year).drop("bank")


def scan_by_bank(lines: DataFrame, layouts: Sequence[Layout], default_year: int) -> DataFrame:
    """Transactions of ``lines``, which have the ``bank`` of their document too, each by its bank's layout, all in one scan; with ``bank``."""
    every = F.lit(None)
    for x in reversed(layouts):
        every = F.when(F.col("bank") == x.bank, F.struct(*(v.alias(k) for k, v in _as_columns(x).items()))).otherwise(every)
    return _scan(lines.withColumn("layout", every).where("layout IS NOT NULL").select("file", "line_no", "text", "layout.*"), default_year)


def _scan(lines: DataFrame, default_year: int) -> DataFrame:
    text = F.regexp_replace("text", "[−–]", "-")
    extract = lambda c, pattern, i=1: F.call_function("regexp_extract", c, pattern, F.lit(i))
    own = ["bank", "date_at", "which", "default", "number", "key", "currency", "month_first"]
    rows = lines.withColumn("text", F.trim(text))
    whole = Window.partitionBy("file")
    upto = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.nullif(F.regexp_extract("text", r"\d{2}\.\d{2}\.(\d{4})", 1), F.lit(""))
    rows = rows.withColumns({"n": F.sum(F.rlike("text", F.col("start")).cast("int")).over(upto), "year": F.coalesce(F.min(F.when(full.isNotNull(), F.struct("line_no", full.alias("y")))).over(whole)["y"].cast("int"), F.lit(default_year))})
    place = F.row_number().over(Window.partitionBy("file", "n").orderBy("line_no"))
    near = rows.where("n > 0").withColumn("place", place).where((F.col("place") <= F.col("look") + 1) & (F.col("text") != ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])  # at most look + 1
    each = near.groupBy("file", "n").agg(F.min("line_no").alias("line_no"), F.first("year").alias("year"), parts.alias("parts"), *(F.first(c).alias(c) for c in own))
    # steps of their own, so that an expression that is used twice is computed once
    marked = F.concat(F.lit(r"[+-]?\s*"), F.col("number"), F.lit(r"\s*(?:€|EUR)?\s*(?:[+-]|[SH]\b)?"))
    steps = each.withColumns({"head": F.get("parts", 0), "all_text": F.array_join("parts", " "), "marked": marked})
    steps = steps.withColumn("where", F.when(F.rlike("head", F.col("number")), F.col("head")).otherwise(F.col("all_text")))
    steps = steps.withColumn("shown", F.try_element_at(F.regexp_extract_all("where", F.concat(F.lit("("), F.col("marked"), F.lit(")")), F.lit(1)), F.col("which")))
    steps = steps.withColumns({"raw": extract(F.col("head"), F.col("date_at")), "shown": F.trim("shown"), "size": parse_amount(extract(F.col("shown"), F.concat(F.lit("("), F.col("number"), F.lit(")"))))})
    words = F.when(contains_any(F.lower("all_text"), INCOME_WORDS), 1.0).otherwise(-1.0)
    default = F.when(F.col("default") == "+", 1.0).when(F.col("default") == "-", -1.0).otherwise(words)
    sign = F.when(F.col("shown").rlike("^-|[-S]$"), -1.0).when(F.col("shown").rlike("^[+]|[+H]$"), 1.0).otherwise(default)
    dates = rf"^(?:{_FULL}|{_SHORT}/{_SHORT}|{_TWO}|{_SHORT}|\d{{2}}\.\d{{2}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}[./-]\d{{2}}[./-]\d{{4}}|\d{{2}} [A-Za-z]{{3}} \d{{4}})(?:\s+{_SHORT}(?:\s|$)|\s*/\s|\s|$)"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("head", dates, ""), F.col("marked"), F.lit("")), _FULL, "")
    description = collapse(F.concat_ws(" ", bare, F.array_join(F.expr("slice(parts, 2, 1000)"), " ")))
    out = steps.select("file", "line_no", _date(F.col("raw"), F.col("month_first"), F.col("year")).alias("booking_date"), (F.col("size") * sign).alias("amount"), "currency", description.alias("description"), "bank", "key")
    out = out.where("booking_date IS NOT NULL AND amount IS NOT NULL")
    first = Window.partitionBy("file", "booking_date", "amount", F.substring(F.col("description"), F.lit(1), F.col("key"))).orderBy("line_no")
    return out.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place", "key")


def _together(*frames: DataFrame) -> DataFrame:
    columns = ["file", "line_no", "booking_date", "amount", "currency", "description", "bank"]
    parts = [f.withColumn("currency", F.lit("EUR")) if "currency" not in f.columns else f for f in frames]
    return functools.reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def read_statements(lines: DataFrame, default_year: int, by_hand: DataFrame | None = None) -> DataFrame:
    """Transactions of all documents, each by its bank's layout, with the ``bank``; where that finds fewer than two rows, by the comprehensive reading if it finds more.

    The bank is the one that ``banks.choose_bank`` is sure of, or that ``by_hand`` (``file``, ``bank``) gives.  Documents of no
    sure bank, and those of Sparkasse with fewer than three rows, go through all ``strategies``.
    """
    bank = banks.choose_bank(lines).select("file", "bank")
    if by_hand is not None:
        bank = bank.join(by_hand.select("file", F.col("bank").alias("hand")), "file", "left").select("file", F.coalesce("hand", "bank").alias("bank"))
    # both are written, since all banks' readings start from the one, and what they leave from the other
    spark = lines.sparkSession
    rows = _kept(spark, "lines", lines.select("file", "line_no", "text").join(bank, "file"), "bank")
    commerzbank = rows.where(F.col("bank") == "Commerzbank")
    low = F.lower("text")
    has = lambda *words: functools.reduce(Column.__and__, [F.max(F.coalesce(low.contains(w), F.lit(False))).over(Window.partitionBy("file")) for w in words])
    commerzbank = commerzbank.withColumn("older", ~has("buchungstag", "umsatzart", "betrag") & (has("buchungsdatum:") | has("zu ihren lasten")))
    own = {"Consorsbank": layouts.consorsbank, "Norisbank": layouts.norisbank, "ING DiBa": layouts.ing, "Revolut": layouts.revolut}
    parts = [f(rows.where(F.col("bank") == name), default_year).withColumn("bank", F.lit(name)) for name, f in own.items()]
    parts.append(layouts.commerzbank(commerzbank.where("older").drop("older"), default_year).withColumn("bank", F.lit("Commerzbank")))
    by_row = rows.where(F.col("bank") != "Commerzbank").unionByName(commerzbank.where("NOT older").drop("older"))
    found = _together(scan_by_bank(by_row, LAYOUTS, default_year), *parts)
    by_file = Window.partitionBy("file")
    least = F.when(F.col("bank").isin("DKB", "Deutsche Bank", "Sparkasse"), 3).otherwise(2)
    found = _kept(spark, "found", found.withColumn("own", F.count("*").over(by_file)).withColumn("sure", F.col("own") >= least), "sure")
    sure, few = found.where("sure").drop("own", "sure"), found.where("NOT sure").drop("own", "sure")
    left = rows.join(sure.select("file").distinct(), "file", "left_anti")
    known, whole = F.col("bank").isin([x.bank for x in LAYOUTS] + list(own)), F.col("bank") == "Sparkasse"
    # one pass for what the own layouts left: of known banks only the comprehensive reading, of others all
    readings = strategies.german_readings(left.select("file", "line_no", "text", F.when(F.coalesce(known & ~whole, F.lit(False)), "comprehensive").alias("only")), default_year)
    bank = left.select("file", F.when(known, F.col("bank")).alias("bank")).distinct()
    other = _together(strategies.choose(readings, strategies.GERMAN, 3).join(bank, "file"))
    both = few.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)))
    n = lambda side: F.count(F.when(F.col("side") == side, 1)).over(by_file)
    both = both.withColumns({"own": n(0), "more": n(1)})
    return sure.unionByName(both.where((F.col("side") == 1) == (F.col("more") > F.col("own"))).drop("side", "own", "more"))


def _kept(spark: SparkSession, purpose: str, rows: DataFrame, by: str) -> DataFrame:
    """``rows`` as they are written to the shared folder, apart by a column of few values."""
    folder = shared_folder(spark, purpose)
    rows.write.partitionBy(by).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _forms(day: Column, cents: Column, text: Column) -> list[tuple[str, list[str], list[Column]]]:
    """Banks, what stands at the head of their statements, and a transaction's lines as each prints them."""
    dated = lambda p: F.date_format(day, p)
    full, short, size = dated("dd.MM.yyyy"), dated("dd.MM."), strategies.amount_text(cents)
    debit = cents < 0
    sign = F.when(debit, "-").otherwise("+")
    signed = F.concat(sign, size)
    row = lambda *parts: F.concat_ws(" ", *parts)
    year = "Auszug 01.01.2024"
    english = F.format_number(F.abs(cents) / 100, 2)
    return [
        ("Sparkasse", ["Sparkasse Musterstadt"], [row(full, text, signed)]),
        ("DKB", ["DKB AG, dkb.de", year], [row(short, short, text, signed)]),
        ("Deutsche Bank", ["Deutsche Bank AG", year], [row(short, short, text, sign, size)]),
        ("Postbank", ["Postbank AG", year], [row(F.concat(short, F.lit("/"), short), text, signed)]),
        ("Commerzbank", ["Commerzbank AG"], [row(full, text, sign, size, F.lit("EUR"))]),
        ("Volksbank/VR-Bank", ["VR-Bank", year], [row(short, short, text, size, F.when(debit, "S").otherwise("H"))]),
        ("C24 Bank", ["C24 Bank", year], [row(short, short, text, signed)]),
        ("TARGOBANK", ["TARGOBANK", year], [row(dated("dd.MM"), F.lit("PN"), text, signed)]),
        ("1822direkt", ["1822direkt"], [row(full, text, signed, F.lit("€"))]),
        ("Tomorrow", ["Tomorrow Bank"], [row(full, F.lit("/"), text, signed, F.lit("€"))]),
        ("N26", ["N26 Bank"], [row(text, full, F.concat(signed, F.lit("€")))]),
        ("apoBank", ["apoBank"], [row(full, text, signed)]),
        ("bunq", ["www.bunq.com"], [row(dated("yyyy-MM-dd"), text, F.concat(sign, english))]),
        ("Sparda-Bank", ["Sparda-Bank"], [row(full, text, full, signed)]),
        ("Oldenburgische Landesbank", ["OLB AG"], [row(dated("dd.MM.yy"), short, text, signed)]),
        ("Commerzbank", ["Commerzbank AG"], [row(F.lit("Buchungsdatum:"), full), row(text, dated("dd.MM"), F.concat(size, F.when(debit, "-").otherwise(""))), F.lit("mehr dazu")]),
        ("Consorsbank", ["Consorsbank", "Datum 01.01.24"], [row(F.lit("LASTSCHRIFT"), short, F.lit("8999"), short, F.concat(size, sign)), text]),
        ("Norisbank", ["norisbank", "Kontoauszug vom 01.01.2024 bis 31.12.2024"], [row(F.lit("Kartenzahlung"), sign, size), row(F.lit("Name zu"), text), row(short, short), F.lit("Verwendungszweck/ Kundenreferenz"), text]),
        ("ING DiBa", ["ING-DiBa AG"], [row(full, F.lit("Lastschrift"), text, F.concat(F.when(debit, "-").otherwise(""), size)), full]),
        ("Revolut", ["Revolut", "Money out Money in"], [row(dated("MMM d, yyyy"), F.when(debit, text).otherwise(row(F.lit("Payment from"), text)), F.concat(F.lit("€"), english))]),
    ]


def printed_statements(rows: DataFrame) -> DataFrame:
    """``file``, ``line_no``, ``text`` and ``form`` of statements (``strategies.numbered``), each in the form of one of the banks."""
    forms = _forms(F.col("booking_date"), F.col("amount_cents"), F.concat(F.lit("Posten "), "k", F.lit(" "), "description"))
    form, texts, heads = (F.col("statement_id") % len(forms)).cast("int"), F.lit(None).cast("array<string>"), F.array(*(F.array(*map(F.lit, h)) for _, h, _ in forms))
    for i, (_, _, own) in enumerate(forms):
        texts = F.when(form == i, F.array(*(c.cast("string") for c in own))).otherwise(texts)
    file = F.concat(F.lit("s"), "statement_id").alias("file")
    body = rows.select(file, form.alias("form"), "k", F.posexplode(texts).alias("i", "text")).select("file", (F.col("k") * 100 + F.col("i")).alias("line_no"), "text", "form")
    head = rows.where("k = 1").select(file, form.alias("form"), F.posexplode(F.get(heads, form)).alias("i", "text")).select("file", F.col("i").alias("line_no"), "text", "form")
    return head.unionByName(body)


_NAMES = ["Sparkasse", "DKB", "Deutsche Bank", "Postbank", "Commerzbank", "Volksbank/VR-Bank", "C24 Bank", "TARGOBANK", "1822direkt", "Tomorrow", "N26", "apoBank", "bunq", "Sparda-Bank", "Oldenburgische Landesbank", "Commerzbank", "Consorsbank", "Norisbank", "ING DiBa", "Revolut"]


@query(
    strategies.NUMBERED
    + f""", told AS (SELECT *, statement_id % {len(_NAMES)} AS form, 'Posten ' || k || ' ' || description AS said FROM numbered)
SELECT 's' || statement_id AS file, {_NAMES!r}[1 + form] AS bank, sign * size AS amount,
  CASE WHEN form IN (1, 2, 3, 5, 6, 7, 16, 17) THEN make_date(2024, month(booking_date), day(booking_date)) ELSE booking_date END AS booking_date,
  CASE form WHEN 7 THEN 'PN ' || said WHEN 15 THEN said || ' mehr dazu' WHEN 18 THEN 'Lastschrift: ' || said WHEN 19 THEN CASE WHEN sign > 0 THEN 'Payment from ' ELSE '' END || said ELSE said END AS description FROM told"""
)
def statement_lines_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements, printed as lines in the forms of all banks, and read again; the bank that names itself too weakly is given by hand."""
    lines = _kept(spark, "printed", printed_statements(strategies.numbered(spark, sf_dir)), "form")
    by_hand = lines.where(F.col("form") == len(_NAMES) - 1).select("file", F.lit("Revolut").alias("bank")).distinct()
    return read_statements(lines, 2024, by_hand).select("file", "bank", "booking_date", "amount", "description")
