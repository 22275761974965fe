"""Statements of single banks whose date, amount and text stand in different lines.

What a line needs from others comes from windows over its document: the date of the header before it, the year of the first header, the next
line with dates, the lines up to the next beginning.  Where a scan takes lines that could begin a transaction of their own,
``strategies.blocks_of`` chooses.  Lines have ``file``, ``line_no`` and ``text``; a null text is a blank line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyforge.functions.text import collapse, contains_any, once
from tallyforge.functions.values import german_date
from tallyforge.sources import strategies as st


def _file() -> WindowSpec:
    return Window.partitionBy("file")


def _order() -> WindowSpec:
    return _file().orderBy("line_no")


def _upto() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _place() -> Column:
    return F.col("idx")


def numbered_lines(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return lines.select("file", "line_no", text.alias("text")).withColumns({"idx": F.row_number().over(_order()), "low": F.lower("text"), "blank": F.col("text") == ""})


def _ahead(flag: Column, look: int) -> Column:
    """The places of flagged lines among the next ``look``, in order."""
    return F.collect_list(F.when(flag, _place())).over(_order().rowsBetween(1, look))


def _first_after(places: Column, place: Column) -> Column:
    return F.array_min(F.filter(places, lambda x: x > place))


def _until(start: Column, stop: Column, look: int) -> Column:
    """The beginning of a line's block: the last start before it, if no ``stop`` and fewer than ``look`` lines stand between."""
    event = F.last(F.when(start | stop, F.struct(_place().alias("at"), start.alias("is_start"))), True).over(_upto())
    return F.when(event["is_start"] & (_place() - event["at"] < look), event["at"])


def _found(rows: DataFrame, blocks: list, parsed: Column, *carried: str) -> DataFrame:
    return st.told(st.gathered(rows, blocks, *carried), parsed, "file", "strategy", "line_no")


def _texts(skip_first: bool = False) -> Column:
    parts = F.slice("parts", 2, 1000) if skip_first else F.col("parts")  # a block has a limited look
    return F.transform(F.filter(parts, lambda p: (p["text"] != "") & ~p["header"]), lambda p: p["text"])


# ---- a header's date for all that follows

# Headers, footers and balances.
_COMMERZBANK_PARTS = ["alter kontostand", "neuer kontostand", "neuer saldo", "alter saldo", "kontowährung", "zu ihren lasten", "zu ihren gunsten", "kontostand", "saldo", "summe", "übertrag", "seite ", "angaben zu den umsätzen"]
_COMMERZBANK_LINE = r"^(.+?)\s+(\d{2}\.\d{2})\s+(\d{1,3}(?:[\s.]\d{3})*,\d{2})\s*(-)?$"
_COMMERZBANK_DATE = r"(?i)Buchungsdatum:\s*(\d{2}\.\d{2}\.\d{4})"


def commerzbank(lines: DataFrame, year: int) -> DataFrame:
    """Text, value date without a year and amount in one line, below a header with the booking date; later lines go on with the text."""
    rows = numbered_lines(lines)
    low, text = F.col("low"), F.col("text")
    begins_date = text.rlike(_COMMERZBANK_DATE)
    other = contains_any(low, _COMMERZBANK_PARTS) | (low.contains("buchungstag") & low.contains("umsatzart")) | (low.contains("valuta") & (F.length(low) < 20)) | low.startswith("betrag") | low.startswith("buchungstext") | st.is_header(text)
    rows = rows.withColumns({"day": begins_date, "other": ~F.col("blank") & other & ~begins_date})
    rows = rows.withColumn("begins", ~F.col("day") & ~F.col("other") & text.rlike(_COMMERZBANK_LINE))
    current = F.last(F.when(F.col("day"), german_date(F.regexp_extract(text, _COMMERZBANK_DATE, 1), year)), True).over(_upto())
    rows = rows.withColumns({"current": current, "block": _until(F.col("begins"), F.col("day") | F.col("other"), 20)})
    head = st.head_line()
    group = lambda i: F.regexp_extract(head, _COMMERZBANK_LINE, i)
    value = german_date(F.concat(group(2), F.lit("."), F.coalesce(F.year("current"), F.lit(year)).cast("string")), year)
    size = st.number(F.replace(group(3), F.lit(" "), F.lit("")))
    description = collapse(F.concat_ws(" ", group(1), F.array_join(_texts(skip_first=True), " ")))
    amount = F.when(group(4) == "-", -size).otherwise(size)
    parsed = once(description, lambda d: st.result(F.coalesce("current", value), value, amount, d, F.concat_ws("\n", group(1), F.array_join(_texts(skip_first=True), "\n")), (d != "") & ~st.is_balance(d, d)))
    return st.distinct(_found(rows, [("headers", F.col("block"), text, F.lit(False))], parsed, "current"), size=30)


# Types that begin a transaction, the more special ones first, and headers and footers.
_CONSORSBANK_TYPES = [
    "EURO-UEBERW", "D-GUTSCHRIFT", "GUTSCHRIFT", "LASTSCHRIFT", "DAUERAUFTRAG", "UEBERWEISUNG", "ÜBERWEISUNG", "KARTENZAHLUNG", "GEHALT/RENTE", "GEHALT", "LOHN/GEHALT", "LOHN",
    "SEPA-LASTSCHRIFT", "SEPA-ÜBERWEISUNG", "SEPA-GUTSCHRIFT", "ABSCHLUSS", "ZINSEN", "ENTGELT", "AUSZAHLUNG", "EINZAHLUNG",
]
_CONSORSBANK_PARTS = [
    "text/verwendungszweck", "bankleitzahl", "kontowährung", "buchungssaldo", "kontostand", "summe", "übertrag", "90318 nürnberg", "consorsbank ist eine", "bnp paribas", "standort nürnberg", "bahnhofstraße", "fon +49",
    "sitz der bnp", "président", "registergericht", "info@consorsbank", "hrb nürnberg", "ust-idnr", "generaldirektor", "verwaltungsrat",
]
_CONSORSBANK_STARTS = ["blatt ", "kontonummer", "kontotyp", "kontoinhaber", "vermerk"]
_CONSORSBANK_AMOUNT = r"(\d{1,3}(?:\.\d{3})*,\d{2})\s*([+-])\s*$"
_TECHNICAL = r"(?i)^VISA\s+.*|^<.*|^\d{2}\.\d{2}\.\s+\d+$|^\d+,\d{2}\s*EUR$|.*DE\d{18,22}.*|^\d{6,}$|^T\d{10,}$"


def _consorsbank_header(text: Column) -> Column:
    low = F.lower(text)
    starts = F.lit(False)
    for s in _CONSORSBANK_STARTS:
        starts = starts | low.startswith(s)
    for s, size in (("iban", 50), ("bic", 20), ("datum", 30)):
        starts = starts | (low.startswith(s) & (F.length(low) < size))
    return (
        text.rlike(r"^\d{1,3}(?:\.\d{3})*,\d{2}[+-]$") | (low.contains("soll") & low.contains("haben") & (F.length(low) < 50)) | (low.contains("kontoauszug") & (low.contains("konto-nr") | low.contains("blatt")))
        | contains_any(low, _CONSORSBANK_PARTS) | (low.contains("saldo") & (F.length(low) < 30)) | starts | text.rlike(r"^\d{5}\s+\w+$") | (low.contains("consorsbank ") & low.contains("nürnberg")) | st.is_header(text)
    )


def _named(texts: Column) -> Column:
    """The first line that looks like a name; fragments of up to three characters are put together, technical lines left out."""
    flush = lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
    kind = "struct<done:array<string>,open:string>"

    def step(a: Column, t: Column) -> Column:
        short = F.struct(a["done"].alias("done"), F.when(a["open"] == "", t).otherwise(F.concat_ws(" ", a["open"], t)).alias("open")).cast(kind)
        return F.when(t.rlike(_TECHNICAL), F.struct(flush(a).alias("done"), F.lit("").alias("open")).cast(kind)).when(F.length(t) <= 3, short).otherwise(F.struct(F.concat(flush(a), F.array(t)).alias("done"), F.lit("").alias("open")).cast(kind))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")).cast(kind)
    joined = F.aggregate(texts, start, step, flush)
    letters = lambda size: F.get(F.filter(joined, lambda x: x.rlike(r"\p{L}") & (F.length(x) >= size)), 0)
    return F.coalesce(letters(3), letters(2))


def consorsbank(lines: DataFrame, year: int) -> DataFrame:
    """A known type, dates without a year and a marked amount in one line, the year from the first header; the lines behind tell the counterparty."""
    rows = numbered_lines(lines)
    text = F.col("text")
    upper = F.upper(text)
    typed = F.lit(False)
    for t in _CONSORSBANK_TYPES:
        typed = typed | upper.startswith(t)
    halt = text.contains("Kontostand") | text.contains("***") | _consorsbank_header(text)
    rows = rows.withColumns({"halt": ~F.col("blank") & halt, "typed": typed & text.rlike(_CONSORSBANK_AMOUNT)})
    rows = rows.withColumn("begins", F.col("typed") & ~F.col("halt") & F.regexp_extract(text, rf"^(.*?){_CONSORSBANK_AMOUNT}", 1).rlike(r"\d{2}\.\d{2}"))
    two = F.regexp_extract(text, r"(?i)Datum\s+\d{2}\.\d{2}\.(\d{2})\b", 1).try_cast("int")
    four = F.regexp_extract(text, r"\d{2}\.\d{2}\.(\d{4})", 1).try_cast("int")
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("idx", c.alias("y")))).over(_file())["y"]
    rows = rows.withColumns({"y2": first(two), "y4": first(four)})
    rows = rows.withColumns({"own_year": F.coalesce(F.when(F.col("y2") > 50, F.col("y2") + 1900).otherwise(F.col("y2") + 2000), "y4", F.lit(year)), "block": _until(F.col("begins"), F.col("halt") | F.col("typed"), 25)})
    head = st.head_line()
    before = F.regexp_extract(head, rf"^(.*?){_CONSORSBANK_AMOUNT}", 1)
    days = F.regexp_extract_all(before, F.lit(r"(\d{2}\.\d{2})\.?"), F.lit(1))
    dated = lambda i: german_date(F.concat(F.element_at(days, i), F.lit("."), F.col("own_year").cast("string")), year)
    size = st.number(F.regexp_extract(head, _CONSORSBANK_AMOUNT, 1))
    kind = F.coalesce(*(F.when(F.upper(head).startswith(t), t) for t in _CONSORSBANK_TYPES))
    name = F.coalesce(_named(_texts(skip_first=True)), kind)
    amount = F.when(F.regexp_extract(head, _CONSORSBANK_AMOUNT, 2) == "-", -size).otherwise(size)
    parsed = once(name, lambda d: st.result(dated(1), dated(-1), amount, d, F.array_join(_texts(), "\n"), F.lit(True)))
    return st.distinct(_found(rows, [("types", F.col("block"), text, F.lit(False))], parsed, "own_year"), size=30)


# ---- the date behind the amount

_NORISBANK_AMOUNT = r"([+−-])\s*(\d{1,3}(?:\.\d{3})*,\d{2})\s*$"
_NORISBANK_DAYS = r"^(\d{2}\.\d{2}\.)\s+(\d{2}\.\d{2}\.)\s*$"
_PURPOSE = "verwendungszweck/ kundenreferenz"


def norisbank(lines: DataFrame, year: int) -> DataFrame:
    """A type and a signed amount, then perhaps a name, then a line with two dates, then the text, up to the next amount."""
    rows = numbered_lines(lines)
    low, text = F.col("low"), F.col("text")
    both = lambda a, b: low.contains(a) & low.contains(b)
    header = both("buchung", "valuta") | (low.contains("vorgang") & (low.contains("soll") | low.contains("haben"))) | contains_any(low, ["kontoauszug vom", "kontoinhaber:", "alter saldo", "neuer saldo"]) | (both("auszug", "seite") & low.contains("iban"))
    kind = F.trim(F.regexp_replace(low, _NORISBANK_AMOUNT, ""))
    rows = rows.withColumns({"header": header, "priced": text.rlike(_NORISBANK_AMOUNT), "days": text.rlike(_NORISBANK_DAYS)})
    rows = rows.withColumn("may_begin", F.col("priced") & ~F.col("header") & ~kind.contains("saldo") & ~(kind.contains("eur") & (F.length(kind) < 10)))
    own_year = F.min(F.when(text.rlike(r"(?i)Kontoauszug\s+vom\s+\d{2}\.\d{2}\.\d{4}"), F.struct("idx", F.regexp_extract(text, r"(?i)Kontoauszug\s+vom\s+\d{2}\.\d{2}\.(\d{4})", 1).cast("int").alias("y")))).over(_file())["y"]
    rows = rows.withColumns({"own_year": F.coalesce(own_year, F.lit(year)), "halt": F.coalesce(F.array_min(_ahead(F.col("header"), 14)), _place() + 15), "day_at": F.array_min(_ahead(F.col("days"), 14)), "prices": _ahead(F.col("priced"), 14)})
    dated = F.when(F.col("may_begin") & (F.col("day_at") < F.col("halt")), F.col("day_at"))
    rows = rows.withColumn("n_next", F.when(dated.isNotNull(), F.least("halt", F.coalesce(_first_after(F.col("prices"), F.col("day_at")), F.col("halt")))))
    rows = rows.withColumn("n_last", F.col("n_next") - 1).select("file", "line_no", "idx", "text", "own_year", "days", "n_next", "n_last")
    taken = st.blocks_of(rows, [("n", "idx")])
    head, own = st.head_line(), _texts(skip_first=True)
    size = st.number(F.regexp_extract(head, _NORISBANK_AMOUNT, 2))
    amount = F.when(F.regexp_extract(head, _NORISBANK_AMOUNT, 1).isin("-", "−"), -size).otherwise(size)
    kind = F.trim(F.regexp_replace(head, _NORISBANK_AMOUNT, ""))

    def read(texts: Column) -> Column:
        at = F.array_position(F.transform(texts, lambda t: t.rlike(_NORISBANK_DAYS)), True).cast("int")
        days = F.get(texts, at - 1)
        day = lambda i: german_date(F.concat(F.regexp_extract(days, _NORISBANK_DAYS, i), F.col("own_year").cast("string")), year)
        behind = F.filter(F.slice(texts, at + 1, F.size(texts)), lambda t: F.lower(t) != _PURPOSE)
        description = F.coalesce(F.nullif(F.trim(F.array_join(behind, " ")), F.lit("")), kind)
        raw = F.concat_ws("\n", kind, F.array_join(behind, "\n"))
        return st.result(day(1), day(2), amount, description, raw, F.lit(True))

    found = st.gathered(taken, [("behind", F.col("n_block"), F.col("text"), F.lit(False))], "own_year")
    before = F.get(F.filter(F.slice(own, 1, F.greatest(F.array_position(F.transform(own, lambda t: t.rlike(_NORISBANK_DAYS)), True).cast("int") - 1, F.lit(0))), lambda t: ~F.lower(t).startswith("verwendungszweck")), 0)
    found = found.withColumns({"r": once(own, read), "before": before, "kind": kind}).where("r IS NOT NULL")
    place, shop = F.regexp_extract("r.description", "//(.+?)/DE", 1), F.trim(F.regexp_extract("r.description", "^(.+?)//", 1))
    cash = contains_any(F.lower("kind"), ["bargeldauszahlung", "gaa"])
    name = F.when(F.lower("kind").rlike(r"von\s*$"), F.lit(None)).when(cash, F.concat_ws(" ", F.lit("ATM"), F.nullif(place, F.lit("")))).when(F.lower("kind").contains("kartenzahlung"), F.nullif(shop, F.lit("")))
    found = found.withColumn("counterparty", F.coalesce("before", name)).select("file", "strategy", "line_no", "counterparty", "r.*")
    return st.distinct(found.withColumn("key", F.coalesce("counterparty", F.lit(""))), by="key").drop("key")


# ---- three readings, the first that finds anything

# Types and footers.
_ING_TYPES = [
    "Lastschrift", "Gutschrift", "Überweisung", "Dauerauftrag", "Gehalt", "Lohn", "Kartenzahlung", "Bargeldauszahlung", "Abschluss", "Zinsen", "Entgelt", "Einzahlung", "Auszahlung", "SEPA-Lastschrift", "SEPA-Überweisung",
    "Kontoführung", "Habenzinsen", "Sollzinsen", "Abgeltungsteuer", "Kapitalertragsteuer", "Geldautomat", "Echtzeitüberweisung", "Dauerauftrag/Terminüberw.",
]
_ING_FOOTERS = ["ING-DiBa AG", "www.ing.de", "Theodor-Heuss-Allee"]
_DAY = r"^(\d{2}\.\d{2}\.\d{4})"
_ING_END = r"(-?[\d.]+,\d{2})\s*$"
_ING_AMOUNT = r"([+-]\s*)?(-?\d{1,3}(?:\.\d{3})*,\d{2})(?:\s|$)"
ING = ("typed", "dated", "block")


def ing(lines: DataFrame, year: int) -> DataFrame:
    """Lines of date, type, text and amount with details behind; else dates with an amount in their line; else blocks between blank lines."""
    rows = numbered_lines(lines)
    text = F.col("text")
    dated = german_date(F.regexp_extract(text, _DAY, 1), year).isNotNull() & text.rlike(_DAY)
    after = F.trim(F.regexp_replace(text, _DAY, ""))
    typed = F.lit(False)
    for t in _ING_TYPES:
        typed = typed | F.lower(after).startswith(t.lower())
    footer = (text.contains("Seite") & text.contains("von")) | contains_any(text, _ING_FOOTERS)
    rows = rows.withColumns({"begins": text.rlike(_DAY) & typed, "dated": dated, "footer": footer, "day": text.rlike(_DAY), "priced": text.rlike(_ING_AMOUNT)})
    upcoming = F.first(F.when(~F.col("blank"), F.col("begins")), True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("pause", F.col("blank") & F.coalesce(upcoming, F.lit(False)))
    rows = rows.withColumns({"pauses": _ahead(F.col("pause"), 15), "days": _ahead(F.col("dated"), 15), "starts": _ahead(F.col("begins"), 15), "gap": F.coalesce(F.last(F.when(F.col("blank"), _place()), True).over(_upto()), F.lit(0))})
    halt = F.coalesce(_first_after(F.col("pauses"), _place() + 1), _place() + 16)
    rows = rows.withColumn("halt", halt).withColumn("second", F.when(F.array_min("days") < F.col("halt"), F.array_min("days")))
    end = F.least("halt", F.coalesce(_first_after(F.col("starts"), F.coalesce("second", _place())), F.col("halt")))
    # the second reading takes four lines; what it takes begins with no date, so it is never a beginning
    follow = F.last(F.when(F.col("day"), F.struct(_place().alias("at"), F.col("priced").alias("p"))), True).over(_upto())
    rows = rows.withColumns({"a_next": F.when(F.col("begins"), end), "b_block": F.when(follow["p"] & (_place() - follow["at"] <= 4) & (F.col("gap") < follow["at"]), follow["at"])})
    rows = rows.withColumn("a_last", F.col("a_next") - 1).select("file", "line_no", "idx", "text", "blank", "footer", "day", "priced", "b_block", "gap", "a_next", "a_last")
    taken = st.blocks_of(rows, [("a", "idx")])
    blocks = [("typed", F.col("a_block"), text, F.col("footer")), ("dated", F.col("b_block"), text, F.col("footer") | (F.col("priced") & ~F.col("day"))), ("block", F.when(~F.col("blank") & ~F.col("footer"), F.col("gap")), text, F.col("footer"))]
    head = st.head_line()
    booking = german_date(F.regexp_extract(head, _DAY, 1), year)

    def read_typed() -> Column:
        own = F.trim(F.regexp_replace(head, _DAY, ""))
        kind = F.coalesce(*(F.when(F.lower(own).startswith(t.lower()), t) for t in _ING_TYPES))
        said = F.trim(F.regexp_replace(F.substring(own, F.length(kind) + 1, F.length(own)), _ING_END, ""))
        rest = _texts(skip_first=True)
        at = F.array_position(F.transform(rest, lambda t: t.rlike(_DAY)), True).cast("int")
        value = german_date(F.regexp_extract(F.get(rest, at - 1), _DAY, 1), year)
        more = F.filter(F.transform(rest, lambda t, i: F.when(i == at - 1, F.trim(F.regexp_replace(t, _DAY, ""))).otherwise(t)), lambda t: (t != "") & ~t.rlike("(?i)^(?:Mandat|Referenz):") & ~(t.contains("Buchung") & t.contains("Verwendungszweck")))
        parts = F.array_join(F.filter(F.concat(F.array(said), more), lambda t: t != ""), " ")
        description = F.when(parts == "", kind).otherwise(F.concat(kind, F.lit(": "), parts))
        return st.result(booking, value, st.number(F.regexp_extract(F.substring(own, F.length(kind) + 1, F.length(own)), _ING_END, 1)), description, F.array_join(_texts(), "\n"), F.lit(True))

    def read_dated() -> Column:
        behind = F.trim(F.regexp_replace(head, _DAY, ""))
        said = F.trim(F.regexp_extract(behind, rf"^(.*?){_ING_AMOUNT}", 1))
        said = F.coalesce(F.nullif(said, F.lit("")), F.trim(F.regexp_replace(behind, _ING_AMOUNT, "")))
        description = F.trim(F.concat_ws(" ", said, F.nullif(F.array_join(_texts(skip_first=True), " "), F.lit(""))))
        return st.result(booking, booking, st.signed_amount(head, _ING_AMOUNT), F.coalesce(F.nullif(description, F.lit("")), F.lit("Transaction")), head, F.lit(True))

    def read_block() -> Column:
        pattern = rf"({st.DATE})(.*?)({st.AMOUNT})"
        whole = F.array_join(F.transform("parts", lambda p: p["text"]), " ")

        def of(w: Column) -> Column:
            said = F.trim(F.regexp_extract(w, pattern, 2))
            return st.result(german_date(F.regexp_extract(w, pattern, 1), year), F.lit(None).cast("date"), st.signed_amount(F.regexp_extract(w, pattern, 3), st.AMOUNT), F.coalesce(F.nullif(said, F.lit("")), F.lit("Transaction")), w, F.lit(True), said == "")

        return once(whole, of)

    strategy = F.col("strategy")
    parsed = F.when(strategy == "typed", read_typed()).when(strategy == "dated", read_dated()).otherwise(read_block())
    return st.choose(st.distinct(_found(taken, blocks, parsed), ING[:2]), ING, 1)


# ---- five readings, the first with enough

_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_EURO = r"€([\d,]+\.\d{2})"
_MDY_START = rf"(?i)^({_MONTH}\s+\d{{1,2}},?\s+\d{{4}})"
_DMY, _MDY, _NUMERIC, _ISO = rf"(?i)(\d{{1,2}}\s+{_MONTH}\s+\d{{4}})", rf"(?i)({_MONTH}\s+\d{{1,2}},?\s+\d{{4}})", r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})", r"(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})"
_TABLE_AMOUNT = r"([€£$])?\s*(-?)\s*(\d{1,3}(?:[,']\d{3})*(?:\.\d{2})?|\d+(?:\.\d{2})?)"
_LINE_AMOUNT = r"([+-])?\s*([€£$])?\s*(\d{1,3}(?:[,']\d{3})*\.\d{2})"
_LINE_DATE = rf"(?i)(\d{{1,2}}\s+{_MONTH}(?:\s+\d{{4}})?)"
_BLOCK_DATE = rf"(?i)(\d{{1,2}}\s+{_MONTH}\s*(?:\d{{4}})?)"
# What tells income and expense.
_INCOME_EN = ["payment from", "received from", "refund", "cashback", "interest"]
_INCOME_DE = ["zahlung von", "von:", "payment from", "received", "gutschrift", "eingang", "überweisung von"]
REVOLUT = ("english", "german", "table", "line", "block")


def _revolut_header(low: Column) -> Column:
    both = lambda a, b: low.contains(a) & low.contains(b)
    return both("page", "of") | both("statement", "account") | (both("date", "description") & low.contains("amount")) | both("money in", "money out") | both("total", "balance") | contains_any(low, ["opening balance", "closing balance", "revolut ltd", "generated on"]) | (F.length(low) < 5)


def _dated_in(text: Column) -> Column:
    """A date by the name of its month, first day then month, else month then day, else in numbers, day first, else ISO."""
    found = F.lit(None).cast("date")
    for pattern, form in reversed([(_DMY, "DD_MMM_YYYY"), (_MDY, "MMM_DD_YYYY"), (_NUMERIC, "DD_MM_YYYY"), (_ISO, "YYYY_MM_DD")]):
        found = F.when(text.rlike(pattern), st.foreign_date(F.regexp_extract(text, pattern, 1), F.lit(form))).otherwise(found)
    return found


def _short_date(text: Column, year: int) -> Column:
    """Day and month by name; a missing year is ``year``."""
    whole = F.when(text.rlike(r"\d{4}$"), text).otherwise(F.concat_ws(" ", F.trim(text), F.lit(str(year))))
    return st.foreign_date(F.regexp_replace(whole, r"(?i)([a-z])(\d{4})$", "$1 $2"), F.lit("DD_MMM_YYYY"))


def _first_amount(text: Column, pattern: str, sign: int, default: float) -> Column:
    """The first amount that is not zero."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda m: F.regexp_replace(F.regexp_extract(m, pattern, 3), "[,']", "").try_cast("double")
    mark = lambda m: F.when(F.regexp_extract(m, pattern, sign) == "-", -1.0).when(F.regexp_extract(m, pattern, sign) == "+", 1.0).otherwise(default)
    return F.get(F.transform(F.filter(every, lambda m: size(m) != 0), lambda m: size(m) * mark(m)), 0)


def revolut(lines: DataFrame, year: int, enough: int = 3) -> DataFrame:
    """Columns in English or German, a table, single lines, or blocks; with the ``currency`` that a document names, EUR if none.

    In a table the first number of a line that is not zero is the amount, be it the day of its date.
    """
    rows = numbered_lines(lines)
    low, text = F.col("low"), F.col("text")
    both = lambda a, b: low.contains(a) & low.contains(b)
    english = both("money out", "money in") | (both("date", "description") & low.contains("balance"))
    german = contains_any(low, ["geldausgang", "geldeingang", "kontotransaktionen"])
    en_header = english | both("page", "of") | both("statement", "period") | contains_any(low, ["account number", "sort code"])
    de_header = both("datum", "beschreibung") | both("geldausgang", "geldeingang") | both("kontostand", "geld") | both("kontotransaktionen", "bis") | both("seite", "von") | both("page", "of")
    sniffed = [(contains_any(low, ["£", "gbp", "pound"]), "GBP"), (contains_any(low, ["$", "usd"]), "USD"), (contains_any(low, ["chf"]), "CHF"), (contains_any(low, ["pln", "zł"]), "PLN")]
    currency = F.lit("EUR")
    for hit, name in reversed(sniffed):
        currency = F.when(F.max(hit).over(_file()), name).otherwise(currency)
    rows = rows.withColumns({
        "currency": currency, "is_en": F.max(english).over(_file()), "is_de": F.max(german).over(_file()), "en_header": en_header, "de_header": de_header, "header": _revolut_header(low) & ~F.col("blank"),
        "en_day": text.rlike(_MDY_START), "de_day": text.rlike(_DAY), "euro": text.rlike(_EURO), "date": _dated_in(text), "amount": text.rlike(_TABLE_AMOUNT),
    })
    goes_on = text.rlike("^(?:Reference:|From:|To:|Card:|Revolut Rate)") | (~F.col("euro") & (F.length(text) < 100))
    goes_on_de = text.rlike("^(?:Von:|An:)") | (text.contains("DE") & (F.length(text) < 50)) | ~F.col("euro")
    en_begins = F.col("is_en") & F.col("en_day") & ~F.col("en_header") & F.col("euro")
    de_begins = F.col("is_de") & F.col("de_day") & ~F.col("de_header") & F.col("euro")
    far = 1 << 30
    # in a table, a line with a date and an amount begins and takes up to two lines without a date
    t_begins = ~F.col("header") & F.col("date").isNotNull() & F.col("amount")
    rows = rows.withColumns({
        "e": _until(en_begins, F.col("blank") | F.col("en_day") | F.col("en_header") | ~goes_on, far), "g": _until(de_begins, F.col("blank") | F.col("de_day") | F.col("de_header") | ~goes_on_de, far),
        "t": _until(t_begins, F.col("blank") | F.col("date").isNotNull(), 3), "gap": F.coalesce(F.last(F.when(F.col("blank"), _place()), True).over(_upto()), F.lit(0)),
        "l": F.when(~F.col("blank") & ~F.col("header") & text.rlike(_LINE_DATE) & text.rlike(_LINE_AMOUNT), _place()),
    })
    head = st.head_line()
    none = F.lit(False)
    blocks = [
        ("english", F.col("e"), text, none), ("german", F.col("g"), text, none), ("table", F.col("t"), text, (F.col("header") | F.col("amount")) & ~t_begins), ("line", F.col("l"), text, none),
        ("block", F.when(~F.col("blank") & ~F.col("header"), F.col("gap")), text, none),
    ]
    plain = lambda t: F.regexp_replace(F.regexp_extract(t, _EURO, 1), ",", "").try_cast("double")

    def columns(start: str, day: Column, income: list[str]) -> Column:
        behind = F.trim(F.regexp_replace(head, start, ""))
        said = F.when(behind.startswith("€") & F.lit(start == _MDY_START), behind).otherwise(F.trim(F.regexp_replace(behind, "€[\\d,]+\\.\\d{2}.*$", "")))
        description = F.trim(F.concat_ws(" ", F.nullif(said, F.lit("")), F.nullif(F.array_join(F.transform(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: p["text"]), " "), F.lit(""))))
        return once(description, lambda d: st.result(day, day, F.when(contains_any(F.lower(d), income), plain(head)).otherwise(-plain(head)), F.substring(d, 1, 200), head, (F.length(d) > 2) & (plain(head) > 0)))

    def free(w: Column, day: Column, amount: Column, dates: list[str], amount_pattern: str, least: int, more: Column | None = None) -> Column:
        bare = collapse(F.regexp_replace(st.without(w, *dates, amount_pattern, by=""), "[€£$]" if more is not None else "[€£$+-]", ""))
        description = bare if more is None else F.trim(F.concat_ws(" ", bare, F.nullif(more, F.lit(""))))
        return once(description, lambda d: st.result(day, day, amount, F.substring(d, 1, 200), w, F.length(d) > least))

    whole = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    s = F.col("strategy")
    parsed = (
        F.when(s == "english", columns(_MDY_START, st.foreign_date(F.regexp_extract(head, _MDY_START, 1), F.lit("MMM_DD_YYYY")), _INCOME_EN))
        .when(s == "german", columns(_DAY, german_date(F.regexp_extract(head, _DAY, 1), year), _INCOME_DE))
        .when(s == "table", free(head, _dated_in(head), _first_amount(head, _TABLE_AMOUNT, 2, 1.0), [_DMY, _MDY, _NUMERIC, _ISO], _TABLE_AMOUNT, 2, F.array_join(_texts(skip_first=True), " ")))
        .when(s == "line", free(head, _short_date(F.regexp_extract(head, _LINE_DATE, 1), year), _first_amount(head, _LINE_AMOUNT, 1, -1.0), [_LINE_DATE], _LINE_AMOUNT, 2))
        .otherwise(once(whole, lambda w: free(w, _short_date(F.regexp_extract(w, _BLOCK_DATE, 1), year), _first_amount(w, _LINE_AMOUNT, 1, -1.0), [_BLOCK_DATE], _LINE_AMOUNT, 3)))
    )
    found = st.told(st.gathered(rows, blocks, "currency"), parsed, "file", "strategy", "line_no", "currency")
    return st.choose(st.distinct(found), REVOLUT, enough)
