"""Statements of unknown layout: several readings of a document in one ordered pass, and a choice by what each finds.

Every line is marked once (dates, amounts, blank, header).  Windows over a document's lines then say, for each reading, which block a line
belongs to; two readings consume lines in a way that windows can't tell, and a running scan over the ordered rows, with one number
of state a document, takes their blocks.  All blocks of all readings are gathered by one aggregation,
each becomes a transaction or nothing, and the number of transactions of a document decides which reading stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.functions.text import collapse, contains_any, once
from tallyforge.functions.values import german_date, german_number
from tallyforge.plans import views
from tallyforge.plans.catalog import query

# Words of German statements.
TRANSACTION_TYPES = [
    "Lastschrift", "Gutschrift", "Überweisung", "Dauerauftrag", "Gehalt", "Lohn", "Kartenzahlung", "Bargeldauszahlung", "Abschluss", "Zinsen", "Entgelt", "Einzahlung", "Auszahlung",
    "SEPA-Lastschrift", "SEPA-Überweisung", "Kontoführung", "Geldautomat", "Echtzeitüberweisung", "Abrechnung", "Barauszahlung", "Bareinzahlung", "Scheckeinreichung", "Wertpapier", "Dividende", "Zinsabschluss",
    "SEPA Lastschrifteinzug", "SEPA-Basislastschrift", "Basislastschrift", "Zahlungseingang", "SDD Lastschr", "Wertstellung",
]
INCOME = [
    "gutschrift", "zahlungseingang", "gehalt", "lohn", "einzahlung", "geldeingang", "eingang", "haben", "überweisung von", "zahlung von", "erstattung", "rückerstattung", "zinsen", "dividende", "bonus",
]
BALANCE = [
    "neuer saldo", "alter saldo", "anfangssaldo", "endsaldo", "kontosaldo", "gesamtsaldo", "kontostand", "saldo per", "disponibel", "verfügbar", "guthaben per", "summe haben", "summe soll", "kontonummer", "filialnummer",
]
HEADER_PARTS = ["neuer saldo", "alter saldo", "anfangssaldo", "endsaldo", "kontosaldo", "gesamtsaldo", "kontostand", "summe haben", "summe soll", "disponibel", "blz", "übertrag", "fortsetzung"]
HEADER_PAIRS = [("seite", "von"), ("kontoauszug", "nr"), ("kontoauszug", "nummer"), ("iban", "bic"), ("buchungsdatum", "wertstellung")]
HEADER_WHOLE = ["kontonummer", "filialnummer", "iban", "bic"]

# Dates and amounts.
DATE = r"\d{2}\.\d{2}\.(?:\d{4}|\d{2})"
DATE_ANY = r"\d{2}\.\d{2}\.(?:\d{4}|\d{2})?"
NUMBER = r"\d{1,3}(?:[.]\d{3})*,\d{2}"
AMOUNT = rf"([+-]\s*)?(-?{NUMBER})\s*(?:EUR|€)?"
SIGNED = rf"([+-])\s*({NUMBER})\s*(?:EUR|€)?"
#: With a sign before or behind, also S (debit) and H (credit).
MARKED = rf"([+\-−–])?\s*({NUMBER})\s*(?:€|EUR)?\s*((?:[+\-−–]|[SHsh]\b))?"
PAIR = r"^(\d{2}\.\d{2}\.)/(\d{2}\.\d{2}\.)\s*(.*)"
#: The readings in the order in which they are tried.
GERMAN = ("comprehensive", "multiline", "table", "date_amount", "block")
INTERNATIONAL = ("table", "line", "block")
PARSED = "struct<booking_date:date,value_date:date,amount:double,description:string,raw_text:string,spare:boolean>"


def is_header(text: Column) -> Column:
    """Headers and footers of pages, sums and balances, lone numbers, and lines of less than five characters."""
    return once(F.lower(F.trim(text)), _is_header)


def _is_header(low: Column) -> Column:
    both = lambda *parts: F.lit(True) if not parts else low.contains(parts[0]) & both(*parts[1:])
    hit = contains_any(low, HEADER_PARTS) | low.isin(HEADER_WHOLE) | low.startswith("saldo") | low.startswith("buchungstext") | (low.startswith("verwendungszweck") & (F.length(low) < 25))
    for pair in [*HEADER_PAIRS, ("datum", "betrag", "saldo")]:
        hit = hit | both(*pair)
    return hit | (low.rlike(r"^\d+\s*\d*$") & (F.length(low) < 15)) | (F.length(low) < 5)


def is_balance(description: Column, raw: Column) -> Column:
    """Whether a row tells a balance, or nothing but a currency."""
    return F.exists(F.array(F.lower(description), F.lower(raw)), lambda low: contains_any(low, BALANCE)) | F.upper(F.trim(description)).isin("EUR", "€", "EURO", "")


def transaction_type(description: Column) -> Column:
    """The type that a text begins with, else one of SEPA's, else the first of the list that it contains, else Buchung."""
    low = F.lower(F.trim(description))
    begins = [F.when(low.startswith(t.lower()), t) for t in TRANSACTION_TYPES]
    within = [F.when(low.contains(t.lower()), t) for t in TRANSACTION_TYPES]
    sepa = F.when(low.startswith("sepa"), F.when(low.contains("lastschrift"), "SEPA-Lastschrift").when(low.contains("überweisung"), "SEPA-Überweisung").otherwise("SEPA"))
    return F.coalesce(*begins, sepa, *within, F.lit("Buchung"))


def counterparty(description: Column) -> Column:
    """A name behind a word such as Empfänger or von, else one with a legal form or before a reference, else the first five telling words."""
    # Patterns of names.
    holders = [r"(?i)(?:Auftraggeber|Empfänger|Zahlungsempfänger|Zahlungspflichtiger)[:\s]+([A-Za-zäöüÄÖÜß\s.\-]+?)(?:\s+IBAN|\s+DE\d|$)", r"(?i)(?:von|an)[:\s]+([A-Za-zäöüÄÖÜß\s.\-]{3,50})"]
    names = [r"(?i)^([A-Za-zäöüÄÖÜß][A-Za-zäöüÄÖÜß\s.\-&]+(?:GmbH|AG|KG|e\.V\.|S\.A\.|Ltd|Inc|SE))", r"^([A-Za-zäöüÄÖÜß][A-Za-zäöüÄÖÜß\s]{2,40})(?:\s+DE\d|\s+EREF|\s+SVWZ|/|,)"]
    kinds = [t.lower() for t in TRANSACTION_TYPES]
    got = lambda p: F.trim(F.regexp_extract(description, p, 1))
    named = F.lit(None).cast("string")
    for p in reversed(names):
        named = F.when((F.length(got(p)) > 2) & ~F.lower(got(p)).isin(kinds), got(p)).otherwise(named)
    held = F.when(description.rlike(holders[0]), got(holders[0])).when(description.rlike(holders[1]), got(holders[1]))
    words = F.filter(F.split(description, r"\s+"), lambda w: (F.length(w) > 2) & ~w.rlike(r"^[\d.,]+$") & ~F.lower(w).isin(kinds))
    return F.coalesce(F.when(F.length(held) > 2, held), named, F.nullif(F.substring(F.array_join(F.slice(words, 1, 5), " "), 1, 50), F.lit("")))


def number(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def signed_amount(text: Column, pattern: str) -> Column:
    """The amount of the first match of ``pattern``, whose first group is a sign (none: plus) and whose second is the number."""
    sign = F.when(F.trim(F.regexp_extract(text, pattern, 1)).startswith("-"), -1.0).otherwise(1.0)
    return sign * number(F.regexp_extract(text, pattern, 2))


def ordered(lines: DataFrame, year: int) -> DataFrame:
    """Lines numbered within their document and marked; a date that a line break has torn off its year is whole in ``joined``, and ``place`` leaves the year's line out."""
    whole = Window.partitionBy("file").orderBy("line_no")
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    only = F.col("only") if "only" in lines.columns else F.lit(None).cast("string")
    rows = lines.select("file", "line_no", text.alias("text"), only.alias("only")).withColumns({"idx": F.row_number().over(whole), "after": F.lead("text").over(whole), "before": F.lag("text").over(whole)})
    year_line, torn = r"^\d{4}$", r"\d{2}\.\d{2}\.$"
    rows = rows.withColumns({
        "joined": F.when(F.col("text").rlike(torn) & F.coalesce(F.col("after").rlike(year_line), F.lit(False)), F.concat("text", "after")).otherwise(F.col("text")),
        "left_out": F.col("text").rlike(year_line) & F.coalesce(F.col("before").rlike(torn), F.lit(False)),
    }).drop("after", "before")
    rows = rows.withColumns({"place": F.when(~F.col("left_out"), F.sum((~F.col("left_out")).cast("int")).over(upto)), "blank": F.col("text") == "", "header": is_header(F.col("text"))})
    return rows.withColumn("joined_header", F.when(F.col("joined") == F.col("text"), F.col("header")).otherwise(is_header(F.col("joined"))))


def blocks_of(rows: DataFrame, spans: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` with a block for each of ``spans`` (name, column of places): the first row of the span that has taken it.

    ``<name>_next`` is where the scan goes on if a row begins a span, null where none can begin, and ``<name>_last`` the span's last
    place.  Rows come in the order of their documents, whose spans are taken one after the other: a greedy choice that each
    document makes from its first line on.
    """
    names = [name for name, _ in spans]

    def ints(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return c.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch["file"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            head = batch["file"][0].as_py()
            # files by their number in this batch: 0 goes on from the last one
            group = np.cumsum(np.concatenate([[head != file], code[1:] != code[:-1]]))
            made = []
            for name, place in spans:
                (at, placed), (ahead, begins), (end, _) = (ints(batch[c]) for c in (place, f"{name}_next", f"{name}_last"))
                free, first, last = state.get(name, (0, -1, -1))
                can, current, chosen = np.flatnonzero(placed & begins), 0, []
                for i, of, a, b in zip(can.tolist(), group[can].tolist(), at[can].tolist(), ahead[can].tolist(), strict=True):
                    if of != current:
                        current, free = of, 0
                    if a >= free:
                        free = b
                        chosen.append(i)
                # each row's latest span of its file, which can be one of the last batch
                taken = np.array([-1, *chosen])
                taken = taken[np.searchsorted(taken, np.arange(len(at)), side="right") - 1]
                own = (taken >= 0) & (group[taken] == group)
                older = (taken < 0) & (group == 0)
                firsts = np.where(own, at[taken], np.where(older, first, -1))
                lasts = np.where(own, end[taken], np.where(older, last, -1))
                state[name] = free if current == group[-1] else 0, int(firsts[-1]), int(lasts[-1])
                made.append(pa.array(firsts, pa.int32(), mask=~(placed & (own | older) & (at <= lasts))))
            file = batch["file"][-1].as_py()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept.names), *made], schema=schema)

    kept = to_arrow_schema(rows.schema)
    schema = pa.schema([*kept, *(pa.field(f"{n}_block", pa.int32()) for n in names)])
    out = T.StructType([*rows.schema.fields, *(T.StructField(f"{n}_block", T.IntegerType()) for n in names)])
    return rows.sortWithinPartitions("file", "line_no").mapInArrow(scan, out)


def gathered(rows: DataFrame, blocks: Sequence[tuple[str, Column, Column, Column]], *carried: str) -> DataFrame:
    """``file``, ``strategy``, ``block``, ``line_no`` and ``parts`` of every block: (strategy, block, text, header) say where a row belongs.  Of the columns ``carried`` each block has what its first row has."""
    each = F.array(*(F.struct(F.lit(s).alias("strategy"), b.cast("int").alias("block"), t.alias("text"), h.alias("header")) for s, b, t, h in blocks))
    long = rows.select("file", "line_no", "idx", *carried, F.explode(F.filter(each, lambda x: x["block"].isNotNull())).alias("x")).select("file", "line_no", "idx", *carried, "x.*")
    parts = F.array_sort(F.collect_list(F.struct("idx", "text", "header")))
    return long.groupBy("file", "strategy", "block").agg(F.min("line_no").alias("line_no"), parts.alias("parts"), *(F.min_by(c, "idx").alias(c) for c in carried))


def head_line() -> Column:
    return F.get("parts", 0)["text"]


def joined_rest(skip: int = 0, by: str = " ") -> Column:
    """The texts behind a block's first (less ``skip`` at the end), without blank lines and headers."""
    rest = F.filter(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1 - skip, F.lit(0))), lambda p: (p["text"] != "") & ~p["header"])
    return F.array_join(F.transform(rest, lambda p: p["text"]), by)


def result(booking: Column, value: Column, amount: Column, description: Column, raw: Column, keep: Column, spare: Column | None = None) -> Column:
    spare = F.lit(False) if spare is None else spare
    made = F.struct(booking.alias("booking_date"), F.coalesce(value, booking).alias("value_date"), amount.alias("amount"), description.alias("description"), raw.alias("raw_text"), spare.alias("spare")).cast(PARSED)
    return F.when(booking.isNotNull() & amount.isNotNull() & keep, made)


def dated(text: Column, i: int, year: int, pattern: str = DATE) -> Column:
    return german_date(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), i), year)


def without(text: Column, *patterns: str, by: str = " ") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text


def told(found: DataFrame, parsed: Column, *kept: str) -> DataFrame:
    """The columns ``kept`` and those of ``parsed`` (``result``) where it is one; it is made once a row, which a filter on it would not leave it at."""
    return found.select(*kept, F.inline(F.array_compact(F.array(parsed))))


def _of(**by: Column) -> Column:
    """What the row's reading has in ``by``, else null."""
    out = F.lit(None)
    for name, c in by.items():
        out = F.when(F.col("strategy") == name, c).otherwise(out)
    return out


def _german(found: DataFrame, year: int) -> DataFrame:
    """The transactions of gathered blocks, each as its reading has it.

    What is used more than once is a column of its own on the way, so that it is made once a row; texts are made only
    where date and amount are there.
    """
    end = rf"{AMOUNT}\s*$"
    head, last, whole, shown, paired, d = (F.col(c) for c in ("head", "last", "whole", "shown", "paired", "description"))
    each = F.transform(F.filter("parts", lambda p: (p["text"] != "") & ~p["header"]), lambda p: p["text"])
    rows = found.withColumns({"head": head_line(), "last": F.element_at("parts", -1)["text"], "texts": _of(comprehensive=each)})
    rows = rows.withColumns({
        "whole": _of(comprehensive=F.array_join("texts", " "), block=F.array_join(F.transform("parts", lambda p: p["text"]), " ")),
        "paired": (F.col("strategy") == "multiline") & head.rlike(PAIR), "own": _of(date_amount=F.trim(without(head, rf"^{DATE}", end, by=""))),
    })
    rows = rows.withColumn("shown", _of(comprehensive=F.try_element_at(F.regexp_extract_all(whole, F.lit(MARKED), F.lit(0)), F.lit(-1))))
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    days = _of(
        comprehensive=every(head, DATE_ANY), multiline=F.when(paired, F.array(*(F.regexp_extract(head, PAIR, i) for i in (1, 2)))).otherwise(F.array(F.regexp_extract(head, rf"^({DATE})", 1))),
        table=every(head, DATE), date_amount=F.when(head.rlike(rf"^{DATE}"), F.array(F.regexp_extract(head, DATE, 0), F.regexp_extract("own", rf"^({DATE})", 1))), block=every(whole, DATE),
    )
    size = _of(comprehensive=number(F.regexp_extract(shown, MARKED, 2)), multiline=signed_amount(last, SIGNED), table=signed_amount(head, AMOUNT), date_amount=signed_amount(head, end), block=signed_amount(whole, AMOUNT))
    rows = rows.withColumns({"dates": F.transform(F.slice(days, 1, 2), lambda t: german_date(t, year)), "size": size})
    rows = rows.withColumns({"booking": F.get("dates", F.lit(0)), "value": F.get("dates", F.lit(1))})
    rows = rows.withColumn("there", F.col("booking").isNotNull() & F.col("size").isNotNull())
    there = lambda c: F.when(F.col("there"), c)
    rows = rows.withColumns({
        "rest": there(_of(multiline=joined_rest(1), table=joined_rest(), date_amount=joined_rest())),
        "begun": there(_of(multiline=F.trim(F.when(paired, F.regexp_extract(head, PAIR, 3)).otherwise(F.regexp_replace(head, rf"^{DATE}", ""))))),
        "before": there(_of(multiline=F.trim(F.regexp_extract(last, rf"^(.*?){SIGNED}", 1)))), "marks": there(_of(comprehensive=F.upper(F.concat(F.regexp_extract(shown, MARKED, 1), F.regexp_extract(shown, MARKED, 3))))),
        "lines": there(_of(multiline=joined_rest(1, "\n"))),
    })
    begun, rest = F.col("begun"), F.nullif("rest", F.lit(""))
    description = _of(
        comprehensive=collapse(without(whole, DATE_ANY, MARKED, r"[€+\-−–]|\b[SH]\b")),
        multiline=collapse(F.concat_ws(" ", F.nullif(F.when(~begun.rlike(rf"^\s*{SIGNED}\s*$") | paired, begun), F.lit("")), rest, F.when(~is_header(F.col("before")), F.col("before")))),
        table=collapse(F.concat_ws(" ", F.regexp_replace(without(head, DATE, AMOUNT, by=""), "€", " "), "rest")),
        date_amount=F.trim(F.concat_ws(" ", F.trim(without(F.col("own"), rf"^{DATE}", by="")), rest)),
        block=collapse(without(whole, DATE, AMOUNT)),
    )
    raw = _of(comprehensive=F.array_join("texts", "\n"), multiline=F.array_join(F.array_compact(F.array(head, F.nullif("lines", F.lit("")), last)), "\n"), table=head, date_amount=head, block=whole)
    rows = rows.withColumns({"description": there(description), "raw": there(raw)})
    marks = F.col("marks")
    debit = F.when(marks.rlike("^[-−–]"), True).when(marks.rlike("^[+]"), False).when(marks.rlike("[-−–S]$"), True).when(marks.rlike("[+H]$"), False).otherwise(~once(F.lower(d), lambda low: contains_any(low, INCOME)))
    keep = F.col("there") & ~is_balance(d, F.col("raw")) & ((F.col("strategy") != "block") | (F.length(d) > 3))
    rows = rows.withColumns({"amount": F.when((F.col("strategy") == "comprehensive") & debit, -F.col("size")).otherwise(F.col("size")), "keep": keep})
    spare = (F.col("strategy") == "comprehensive") & (F.length(d) <= 2)
    made = F.struct(F.col("booking").alias("booking_date"), F.coalesce("value", "booking").alias("value_date"), "amount", "description", F.col("raw").alias("raw_text"), spare.alias("spare")).cast(PARSED)
    return told(rows, F.when(F.col("keep"), made), "file", "strategy", "line_no")


def german_readings(lines: DataFrame, year: int) -> DataFrame:
    """The transactions of each of the ``GERMAN`` readings: ``file``, ``strategy``, ``line_no``, dates, ``amount``, ``description``, ``raw_text``.

    ``lines`` have ``file``, ``line_no`` and ``text``; a null text is a blank line.  ``year`` is that of dates without one.  Where they have
    ``only``, the name of a reading, their document gets no other.
    """
    rows = ordered(lines, year)
    by_file = Window.partitionBy("file")
    upto = by_file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_file.orderBy("line_no").rowsBetween(1, 14)
    near = by_file.orderBy("place").rangeBetween(1, 11)
    text, joined = F.col("text"), F.col("joined")
    day, pair, signed = F.col("day"), F.col("pair"), F.col("gives")
    rows = rows.withColumns({"day": text.rlike(rf"^{DATE}"), "pair": text.rlike(PAIR), "gives": text.rlike(SIGNED), "c_day": F.regexp_extract(joined, DATE_ANY, 0)})
    first = F.when(pair, F.regexp_extract(text, PAIR, 1)).when(day, F.regexp_extract(text, rf"^({DATE})", 1))
    rows = rows.withColumns({"first": F.when(~F.col("blank") & ~F.col("header"), first), "c_day": F.when((joined != "") & ~F.col("joined_header") & (F.col("c_day") != ""), F.col("c_day"))})
    rows = rows.withColumns({
        "hit": text.rlike(DATE) & text.rlike(AMOUNT), "halt": pair | (day & (~signed | text.rlike(rf"^{DATE}$"))), "starts": F.transform(F.array("first", "c_day"), lambda t: german_date(t, year).isNotNull()),
        "c_halt": F.regexp_instr(joined, F.lit(DATE_ANY)).between(1, 3) & ((F.length(joined) > 20) | ~joined.rlike(MARKED)),
    })
    rows = rows.withColumns({"begins": F.get("starts", F.lit(0)), "c_begins": F.get("starts", F.lit(1))})
    place_of = lambda flag, place, over: F.min(F.when(flag, F.col(place))).over(over)
    rows = rows.withColumns({
        "t_block": F.last(F.when(F.col("hit"), F.col("idx")), True).over(upto), "d_block": F.last(F.when(F.col("day"), F.col("idx")), True).over(upto),
        "gap": F.coalesce(F.last(F.when(F.col("blank"), F.col("idx")), True).over(upto), F.lit(0)),
        "found": place_of(F.col("gives") & ~F.col("halt"), "idx", ahead), "stop": place_of(F.col("halt"), "idx", ahead),
        "c_stop": F.when(~F.col("left_out"), place_of(F.col("c_halt") & ~F.col("left_out"), "place", near)),
    })
    met = F.col("found") < F.coalesce("stop", F.lit(1 << 30))
    rows = rows.withColumns({
        "m_next": F.when(F.col("begins"), F.when(met, F.col("found") + 1).otherwise(F.coalesce("stop", F.col("idx") + 15))), "m_last": F.when(F.col("begins") & met, F.col("found")),
        "c_next": F.when(F.col("c_begins") & ~F.col("left_out"), F.coalesce("c_stop", F.col("place") + 12)),
    }).withColumn("c_last", F.col("c_next") - 1)
    slim = rows.select("file", "line_no", "idx", "place", "only", "text", "joined", "blank", "header", "joined_header", "t_block", "d_block", "gap", "m_next", "m_last", "c_next", "c_last")
    taken = blocks_of(slim, [("m", "idx"), ("c", "place")])
    close = lambda b: F.when((F.col("idx") - F.col(b) <= 4) & (F.col("gap") < F.col(b)), F.col(b))
    blocks = [
        ("comprehensive", F.col("c_block"), joined, F.col("joined_header")), ("multiline", F.col("m_block"), text, F.col("header")), ("table", close("t_block"), text, F.col("header")),
        ("date_amount", close("d_block"), text, F.col("header")), ("block", F.when(~F.col("blank") & ~F.col("header"), F.col("gap")), text, F.col("header")),
    ]
    blocks = [(s, F.when(F.col("only").isNull() | (F.col("only") == s), b), t, h) for s, b, t, h in blocks]
    found = _german(gathered(taken, blocks), year)
    return distinct(found, GERMAN[3:4])


def distinct(found: DataFrame, all_of: Sequence[str] = (), size: int = 20, by: str = "description") -> DataFrame:
    """Without later rows of the same date, amount and first ``size`` characters of ``by``, but for the readings ``all_of``; rows of hardly any text only where no earlier one has their date and amount."""
    same = ["file", "strategy", "booking_date", "amount"]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("line_no")) == 1
    again = F.row_number().over(Window.partitionBy(*same, F.substring(by, 1, size)).orderBy("line_no")) > 1
    kept = found.withColumn("first", first).where("first OR NOT spare")
    return kept.withColumn("again", again).where(~F.col("again") | F.col("strategy").isin(list(all_of))).drop("first", "again", "spare")


def choose(found: DataFrame, order: Sequence[str], enough: int) -> DataFrame:
    """The rows of each document's reading: the first in ``order`` that found ``enough``, else the first of those that found most."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    counted = found.withColumns({"n": F.count("*").over(Window.partitionBy("file", "strategy")), "rank": rank})
    key = F.struct(F.least("n", F.lit(enough)).alias("n"), (-F.col("rank")).alias("rank"))
    return counted.withColumn("best", F.max(key).over(Window.partitionBy("file"))).where((F.least("n", F.lit(enough)) == F.col("best.n")) & (-F.col("rank") == F.col("best.rank"))).drop("n", "rank", "best")


def read_german(lines: DataFrame, year: int, enough: int = 3) -> DataFrame:
    """Transactions of German statements by the reading that suits each document, with ``currency``, ``transaction_type`` and ``counterparty``."""
    chosen = choose(german_readings(lines, year), GERMAN, enough)
    d = F.col("description")
    return chosen.withColumns({"currency": F.lit("EUR"), "transaction_type": transaction_type(d), "counterparty": counterparty(d)})


# ---- other countries

# Notations of dates and amounts.
_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE_FORMS = {
    "DD_MM_YYYY": r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})", "MM_DD_YYYY": r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})", "YYYY_MM_DD": r"(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})",
    "DD_MMM_YYYY": rf"(?i)(\d{{1,2}}\s+{_MONTHS}\s+\d{{2,4}})", "MMM_DD_YYYY": rf"(?i)({_MONTHS}\s+\d{{1,2}},?\s+\d{{2,4}})",
}
AMOUNT_FORMS = {"COMMA_DECIMAL": r"(-?\d{1,3}(?:[.\s]\d{3})*,\d{2})", "DOT_DECIMAL": r"(-?\d{1,3}(?:,\d{3})*\.\d{2})", "SPACE_DECIMAL": r"(-?\d{1,3}(?:\s\d{3})*[.,]\d{2})"}
INTERNATIONAL_TYPES = {
    "en": ["Transfer", "Payment", "Deposit", "Withdrawal", "Direct Debit", "Standing Order", "Card Payment", "ATM", "Fee", "Interest", "Salary", "Refund"],
    "es": ["Transferencia", "Pago", "Depósito", "Retiro", "Débito", "Domiciliación", "Tarjeta", "Cajero", "Comisión", "Interés", "Nómina"],
    "fr": ["Virement", "Paiement", "Dépôt", "Retrait", "Prélèvement", "Carte", "DAB", "Frais", "Intérêt", "Salaire"],
    "it": ["Bonifico", "Pagamento", "Versamento", "Prelievo", "Addebito", "Carta", "Bancomat", "Commissione", "Interesse", "Stipendio"],
    "pl": ["Przelew", "Płatność", "Wpłata", "Wypłata", "Polecenie", "Karta", "Bankomat", "Opłata", "Odsetki", "Wynagrodzenie"],
    "pt": ["Transferência", "Pagamento", "Depósito", "Saque", "Débito", "Cartão", "Caixa", "Taxa", "Juros", "Salário"],
}


def is_foreign_header(text: Column) -> Column:
    low = F.lower(text)
    has = low.contains
    return (
        (has("page") & (has("of") | has("de"))) | (has("statement") & has("account")) | (has("balance") & (has("opening") | has("closing"))) | (has("date") & has("description") & has("amount"))
        | (has("total") & has("balance")) | (F.length(text) < 5)
    )


def foreign_date(text: Column, form: Column) -> Column:
    """A date in one of ``DATE_FORMS``; a year of two digits is of this century up to 50."""
    return _date_of(date_parts(text), form)


def date_parts(text: Column) -> Column:
    return F.split(F.trim(F.replace(text, F.lit(","), F.lit(""))), r"[/.\-\s]+")


def _date_of(parts: Column, form: Column) -> Column:
    at = lambda i: F.get(parts, i)
    month = lambda c: (F.ceil(F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(c, 1, 3))) / 3)).cast("string")
    named = lambda name: form == name
    y = F.when(named("YYYY_MM_DD"), at(0)).otherwise(at(2)).try_cast("int")
    m = F.when(named("YYYY_MM_DD") | named("DD_MM_YYYY"), at(1)).when(named("MM_DD_YYYY"), at(0)).when(named("DD_MMM_YYYY"), month(at(1))).otherwise(month(at(0)))
    d = F.when(named("YYYY_MM_DD"), at(2)).when(named("DD_MM_YYYY") | named("DD_MMM_YYYY"), at(0)).otherwise(at(1))
    year = F.when(y < 100, F.when(y > 50, y + 1900).otherwise(y + 2000)).otherwise(y)
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def foreign_amount(text: Column, form: Column) -> Column:
    plain = F.regexp_replace(text, "[^0-9,.-]", "")
    return F.when(form == "DOT_DECIMAL", F.replace(plain, F.lit(","), F.lit(""))).when(form == "COMMA_DECIMAL", F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit("."))).try_cast("double")


def _by_form(forms: dict[str, str], form: Column, use) -> Column:
    out = F.lit(None)
    for name, pattern in forms.items():
        out = F.when(form == name, use(pattern)).otherwise(out)
    return out


def international_readings(lines: DataFrame) -> DataFrame:
    """The transactions of each of the ``INTERNATIONAL`` readings of ``lines``, which have ``date_form``, ``amount_form`` and ``currency`` of their document besides ``file``, ``line_no`` and ``text``."""
    by_file = Window.partitionBy("file")
    upto = by_file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, date_form, amount_form = F.col("text"), F.col("date_form"), F.col("amount_form")
    rows = lines.select("file", "line_no", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).alias("text"), "date_form", "amount_form", "currency")
    hit = _by_form(DATE_FORMS, date_form, text.rlike) & _by_form(AMOUNT_FORMS, amount_form, text.rlike)
    rows = rows.withColumns({"idx": F.row_number().over(by_file.orderBy("line_no")), "blank": text == "", "hit": hit, "header": is_foreign_header(text)})
    rows = rows.withColumns({"t_block": F.last(F.when(F.col("hit"), F.col("idx")), True).over(upto), "gap": F.coalesce(F.last(F.when(F.col("blank"), F.col("idx")), True).over(upto), F.lit(0))})
    table = F.when((F.col("idx") - F.col("t_block") <= 3) & (F.col("gap") < F.col("t_block")), F.col("t_block"))
    blocks = [("table", table, text, F.col("header")), ("line", F.when(F.col("hit"), F.col("idx")), text, F.col("header")), ("block", F.when(~F.col("blank") & ~F.col("header"), F.col("gap")), text, F.col("header"))]
    forms = rows.groupBy("file").agg(*(F.first(c, True).alias(c) for c in ("date_form", "amount_form", "currency")))
    found = gathered(rows, blocks).join(forms, "file")
    whole = F.when(F.col("strategy") == "block", F.array_join(F.transform("parts", lambda p: p["text"]), " ")).otherwise(head_line())

    w, there = F.col("whole"), F.col("booking").isNotNull() & F.col("amount").isNotNull()
    found = found.withColumn("whole", whole)
    found = found.withColumns({"day": _by_form(DATE_FORMS, date_form, lambda p: F.regexp_extract(w, p, 1)), "size": _by_form(AMOUNT_FORMS, amount_form, lambda p: F.regexp_extract(w, p, 1))})
    found = found.withColumn("day_parts", date_parts(F.col("day")))
    found = found.withColumns({"booking": _date_of(F.col("day_parts"), date_form), "amount": foreign_amount(F.col("size"), amount_form)})
    # one after the other, so that each has a pattern of its form only
    found = found.withColumn("own", F.when(there, _by_form(DATE_FORMS, date_form, lambda p: without(w, p))))
    found = found.withColumn("own", _by_form(AMOUNT_FORMS, amount_form, lambda p: without(F.col("own"), p)))
    rest = F.when(F.col("strategy") == "table", joined_rest())
    found = found.withColumn("rest", F.when(there, rest))
    found = found.withColumn("description", collapse(F.concat_ws(" ", F.regexp_replace("own", "[€$£¥₹₱₦]+", ""), F.nullif("rest", F.lit("")))))
    d = F.col("description")
    least = F.when(F.col("strategy") == "block", 3).otherwise(2)
    parsed = told(found, result(F.col("booking"), F.col("booking"), F.col("amount"), d, w, F.length(d) > least), "file", "strategy", "line_no", "currency")
    return distinct(parsed)


def read_international(lines: DataFrame) -> DataFrame:
    """Transactions of other countries' statements by each document's first reading that finds any, with ``transaction_type`` and ``counterparty``."""
    chosen = choose(international_readings(lines), INTERNATIONAL, 1)
    low, d = F.lower("description"), F.col("description")
    types = F.coalesce(*(F.when(low.contains(t.lower()), t) for names in INTERNATIONAL_TYPES.values() for t in names), F.lit("Transaction"))
    words = F.filter(F.split(d, r"\s+"), lambda w: (F.length(w) > 2) & ~w.rlike(r"^[\d.,-]+$"))
    return chosen.withColumns({"transaction_type": types, "counterparty": F.nullif(F.substring(F.array_join(F.slice(words, 1, 5), " "), 1, 50), F.lit(""))})


# ---- statements that are printed and read again


def amount_text(cents: Column) -> Column:
    """An amount without its sign, as 1.234,56."""
    return german_number(F.abs(cents))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with ``k``, their number within their statement, and ``shown``, a text that names it."""
    rows = views.transactions(spark, sf_dir, "id", "statement_id", "booking_date", "amount_cents", "description")
    k = F.row_number().over(Window.partitionBy("statement_id").orderBy("id", "booking_date", "amount_cents", "description"))
    return rows.withColumn("k", k).withColumn("shown", F.concat("description", F.lit(" Nr "), "k"))


#: What ``numbered`` gives, in SQL.
NUMBERED = """, numbered AS (
  SELECT *, description || ' Nr ' || k AS shown, CAST(abs(amount_cents) AS DOUBLE) / 100.0 AS size, CASE WHEN amount_cents < 0 THEN -1.0 ELSE 1.0 END AS sign,
    row_number() OVER (PARTITION BY statement_id, booking_date, amount_cents, substr(description || ' Nr ' || k, 1, 20) ORDER BY k) AS again
  FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY id, booking_date, amount_cents, description) AS k FROM live))"""


def printed(rows: DataFrame) -> DataFrame:
    """Lines of statements in six forms, by their numbers: short dates, text of many lines, dates within lines, lines that stand thrice, blocks, and dates torn at the year."""
    day, short, size = F.date_format("booking_date", "dd.MM.yyyy"), F.date_format("booking_date", "dd.MM."), amount_text(F.col("amount_cents"))
    debit, shown = F.col("amount_cents") < 0, F.col("shown")
    thrice = F.concat_ws(" ", day, shown, size)
    forms = [
        [F.concat_ws(" ", short, shown, size, F.when(debit, "S").otherwise("H"))],
        [day, shown, *(F.lit(f"Zeile {i} der Angaben") for i in range(11)), F.concat_ws(" ", F.when(debit, "-").otherwise("+"), size)],
        [F.concat_ws(" ", F.lit("Beleg"), F.col("k"), F.col("description"), day, size, F.lit("EUR"))],
        [thrice] * 3,
        [F.concat_ws(" ", F.lit("Betrag"), size, F.lit("EUR")), shown, F.concat_ws(" ", F.lit("am"), day), F.lit(""), F.lit("Verfügbar bis zum Ende des Monats"), F.lit("")],
        [short, F.date_format("booking_date", "yyyy"), F.concat(shown, F.lit(" "), size, F.when(debit, "-").otherwise("+")), F.concat_ws(" ", F.lit("Seite"), F.col("k"), F.lit("von 99")), F.lit("Alter Saldo 5,00")],
    ]
    form, texts = F.col("statement_id") % len(forms), F.lit(None).cast("array<string>")
    for i, f in enumerate(forms):
        texts = F.when(form == i, F.array(*(c.cast("string") for c in f))).otherwise(texts)
    each = rows.select(F.concat(F.lit("s"), "statement_id").alias("file"), "k", F.posexplode(texts).alias("i", "text"))
    return each.select("file", (F.col("k") * 100 + F.col("i")).alias("line_no"), "text")


@query(
    NUMBERED
    + """, counted AS (SELECT *, statement_id % 6 AS form, count(*) OVER (PARTITION BY statement_id) AS n, count(*) FILTER (again = 1) OVER (PARTITION BY statement_id) AS d FROM numbered),
told AS (
  SELECT *, CASE form WHEN 0 THEN 'comprehensive' WHEN 1 THEN 'multiline' WHEN 2 THEN CASE WHEN n = 1 THEN 'comprehensive' ELSE 'table' END
    WHEN 3 THEN CASE WHEN d < 3 THEN 'date_amount' ELSE 'comprehensive' END WHEN 4 THEN 'block' ELSE 'comprehensive' END AS strategy FROM counted)
SELECT 's' || statement_id AS file, strategy, CASE WHEN form = 0 THEN make_date(2024, month(booking_date), day(booking_date)) ELSE booking_date END AS booking_date,
  CASE WHEN form IN (0, 1, 5) THEN sign * size WHEN form = 4 OR strategy IN ('table', 'date_amount') THEN size ELSE -size END AS amount,
  CASE form WHEN 1 THEN shown || ' ' || array_to_string(list_transform(range(0, 11), lambda i: 'Zeile ' || i || ' der Angaben'), ' ') WHEN 2 THEN 'Beleg ' || k || ' ' || description WHEN 4 THEN 'Betrag ' || shown || ' am' ELSE shown END AS description
FROM told CROSS JOIN range(CASE WHEN strategy = 'date_amount' THEN 3 ELSE 1 END) WHERE form IN (2, 4) OR strategy = 'date_amount' OR again = 1"""
)
def statements_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements, printed in six forms, each read by the strategy that suits it."""
    return read_german(printed(numbered(spark, sf_dir)), 2024).select("file", "strategy", "booking_date", "amount", "description")


@query(
    NUMBERED
    + """, told AS (SELECT *, ['DD_MM_YYYY', 'MM_DD_YYYY', 'YYYY_MM_DD', 'DD_MMM_YYYY', 'MMM_DD_YYYY'][1 + statement_id % 5] AS form, statement_id % 2 = 0 AS blocks FROM numbered)
SELECT 's' || statement_id AS file, CASE WHEN blocks THEN 'block' ELSE 'table' END AS strategy, booking_date, sign * size AS amount,
  CASE WHEN blocks THEN shown || ' more about it' ELSE shown || ' more about it' END AS description FROM told WHERE again = 1"""
)
def foreign_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements, printed in five notations of dates, in lines or in blocks, and read again."""
    rows = numbered(spark, sf_dir).withColumn("date_form", F.get(F.array(*map(F.lit, DATE_FORMS)), (F.col("statement_id") % 5).cast("int")))
    patterns = {"DD_MM_YYYY": "dd/MM/yyyy", "MM_DD_YYYY": "MM-dd-yyyy", "YYYY_MM_DD": "yyyy-MM-dd", "DD_MMM_YYYY": "d MMM yyyy", "MMM_DD_YYYY": "MMM d, yyyy"}
    day = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        day = F.when(F.col("date_form") == name, F.date_format("booking_date", pattern)).otherwise(day)
    size = F.concat(F.when(F.col("amount_cents") < 0, "-").otherwise(""), F.format_number(F.abs("amount_cents") / 100, 2))
    more = F.lit("more about it")
    texts = F.when(F.col("statement_id") % 2 == 0, F.array(day, "shown", F.concat(F.lit("$ "), size), more, F.lit("Page 1 of 9"), F.lit(""))).otherwise(F.array(F.concat_ws(" ", day, "shown", size), more, F.lit("Page 1 of 9")))
    each = rows.select(F.concat(F.lit("s"), "statement_id").alias("file"), "k", "date_form", F.posexplode(texts).alias("i", "text"))
    lines = each.select("file", (F.col("k") * 100 + F.col("i")).alias("line_no"), "text", "date_form", F.lit("DOT_DECIMAL").alias("amount_form"), F.lit("USD").alias("currency"))
    return read_international(lines).select("file", "strategy", "booking_date", "amount", "description")
