"""Statement exports as text: which type a file has, and delimited text as transactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.values import german_number, parse_amount, parse_date, period
from tallyforge.plans import views
from tallyforge.plans.catalog import query
from tallyforge.plans.folders import shared_folder

# Parts of header names of each field, the first that fits winning.
HEADERS: Mapping[str, Sequence[str]] = {
    "date": ["date", "booking_date", "bookingdate", "transaction_date", "transactiondate", "datum", "buchungsdatum", "started date", "completed date", "value_date"],
    "amount": ["amount", "betrag", "value", "sum", "amount (signed)", "debit", "credit"],
    "description": ["description", "beschreibung", "verwendungszweck", "reference", "memo", "narrative", "details", "text", "usage text"],
    "balance": ["balance", "saldo", "kontostand", "running_balance", "available"],
    "counterparty": ["counterparty", "counterparty_name", "payee", "payer", "name", "beneficiary", "empfänger", "auftraggeber"],
    "counterparty_iban": ["counterparty_iban", "iban", "account_number", "kontonummer"],
    "currency": ["currency", "währung", "ccy"],
    "type": ["type", "transaction_type", "art", "buchungsart"],
    "remittance": ["remittance_info", "reference", "referenz", "payment_reference"],
    "value_date": ["value_date", "valuta"],
}
DELIMITERS = [",", ";", "\t", "|"]
_SPLIT = "\x01"


def type_by_name(path: Column) -> Column:
    """csv, excel or pdf by the extension, whatever its case; else null."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(extension == "pdf", "PDF").when(extension == "csv", "CSV").when(extension.isin("xls", "xlsx"), "EXCEL")


def type_by_content(content: Column) -> Column:
    """By the first bytes: %PDF, a zip or an OLE file, else text with a delimiter in its first thousand bytes."""
    start = F.hex(F.substring(content, 1, 4))
    text = F.hex(F.substring(content, 1, 1000))
    delimited = F.regexp_like(text, F.lit("^(..)*?(2C|3B|09)"))
    return F.when(start.startswith("25504446"), "PDF").when(start.startswith("504B") | start.startswith("D0CF"), "EXCEL").when(delimited, "CSV")


def detect(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``by_name`` and ``by_content`` of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), type_by_name(F.col("path")).alias("by_name"), type_by_content(F.col("content")).alias("by_content"))


def delimiter(header: Column) -> Column:
    """The delimiter that a header line has most often; of equal counts the first of the list."""
    counts = F.array(*(F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))) for d in DELIMITERS))
    return F.element_at(F.array(*map(F.lit, DELIMITERS)), F.array_position(counts, F.array_max(counts)).cast("int"))


def cells(line: Column, delimiter: Column) -> Column:
    """The trimmed cells of a line.  A quote begins or ends a quoted part, wherever it stands, and goes; doubled quotes are nothing special."""
    parts = F.transform(F.split(line, '"'), lambda x, i: F.when(i % 2 == 0, F.replace(x, delimiter, F.lit(_SPLIT))).otherwise(x))
    return F.transform(F.split(F.array_join(parts, ""), _SPLIT), lambda x: F.trim(x))


def column_of(header: Column, names: Sequence[str]) -> Column:
    """Place (from 1) of the first header that contains the first fitting name; null if none does."""
    return _place(F.transform(header, F.lower), names)


def _place(low: Column, names: Sequence[str]) -> Column:
    """``column_of`` of lower-cased headers."""
    def place(name: str) -> Column:
        has = lambda h: h.contains(name)
        return F.when(F.exists(low, has), F.array_position(F.transform(low, has), True))

    return F.coalesce(*map(place, names))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``place`` (ordered within a file) and ``line`` of all lines that are not blank.  A line break ends a line, within quotes too."""
    raw = spark.read.text(path, recursiveFileLookup=True)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = raw.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return lines.where(F.trim("line") != "")


def read_csv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions of delimited lines, and a row on each file's success.  A file's first line tells its delimiter.

    The one row a file of headers is broadcast if there are few files, so that lines stay where they are read.
    """
    header = lines.groupBy("file").agg(F.min("place").alias("first"), F.min_by("line", "place").alias("header"))
    header = header.withColumn("delimiter", delimiter(F.col("header"))).withColumn("names", cells(F.col("header"), F.col("delimiter")))
    header = with_places(header.drop("header"), HEADERS)
    files = len(lines.inputFiles())
    near = F.broadcast(header) if 0 < files <= 10_000 else header
    body = lines.join(near.where(_USABLE), "file").where(F.col("place") > F.col("first"))
    transactions = body.withColumn("cells", cells(F.col("line"), F.col("delimiter"))).select("file", "place", *fields(HEADERS)).where(_COMPLETE)
    sums = transactions.groupBy("file").agg(*_sums())
    status = header.join(sums, "file", "left").select("file", problem().isNull().alias("success"), F.coalesce("rows", F.lit(0)).alias("rows"), "statement_period", problem().alias("error_message"))
    return transactions, status


_USABLE, _COMPLETE = "at_date IS NOT NULL AND at_amount IS NOT NULL", "booking_date IS NOT NULL AND amount IS NOT NULL"


def with_places(header: DataFrame, headers: Mapping[str, Sequence[str]]) -> DataFrame:
    """``header`` (``names``) with the place of each field as ``at_<field>``."""
    low = header.withColumn("low", F.transform("names", F.lower))  # once for all fields
    return low.withColumns({f"at_{f}": _place(F.col("low"), n) for f, n in headers.items()}).drop("low")


def problem() -> Column:
    """What a header lacks, else null."""
    return F.when(F.col("at_date").isNull(), "Could not find date column in CSV").when(F.col("at_amount").isNull(), "Could not find amount column in CSV")


def _sums() -> list[Column]:
    complete = F.expr(_COMPLETE)
    days = F.when(complete, F.col("booking_date"))
    return [F.count(F.when(complete, 1)).alias("rows"), period(F.min(days), F.max(days)).alias("statement_period")]


def fields(headers: Mapping[str, Sequence[str]]) -> list[Column]:
    """The fields of a row of ``cells`` by the places of its header; all but date and amount may be missing."""
    cell = lambda f: F.nullif(F.get("cells", F.col(f"at_{f}").cast("int") - 1), F.lit("")) if f in headers else F.lit(None).cast("string")
    return [
        parse_date(cell("date")).alias("booking_date"),
        parse_date(cell("value_date")).alias("value_date"),
        parse_amount(cell("amount")).alias("amount"),
        F.upper(F.coalesce(cell("currency"), F.lit("EUR"))).alias("currency"),
        parse_amount(cell("balance")).alias("balance"),
        F.coalesce(cell("description"), F.lit("")).alias("description"),
        cell("counterparty").alias("counterparty_name"),
        cell("counterparty_iban").alias("counterparty_iban"),
        cell("remittance").alias("remittance_info"),
        cell("type").alias("transaction_type"),
        F.array_join("cells", ";").alias("raw_text"),
    ]


def read_sheets(parts: DataFrame, headers: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Transactions of sheets that come in parts, and a row on each file's success.

    A part has its ``file``, the header's ``names``, ``rows`` of cells from place ``at`` on, the header being at 0, and a ``problem`` if the file
    could not be read; each file has a part, even without rows.  Rows without a date or an amount are left out.
    """
    placed = with_places(parts, headers)
    each = lambda rows, explode: rows.select("*", explode("rows").alias("i", "cells")).withColumn("place", F.col("at") + F.col("i"))
    transactions = each(placed.where("problem IS NULL").where(_USABLE), F.posexplode).select("file", "place", *fields(headers)).where(_COMPLETE)
    told = placed.withColumn("error_message", F.coalesce("problem", problem()))
    told = told.withColumn("rows", F.when(F.col("error_message").isNull(), F.col("rows")))
    day, _, amount, *_ = fields(headers)
    status = each(told, F.posexplode_outer).select("file", "error_message", day, amount).groupBy("file", "error_message").agg(*_sums())
    return transactions, status.select("file", F.col("error_message").isNull().alias("success"), "rows", "statement_period", "error_message")


def load_keywords(lines: DataFrame, known: Sequence[str]) -> DataFrame:
    """``category`` and ``keyword`` of lines ``category,keyword``; unknown categories and OTHER are left out, a header with them."""
    parts = lines.select(F.split("line", ",", 2).alias("p")).where(F.size("p") == 2)
    rows = parts.select(F.upper(F.trim(F.get("p", 0))).alias("category"), F.trim(F.get("p", 1)).alias("keyword"))
    return rows.where(F.col("category").isin([c for c in known if c != "OTHER"]) & (F.col("keyword") != ""))


def load_merchants(lines: DataFrame, codes: Mapping[str, str]) -> DataFrame:
    """``category``, ``country_code`` and ``name`` of lines ``code,country,name`` with a known code and a name of three letters."""
    from tallyforge.functions.text import normalize_light

    parts = lines.select(F.split("line", ",", 3).alias("p")).where(F.size("p") == 3)
    code = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    rows = parts.select(F.try_element_at(code, F.trim(F.get("p", 0))).alias("category"), F.upper(F.trim(F.get("p", 1))).alias("country_code"), F.trim(F.get("p", 2)).alias("name"))
    rows = rows.withColumn("name_normalized", normalize_light("name"))
    return rows.where(F.col("category").isNotNull() & (F.length("name_normalized") >= 3))


def country_of(iban: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.substring(F.replace(iban, F.lit(" ")), 1, 2)), F.lit("")), F.lit("de"))


def with_country(rows: DataFrame, iban: Column, available: DataFrame, default: str = "de") -> DataFrame:
    """``rows`` with ``country``: that of the account number if ``available`` (``country``) has it, else ``default``.

    ``available`` are the partitions of a dimension, one for each country that has a file; there are at most 26 * 26 two-letter codes.
    """
    known = available.select(F.lower("country").alias("known")).where(F.length("known") == 2).distinct()
    made = rows.withColumn("country", country_of(iban))
    return made.join(F.broadcast(known), F.col("country") == F.col("known"), "left").withColumn("country", F.coalesce("known", F.lit(default))).drop("known")


_FORMS = [(",", "Date Amount Description Payee"), (";", "Buchungsdatum Betrag Verwendungszweck Auftraggeber"), ("\t", "Datum Betrag Text Name"), ("|", "date value memo beneficiary")]


@query("SELECT booking_date, CAST(amount_cents AS DOUBLE) / 100.0 AS amount, description || CASE account_id % 4 WHEN 0 THEN ', x' WHEN 1 THEN '; x' WHEN 2 THEN '' ELSE '| x' END AS description, counterparty_name, account_id % 4 AS form FROM live")
def delimited_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions, written with four delimiters, notations and languages of headers, and read again; texts hold the delimiter."""
    rows = views.transactions(spark, sf_dir, "id", "account_id", "booking_date", "amount_cents", "description", "counterparty_name").withColumn("form", F.col("account_id") % len(_FORMS))
    folder, joined = shared_folder(spark, "delimited"), shared_folder(spark, "delimited-rows")
    rows.write.partitionBy("form").parquet(joined)  # joined once for all forms
    for i, (mark, names) in enumerate(_FORMS):
        own = spark.read.schema(rows.drop("form").schema).parquet(f"{joined}/form={i}")
        day = F.date_format("booking_date", "dd.MM.yyyy" if i % 2 else "yyyy-MM-dd")
        amount = german_number(F.col("amount_cents")) if i % 2 else (F.col("amount_cents") / 100).cast("decimal(18,2)").cast("string")
        text = F.concat("description", F.lit("" if mark == "\t" else f"{mark} x"))
        columns = [c.alias(n) for c, n in zip((day, amount, text, F.col("counterparty_name")), names.split(), strict=True)]
        own.select(*columns).write.option("header", "true").option("sep", mark).option("emptyValue", "").csv(f"{folder}/form-{i}")
    read, _ = read_csv(read_lines(spark, folder))
    return read.select("booking_date", "amount", "description", "counterparty_name", F.regexp_extract("file", r"form-(\d)", 1).cast("long").alias("form"))


@query("""SELECT c.id, coalesce(f.country, 'de') AS country, count(m.id) AS merchants FROM (SELECT c_custkey AS id, lower(substr(n_name, 1, 2)) AS own FROM customer JOIN nation ON c_nationkey = n_nationkey) c
LEFT JOIN (SELECT DISTINCT CASE n_name WHEN 'GERMANY' THEN 'de' ELSE lower(substr(n_name, 1, 2)) END AS country FROM nation WHERE n_nationkey % 2 = 0 OR n_name = 'GERMANY') f ON f.country = c.own
LEFT JOIN (SELECT s_suppkey AS id, CASE n_name WHEN 'GERMANY' THEN 'de' ELSE lower(substr(n_name, 1, 2)) END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 OR n_name = 'GERMANY') m ON m.country = coalesce(f.country, 'de') GROUP BY ALL""")
def merchants_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each account the merchants of the file of its country, else of the German one; half of the countries have a file."""
    nation = views.read(spark, sf_dir, "nation").withColumn("country", F.when(F.col("n_name") == "GERMANY", "de").otherwise(F.lower(F.substring("n_name", 1, 2))))
    made = views.read(spark, sf_dir, "supplier").join(nation.where("n_nationkey % 2 = 0 OR n_name = 'GERMANY'"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "country")
    folder = shared_folder(spark, "merchants")
    made.write.partitionBy("country").parquet(folder)
    files = spark.read.parquet(folder)
    accounts = views.read(spark, sf_dir, "customer").join(views.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    iban = F.concat(F.upper(F.substring("n_name", 1, 1)), F.upper(F.substring("n_name", 2, 1)), F.lit(" 12 3456"))
    placed = with_country(accounts.select(F.col("c_custkey").alias("id"), "n_name"), iban, files)
    sizes = files.groupBy("country").agg(F.count("*").alias("merchants"))  # a row a country
    return placed.join(F.broadcast(sizes), "country", "left").select("id", "country", F.coalesce("merchants", F.lit(0)).cast("long").alias("merchants"))


def keep_merchants(rows: DataFrame, brands: Sequence[str], redundant: Sequence[str]) -> DataFrame:
    """Names that contain a brand, or none of the redundant words."""
    from tallyforge.functions.text import contains_any

    low = F.lower(F.col("name"))
    return rows.where(contains_any(low, list(brands)) | ~contains_any(low, list(redundant)))
