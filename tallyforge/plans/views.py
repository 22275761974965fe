"""The statement data model over the driver's star schema.

``transactions`` joins only what the asked columns need, so that a query by month reads
four columns of one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = {
    "id": "l_orderkey * 8 + l_linenumber",
    "statement_id": "l_orderkey",
    "booking_date": "CAST(l_shipdate AS DATE)",
    "amount_cents": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT)",
    "category_id": "CASE WHEN l_tax = 0 THEN l_linenumber % 6 + 1 END",
    "is_duplicate": "l_linenumber = 7",
}
_ORDER = {"account_id": "o_custkey"}
_PART = {"counterparty_name": "CASE WHEN p_size > 2 THEN p_name END", "description": "concat(p_brand, ' ', p_name)", "auto_category": "CASE WHEN p_size < 50 THEN p_type END"}
# Texts of transactions: description, counterparty, remittance; {n} is a name, {N} in capitals.
TEXTS = [
    ("PayPal Europe S.a.r.l. et Cie {n} GmbH, I hr Einkauf b ei {n} GmbH Mandat: AB12", "PayPal Europe", None),
    ("Ihr Einkauf bei {n}, Ihr Einkauf", "PAYPAL", "Referenz: Y2"),
    ("VISA {N} NR XXXX 1234 KAUFUMSATZ 12.03 45,90", None, None),
    ("{N}//BERLIN/DE Debitkartenzahlung", "", None),
    ("{n} Mastercard • Bars & Restaurants", None, None),
    ("Gehalt/Rente {n} AG", "{n} AG", None),
    ("EREF+AB1234 MREF+M77 CRED+DE98ZZZ SVWZ+Rechnung {n} IBAN+DE12500105170648489890 BIC+INGDDEFFXXX", "{n} KG", None),
    ("SEPA-Dauerauftrag {n}", "{n}", "Mandat: X1 Referenz: Y2 Bestellung vom Montag {n}, abgeholt am Dienstag in der Filiale am Markt"),
    ("Kartenzahlung girocard {n} Filiale 12", None, None),
    ("Bargeldausz. Geldautomat {n}", None, None),
    ("Miete {n}\nMandat: X1 Miete fuer den Monat", None, None),
    ("12345678901/abc, Shop {n}", "paypal", None),
    ("Gutschrift Abbuchung vom PayPal-Konto /. {n} AG, Ihr Einkauf", None, None),
    ("Lebensmittel {n} 1234567", "  ", "12345 67890 1"),
    ("{n} Einzug", "{n} Filiale 12 Berlin", None),
]
COLUMNS = ["id", "account_id", "statement_id", "booking_date", "amount_cents", "counterparty_name", "description", "auto_category", "category_id", "is_duplicate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, *columns: str, live: bool = True) -> DataFrame:
    """Transactions with the asked columns (default: all); ``live`` leaves out flagged duplicates."""
    columns = columns or tuple(COLUMNS)
    out = read(spark, sf_dir, "lineitem")
    if live:
        out = out.where("l_linenumber <> 7")
    if any(c in _ORDER for c in columns):
        out = out.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if any(c in _PART for c in columns):
        out = out.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = _LINE | _ORDER | _PART
    return out.select(*(F.expr(found[c]).alias(c) for c in columns))


def bank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``name``, ``description``, ``counterparty`` and ``remittance``: texts as banks write them (``TEXTS``), about each part's name."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    texts = F.array(*(F.struct(F.lit(i).alias("number"), *(F.lit(x).cast("string").alias(c) for x, c in zip(t, ("description", "counterparty", "remittance"), strict=True))) for i, t in enumerate(TEXTS)))
    each = names.select("name", F.explode(texts).alias("t"))
    about = lambda c: F.replace(F.replace(F.col(f"t.{c}"), F.lit("{n}"), F.col("name")), F.lit("{N}"), F.upper("name")).alias(c)
    return each.select(F.concat_ws("#", "name", "t.number").alias("id"), "name", about("description"), about("counterparty"), about("remittance"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_mktsegment AS bank_name", "concat('DE', lpad(CAST(c_custkey AS STRING), 20, '0')) AS iban", "c_acctbal >= 0 AS is_active"
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS account_id", "concat('stmt_', o_orderkey % 1000, '.csv') AS file_name", "CAST(o_orderdate AS DATE) AS import_date")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS id", "r_name AS name")


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS id", "s_name AS name", "n_name AS country_code")
