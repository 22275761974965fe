"""What the texts of transactions say: kinds, merchants, details, references, banks, periods, names of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import categories, references, signals, text, values
from tallyforge.operators.merchants import LIGHT, any_of
from tallyforge.plans import views
from tallyforge.plans.catalog import query


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(trim(regexp_extract({x}, {_quoted(pattern)}, {group})), '')"


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _without(x: str, patterns: list[str], by: str = "") -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {_quoted(p)}, '{by}', 'g')"
    return x


def _mended(x: str) -> str:
    for p, word in text.TORN:
        x = f"regexp_replace({x}, {_quoted(p)}, '{word}', 'g')"
    return x


_SHARE = r"CASE WHEN length({0}) > 0 THEN CAST(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) AS DOUBLE) / length({0}) ELSE 0 END"
_SERVICE = "(contains(lower(coalesce(counterparty, '')), 'paypal') OR contains(lower(description), 'paypal'))"
_WHOLE = _mended(_collapsed("concat_ws(' ', description, counterparty)"))
_KIND = "CASE " + " ".join(f"WHEN {any_of('low', signals.SIGNALS[tell] if isinstance(tell, str) else tell)} THEN '{name}'" for name, tell in references.KINDS) + " ELSE 'UNKNOWN' END"
_CARD = f"coalesce({_found('whole', references.CARD_PLACE)}, {_found('whole', references.GIROCARD)})"
_NAME = f"""CASE WHEN kind IN ('PAYPAL', 'REFUND') THEN coalesce({', '.join(_found('whole', p) for p in references.PURCHASES)}) WHEN kind = 'VISA_CARD' THEN coalesce({_found('whole', references.VISA)}, {_CARD})
WHEN kind = 'CARD_PAYMENT' THEN coalesce({_found('whole', references.BULLET)}, {_CARD}) WHEN trim(counterparty) <> '' THEN counterparty END"""
_CLEAN = _collapsed(_without("name", [references.CARD_NOISE, references.LEGAL_FORMS, "[.,;:_]+"], " "))
_HINT = "CASE " + " ".join(f"WHEN {any_of('bullet', parts)} THEN '{c}'" for c, parts in references.BANK_HINTS) + " END"


@query(f""", w AS (SELECT id, counterparty, {_WHOLE} AS whole FROM bank_texts), k AS (SELECT *, lower(whole) AS low FROM w), n AS (SELECT *, {_KIND} AS kind FROM k),
m AS (SELECT *, {_NAME} AS name, lower(coalesce(nullif(regexp_extract(whole, {_quoted(references.BULLET)}, 2), ''), whole)) AS bullet FROM n)
SELECT id, kind, CASE WHEN length({_CLEAN}) >= 2 THEN {_CLEAN} END AS merchant, {_HINT} AS hint FROM m""")
def transaction_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, effective merchant and the bank's hint of each text."""
    rows = views.bank_texts(spark, sf_dir).withColumn("whole", references.whole_text(F.col("description"), F.col("counterparty")))
    rows = rows.withColumn("low", F.lower("whole")).withColumn("kind", references.kind(F.col("low")))
    merchant = references.effective_merchant(F.col("kind"), F.col("counterparty"), F.col("whole"))
    return rows.select("id", "kind", merchant.alias("merchant"), references.category_hint(F.col("whole")).alias("hint"))


def _detail(x: str) -> str:
    cleaned = _collapsed(_without(x, references.REFERENCES))
    return f"CASE WHEN length({cleaned}) >= 5 AND {_SHARE.format(cleaned)} >= 0.3 THEN CASE WHEN length({cleaned}) > 60 THEN {cleaned}[:60] || '…' ELSE {cleaned} END END"


_BOUGHT = r"regexp_extract(description, '[Ii]hr [Ee]inkauf bei\s+(.+)', 1)"
_SECOND = r"trim(regexp_split_to_array(description, '[\n\r]+')[2])"
_PAYPAL = "coalesce(" + ", ".join(f"(CASE WHEN length({n}) >= 3 AND NOT regexp_full_match({n}, '[\\d.]+') THEN {n} END)" for n in (f"{_collapsed(f'regexp_extract(description, {_quoted(p)}, 1)')}[:35]" for p in references.PAYPAL)) + ")"
_SHOWN = f"trim({_without('description', references.LEADING)})"
_DISPLAY = f"""CASE WHEN {_SERVICE} THEN CASE WHEN paypal IS NOT NULL THEN 'PayPal · ' || paypal ELSE 'PayPal' END WHEN trim(coalesce(counterparty, '')) <> '' AND length(counterparty) > 2 THEN counterparty[:50]
ELSE CASE WHEN {_SHARE.format('shown')} > 0.5 THEN CASE WHEN length(shown) > 70 THEN shown[:70] || '…' ELSE shown END WHEN length(shown) > 50 THEN shown[:50] || '…' ELSE shown END END"""


@query(f""", p AS (SELECT *, {_PAYPAL} AS paypal, {_SHOWN} AS shown FROM bank_texts), d AS (SELECT *, {_DISPLAY} AS display_name FROM p)
SELECT id, paypal, display_name, coalesce(CASE WHEN {_SERVICE} AND {_BOUGHT} <> '' THEN CASE WHEN length({_BOUGHT}) > 50 THEN {_BOUGHT}[:50] || '…' ELSE {_BOUGHT} END END,
  CASE WHEN trim(remittance) <> '' AND length(remittance) > 5 THEN {_detail('remittance')} END, CASE WHEN length({_SECOND}) > 5 THEN {_detail(_SECOND)} END) AS detail,
  {LIGHT.format(f"CASE WHEN {_SERVICE} THEN display_name WHEN trim(coalesce(counterparty, '')) <> '' THEN counterparty ELSE description END")} AS match_key FROM d""")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user sees of each text: names, details, and the key by which texts belong together."""
    counterparty, description, remittance = (F.col(c) for c in ("counterparty", "description", "remittance"))
    return views.bank_texts(spark, sf_dir).select(
        "id", references.paypal_merchant(description).alias("paypal"), references.display_name(counterparty, description).alias("display_name"),
        references.detail_text(description, remittance, counterparty).alias("detail"), references.match_key(counterparty, description).alias("match_key"),
    )


_TAGS = ", ".join(f"{_found('description', references.TAGGED.format(t))} AS {name}" for name, t in references.TAGS.items())
_ACCOUNT = f"upper({_found('description', references.ACCOUNT)})"
_PURPOSE = _found("description", references.PURPOSE)


@query(f"""SELECT id, {_TAGS}, CASE WHEN length({_ACCOUNT}) >= 15 THEN {_ACCOUNT} END AS iban, upper({_found('description', references.BANK)}) AS bic,
CASE WHEN length({_PURPOSE}) > 5 THEN {_PURPOSE} ELSE {_collapsed(_without('description', [references.MARKERS], ' '))} END AS purpose FROM bank_texts""")
def sepa_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bank_texts(spark, sf_dir).select("id", references.sepa(F.col("description")).alias("x")).select("id", "x.*")


def _bank(x: str, banks: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{part}') THEN '{name}'" for part, name in banks) + " ELSE 'Unknown Bank' END"


@query(f"""SELECT page_id, {_bank('url', values.BANKS_BY_FILE)} AS of_file, {_bank('html', values.BANKS_BY_TEXT)} AS of_text,
CASE WHEN contains(lower(html), 'revolut') OR (contains(lower(html), 'product') AND contains(lower(html), 'started date')) THEN 'Revolut' WHEN contains(lower(html), 'ing') THEN 'ING' END AS of_header FROM pages""")
def bank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.read(spark, sf_dir, "pages")
    return pages.select("page_id", values.bank_of_file(F.col("url")).alias("of_file"), values.bank_of_text(F.col("html")).alias("of_text"), values.bank_of_header(F.col("html")).alias("of_header"))


# A statement's period as banks of each kind print it.
_PRINTED = {"german": "Kontoauszug Nr. 7 vom {0} - {1}", "international": "Statement Period: {0} to {1}", "revolut": "Kontotransaktionen von {2} bis {3}"}


@query(""", d AS (SELECT DISTINCT booking_date AS a, booking_date + 30 AS b FROM live)
SELECT a, strftime(a, '%d.%m.%Y') || ' - ' || strftime(b, '%d.%m.%Y') AS german, strftime(a, '%d.%m.%Y') || ' - ' || strftime(b, '%d.%m.%Y') AS international,
strftime(a, '%-d. %B %Y') || ' - ' || strftime(b, '%-d. %B %Y') AS revolut FROM d""")
def statement_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods printed as statements print them, and read back."""
    dates = views.transactions(spark, sf_dir, "booking_date").distinct().select(F.col("booking_date").alias("a"), F.date_add("booking_date", 30).alias("b"))
    parts = [F.date_format(c, form) for form in ("dd.MM.yyyy", "d. MMMM yyyy") for c in ("a", "b")]

    def printed(shown: str):
        out = F.lit(shown)
        for i, part in enumerate(parts):
            out = F.replace(out, F.lit(f"{{{i}}}"), part)
        return out

    return dates.select("a", *(values.period_in_text(printed(shown), style).alias(style) for style, shown in _PRINTED.items()))


_KNOWN = "(VALUES " + ", ".join(f"('{c}', '{e}', '{g}')" for c, (e, g) in categories.NAMES.items()) + ") AS n(c, en, de)"


@query(f""", i AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'predefined:TRAVEL' WHEN 1 THEN 'custom:' || p_size WHEN 2 THEN 'TAXES' WHEN 3 THEN 'predefined:NONE' ELSE p_type END AS identifier FROM part)
SELECT identifier, c AS category, CAST(nullif(regexp_extract(identifier, '^custom:(\\d+)$', 1), '') AS BIGINT) AS custom_id,
CASE WHEN c IS NULL AND NOT starts_with(identifier, 'predefined:') AND NOT starts_with(identifier, 'custom:') THEN identifier END AS custom_name, coalesce(en, 'Other') AS english, coalesce(de, 'Sonstiges') AS german
FROM i LEFT JOIN {_KNOWN} ON c = regexp_replace(identifier, '^predefined:', '')""")
def category_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "CASE p_partkey % 5 WHEN 0 THEN 'predefined:TRAVEL' WHEN 1 THEN concat('custom:', p_size) WHEN 2 THEN 'TAXES' WHEN 3 THEN 'predefined:NONE' ELSE p_type END AS identifier"
    found = views.read(spark, sf_dir, "part").selectExpr(made).distinct().withColumn("x", categories.identified(F.col("identifier"))).select("identifier", "x.*")
    return found.select("*", categories.category_name(F.col("category")).alias("english"), categories.category_name(F.col("category"), german=True).alias("german"))
