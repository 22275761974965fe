"""Lookups, lists and counts of accounts, statements, transactions, categories and merchants."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans import views
from tallyforge.plans.catalog import query

PAGE = 100
#: Sort orders of the transaction list: a key column and whether it descends.
ORDERS = {
    "date_desc": ("booking_date", True),
    "date_asc": ("booking_date", False),
    "amount_desc": ("amount_cents", True),
    "amount_asc": ("amount_cents", False),
    "name_asc": ("lower(coalesce(counterparty_name, description))", False),
}


def page(rows: DataFrame, order: list[Column], size: int = PAGE, skip: int = 0) -> DataFrame:
    """One page by offset: top-k over each partition, so only ``skip + size`` rows a task are kept."""
    return rows.orderBy(*order).offset(skip).limit(size)


def page_after(rows: DataFrame, last_date: datetime.date, last_id: int, size: int = PAGE) -> DataFrame:
    """The page after a row, newest first.  Its cost does not grow with depth, as that of an offset does."""
    after = (F.col("booking_date") < F.lit(last_date)) | ((F.col("booking_date") == F.lit(last_date)) & (F.col("id") < last_id))
    return rows.where(after).orderBy(F.desc("booking_date"), F.desc("id")).limit(size)


def filtered(rows: DataFrame, account: int | None = None, start: datetime.date | None = None, end: datetime.date | None = None, category: str | None = None) -> DataFrame:
    """Rows of an account, an inclusive range of dates and a category; None leaves a filter out."""
    if account is not None:
        rows = rows.where(F.col("account_id") == account)
    if start is not None:
        rows = rows.where(F.col("booking_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("booking_date") <= F.lit(end))
    if category is not None:
        rows = rows.where(F.col("auto_category") == category)
    return rows


def ordered(key: str) -> list[Column]:
    by, down = ORDERS[key]
    first = F.expr(by).desc_nulls_last() if down else F.expr(by).asc_nulls_last()
    return [first, F.desc("id"), F.col("booking_date"), F.col("amount_cents"), F.col("description")]  # ids repeat in the test tables


@query("SELECT * FROM accounts WHERE is_active")
def accounts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.accounts(spark, sf_dir).where("is_active").orderBy("name")


@query("SELECT * FROM accounts WHERE id = 7")
def account_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.accounts(spark, sf_dir).where("id = 7")


@query("SELECT * FROM accounts WHERE iban = 'DE00000000000000000012' ORDER BY id LIMIT 1")
def account_by_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inactive accounts are found too."""
    return views.accounts(spark, sf_dir).where("iban = 'DE00000000000000000012'").orderBy("id").limit(1)


@query("SELECT * FROM accounts WHERE bank_name = 'BUILDING' ORDER BY id LIMIT 1")
def account_by_bank_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.accounts(spark, sf_dir).where("bank_name = 'BUILDING'").orderBy("id").limit(1)


@query("SELECT count(*) AS n FROM accounts WHERE is_active")
def account_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.accounts(spark, sf_dir).where("is_active").agg(F.count("*").alias("n"))


@query("SELECT * FROM statements ORDER BY import_date DESC, id DESC")
def statements_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statements(spark, sf_dir).orderBy(F.desc("import_date"), F.desc("id"))


@query("SELECT * FROM statements WHERE id = 100")
def statement_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statements(spark, sf_dir).where("id = 100")


@query("SELECT * FROM statements WHERE account_id = 7")
def statements_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statements(spark, sf_dir).where("account_id = 7").orderBy(F.desc("import_date"), F.desc("id"))


@query("SELECT count(*) AS n FROM statements")
def statement_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statements(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT max(import_date) AS latest FROM statements")
def statements_latest_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statements(spark, sf_dir).agg(F.max("import_date").alias("latest"))


@query("SELECT count(*) AS n FROM statements WHERE account_id = 7")
def statement_count_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statements(spark, sf_dir).where("account_id = 7").agg(F.count("*").alias("n"))


@query("SELECT * FROM live")
def tx_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir)


@query("SELECT * FROM live ORDER BY booking_date DESC, id DESC, booking_date, amount_cents, description LIMIT 100 OFFSET 200")
def tx_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(views.transactions(spark, sf_dir), ordered("date_desc"), skip=200)


@query("SELECT * FROM live WHERE booking_date < DATE '1998-06-01' OR booking_date = DATE '1998-06-01' AND id < 50000 ORDER BY booking_date DESC, id DESC LIMIT 100")
def tx_paged_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_after(views.transactions(spark, sf_dir), datetime.date(1998, 6, 1), 50000)


@query("SELECT * FROM tx WHERE statement_id = 100")
def tx_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged duplicates included."""
    return views.transactions(spark, sf_dir, live=False).where("statement_id = 100")


@query("SELECT * FROM live WHERE account_id = 7")
def tx_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(views.transactions(spark, sf_dir), account=7)


@query("SELECT count(*) AS n FROM live WHERE account_id = 7")
def tx_count_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(views.transactions(spark, sf_dir, "account_id"), account=7).agg(F.count("*").alias("n"))


_MARCH = (datetime.date(1998, 3, 1), datetime.date(1998, 3, 31))


@query("SELECT * FROM live WHERE booking_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def tx_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(views.transactions(spark, sf_dir), None, *_MARCH)


@query("SELECT count(*) AS n FROM live WHERE booking_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def tx_count_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(views.transactions(spark, sf_dir, "booking_date"), None, *_MARCH).agg(F.count("*").alias("n"))


@query("SELECT * FROM live WHERE booking_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' ORDER BY booking_date DESC, id DESC, amount_cents, description LIMIT 100 OFFSET 100")
def tx_date_range_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(filtered(views.transactions(spark, sf_dir), None, *_MARCH), ordered("date_desc"), skip=100)


@query("SELECT * FROM live WHERE account_id BETWEEN 7 AND 7 AND booking_date >= DATE '1996-01-01' AND booking_date <= DATE '1999-12-31' ORDER BY booking_date DESC, id DESC, amount_cents, description LIMIT 100")
def tx_by_account_and_range_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(filtered(views.transactions(spark, sf_dir), 7, datetime.date(1996, 1, 1), datetime.date(1999, 12, 31)), ordered("date_desc"))


@query("SELECT count(*) AS n FROM live WHERE account_id = 7 AND booking_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def tx_count_by_account_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(views.transactions(spark, sf_dir, "account_id", "booking_date"), 7, datetime.date(1996, 1, 1), datetime.date(1999, 12, 31)).agg(F.count("*").alias("n"))


def _sorted_page(key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = filtered(views.transactions(spark, sf_dir), start=datetime.date(1997, 1, 1), category="ECONOMY")
        return page(rows, ordered(key), skip=100)

    by, down = ORDERS[key]
    query(
        f"SELECT * FROM live WHERE booking_date >= DATE '1997-01-01' AND auto_category = 'ECONOMY' ORDER BY {by} {'DESC' if down else 'ASC'} NULLS LAST, id DESC, booking_date, amount_cents, description LIMIT 100 OFFSET 100",
        f"tx_filtered_sorted_page_{key}",
    )(run)


for _key in ORDERS:
    _sorted_page(_key)


@query("SELECT count(*) AS n FROM live WHERE booking_date >= DATE '1997-01-01' AND auto_category = 'ECONOMY'")
def tx_count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(views.transactions(spark, sf_dir, "booking_date", "auto_category"), start=datetime.date(1997, 1, 1), category="ECONOMY").agg(F.count("*").alias("n"))


@query("SELECT * FROM live WHERE category_id = 3")
def tx_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir).where("category_id = 3")


@query("SELECT * FROM live WHERE category_id IS NULL")
def tx_uncategorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir).where("category_id IS NULL")


@query("SELECT count(*) AS n FROM live")
def tx_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir, "id").agg(F.count("*").alias("n"))


@query("SELECT * FROM categories")
def categories_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.categories(spark, sf_dir).orderBy("name")


@query("SELECT * FROM categories WHERE id = 2 OR name = 'EUROPE'")
def category_by_id_or_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.categories(spark, sf_dir).where("id = 2 OR name = 'EUROPE'")


@query("SELECT * FROM merchants WHERE name = 'Supplier#000000003' ORDER BY id LIMIT 1")
def merchant_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.merchants(spark, sf_dir).where("name = 'Supplier#000000003'").orderBy("id").limit(1)


@query("SELECT count(*) AS n FROM merchants")
def merchant_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.merchants(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT name, country_code FROM merchants")
def merchants_for_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.merchants(spark, sf_dir).select("name", "country_code")


def search_contains(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which a column contains ``text``, whatever its case; dates and amounts as they are shown."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return rows.where(hit)


@query("SELECT id, booking_date, amount_cents, description FROM live WHERE contains(lower(description), 'ring') OR contains(lower(coalesce(auto_category, '')), 'ring') OR contains(CAST(booking_date AS VARCHAR), 'ring')")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "booking_date", "amount_cents", "description", "auto_category")
    return search_contains(rows, "RING", "description", "auto_category", "booking_date").drop("auto_category")


def rolling(rows: DataFrame, as_of: datetime.date, days: int) -> DataFrame:
    """The last ``days`` days by approximate day numbers (years of 365 and months of 30 days); later rows are left out."""
    number = lambda c: F.year(c) * 365 + F.month(c) * 30 + F.dayofmonth(c)
    return rows.where((number(F.lit(as_of)) - number("booking_date")).between(0, days))


@query("SELECT id, booking_date, amount_cents FROM live WHERE (1999 * 365 + 3 * 30 + 15) - (year(booking_date) * 365 + month(booking_date) * 30 + day(booking_date)) BETWEEN 0 AND 30")
def filter_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling(views.transactions(spark, sf_dir, "id", "booking_date", "amount_cents"), datetime.date(1999, 3, 15), 30)


def calendar(rows: DataFrame, as_of: datetime.date, period: str) -> DataFrame:
    """The calendar month or year of ``as_of``, or its last seven days."""
    day = F.lit(as_of)
    if period == "week":
        return rows.where(F.col("booking_date").between(F.date_sub(day, 6), day))
    first = F.trunc(day, period)
    past = F.add_months(first, 1 if period == "month" else 12)
    return rows.where((F.col("booking_date") >= first) & (F.col("booking_date") < past))


@query("""SELECT 'week' AS period, id, booking_date, amount_cents FROM live WHERE booking_date BETWEEN DATE '1999-03-09' AND DATE '1999-03-15'
UNION ALL SELECT 'month', id, booking_date, amount_cents FROM live WHERE booking_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31'
UNION ALL SELECT 'year', id, booking_date, amount_cents FROM live WHERE year(booking_date) = 1999""")
def filter_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "booking_date", "amount_cents")
    parts = [calendar(rows, datetime.date(1999, 3, 15), p).select(F.lit(p).alias("period"), "*") for p in ("week", "month", "year")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Orders of statements by name, as SQL; ties have the larger id first.
STATEMENT_ORDERS = {"newest": "import_date DESC", "oldest": "import_date", "period": "coalesce(statement_period, '') DESC", "name": "lower(file_name)"}


def statement_order(name: str) -> list[Column]:
    by, _, falling = STATEMENT_ORDERS[name].partition(" DESC") if STATEMENT_ORDERS[name].endswith(" DESC") else (STATEMENT_ORDERS[name], "", None)
    return [F.expr(by).desc() if falling is not None else F.expr(by).asc(), F.desc("id")]


def sorted_statements(statements: DataFrame, order: str) -> DataFrame:
    return statements.orderBy(*statement_order(order))


_STATEMENTS = "(SELECT *, CASE WHEN id % 3 > 0 THEN strftime(import_date, '%Y-%m') END AS statement_period FROM statements)"


@query(" UNION ALL ".join(f"SELECT '{name}' AS sorting, * FROM (SELECT id, row_number() OVER (ORDER BY {by}, id DESC) AS place FROM {_STATEMENTS}) WHERE place <= {PAGE}" for name, by in STATEMENT_ORDERS.items()))
def statements_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each order."""
    rows = views.statements(spark, sf_dir).withColumn("statement_period", F.when(F.col("id") % 3 > 0, F.date_format("import_date", "yyyy-MM")))
    parts = [sorted_statements(rows, name).limit(PAGE).select(F.lit(name).alias("sorting"), "id", F.row_number().over(Window.orderBy(*statement_order(name))).alias("place")) for name in STATEMENT_ORDERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
