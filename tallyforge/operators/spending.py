"""Sums of transactions: by month, category, merchant, account and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans import views
from tallyforge.plans.catalog import query


def month(c: str = "booking_date") -> Column:
    return F.date_format(c, "yyyy-MM").alias("month")


def expenses(c: str = "amount_cents") -> Column:
    return F.sum(F.when(F.col(c) < 0, F.col(c)).otherwise(0))


def income(c: str = "amount_cents") -> Column:
    return F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0))


def by_month(rows: DataFrame) -> DataFrame:
    return rows.groupBy(month()).agg(expenses().alias("expenses"), income().alias("income"), F.sum("amount_cents").alias("net"))


_MONTH = "strftime(booking_date, '%Y-%m') AS month"
_BOTH = "CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS expenses, CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS income"
_TOTAL = "CAST(sum(amount_cents) AS BIGINT) AS total"


@query(f"SELECT {_MONTH}, {_BOTH}, CAST(sum(amount_cents) AS BIGINT) AS net FROM live GROUP BY 1")
def monthly_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_month(views.transactions(spark, sf_dir, "booking_date", "amount_cents"))


@query(f"SELECT {_MONTH}, {_BOTH}, CAST(sum(amount_cents) AS BIGINT) AS net FROM live WHERE account_id = 7 GROUP BY 1")
def monthly_spending_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_month(views.transactions(spark, sf_dir, "booking_date", "amount_cents", "account_id").where("account_id = 7"))


@query("SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS balance FROM live")
def total_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir, "amount_cents").agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("balance"))


@query("SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS balance FROM live WHERE account_id = -1")
def total_balance_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an account without transactions: zero, not null."""
    return views.transactions(spark, sf_dir, "amount_cents", "account_id").where("account_id = -1").agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("balance"))


@query(f"SELECT {_BOTH} FROM live")
def income_expense_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir, "amount_cents").agg(expenses().alias("expenses"), income().alias("income"))


@query(f"SELECT category_id, any_value(c.name) AS name, count(*) AS n, {_TOTAL} FROM live LEFT JOIN categories c ON category_id = c.id GROUP BY category_id")
def category_summary_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by manual category; rows without one are a group, and so are ids without a category.  Summed before the join."""
    sums = views.transactions(spark, sf_dir, "category_id", "amount_cents").groupBy("category_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total"))
    names = views.categories(spark, sf_dir).withColumnRenamed("id", "category_id")
    return sums.join(names, "category_id", "left").select("category_id", "name", "n", "total").orderBy("total")


_SPENT = "FROM live WHERE amount_cents < 0 AND auto_category IS NOT NULL"


def spent(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return views.transactions(spark, sf_dir, "amount_cents", "auto_category", *columns).where("amount_cents < 0 AND auto_category IS NOT NULL")


@query(f"SELECT {_MONTH}, auto_category, {_TOTAL} {_SPENT} GROUP BY 1, 2")
def category_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spent(spark, sf_dir, "booking_date").groupBy(month(), "auto_category").agg(F.sum("amount_cents").alias("total")).orderBy(F.desc("month"), "total")


@query(f"SELECT {_MONTH}, auto_category, {_TOTAL} {_SPENT} AND account_id = 7 GROUP BY 1, 2")
def category_by_month_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spent(spark, sf_dir, "booking_date", "account_id").where("account_id = 7").groupBy(month(), "auto_category").agg(F.sum("amount_cents").alias("total"))


@query(f"SELECT auto_category, {_TOTAL}, count(*) AS n {_SPENT} GROUP BY 1")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spent(spark, sf_dir).groupBy("auto_category").agg(F.sum("amount_cents").alias("total"), F.count("*").alias("n")).orderBy("total")


@query(f"SELECT {_MONTH}, counterparty_name, auto_category, {_TOTAL}, count(*) AS n {_SPENT} AND counterparty_name IS NOT NULL GROUP BY 1, 2, 3")
def merchant_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spent(spark, sf_dir, "booking_date", "counterparty_name").where("counterparty_name IS NOT NULL")
    return rows.groupBy(month(), "counterparty_name", "auto_category").agg(F.sum("amount_cents").alias("total"), F.count("*").alias("n"))


@query(f"""SELECT counterparty_name, min(auto_category) AS auto_category, {_TOTAL}, count(*) AS n FROM live
WHERE amount_cents < 0 AND counterparty_name IS NOT NULL GROUP BY 1 ORDER BY total, counterparty_name LIMIT 20""")
def top_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "amount_cents", "counterparty_name", "auto_category").where("amount_cents < 0 AND counterparty_name IS NOT NULL")
    sums = rows.groupBy("counterparty_name").agg(F.min("auto_category").alias("auto_category"), F.sum("amount_cents").alias("total"), F.count("*").alias("n"))
    return sums.orderBy("total", "counterparty_name").limit(20)


@query("""SELECT a.id, a.name, count(t.id) AS n, CAST(sum(t.amount_cents) AS BIGINT) AS balance
FROM accounts a LEFT JOIN tx t ON t.account_id = a.id AND NOT t.is_duplicate WHERE a.is_active GROUP BY 1, 2""")
def account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active accounts; one without transactions has the count 0 and a null balance.  Summed before the join."""
    sums = views.transactions(spark, sf_dir, "account_id", "amount_cents").groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("balance"))
    own = views.accounts(spark, sf_dir).where("is_active").select("id", "name")
    return own.join(sums, own["id"] == sums["account_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), "balance").orderBy("name")


@query(f""", s AS (SELECT auto_category, {_TOTAL}, count(*) AS n {_SPENT} GROUP BY 1)
SELECT auto_category, total, n, CAST(round(total * 10000.0 / sum(total) OVER ()) AS BIGINT) AS share_bp FROM s""")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's share of all expenses, in hundredths of a percent.  The window is over one row a category."""
    sums = spent(spark, sf_dir).groupBy("auto_category").agg(F.sum("amount_cents").alias("total"), F.count("*").alias("n"))
    whole = F.sum("total").over(Window.partitionBy())
    return sums.withColumn("share_bp", F.round(F.col("total") * 10000.0 / whole).cast("long")).orderBy("total")


@query(f"SELECT {_MONTH}, auto_category, CAST(sum(abs(amount_cents)) AS BIGINT) AS spent {_SPENT} GROUP BY 1, 2")
def month_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spent(spark, sf_dir, "booking_date").groupBy(month(), "auto_category").agg(F.sum(F.abs("amount_cents")).alias("spent"))


@query(f"SELECT booking_date, count(*) AS n, {_TOTAL} FROM live GROUP BY 1")
def day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir, "booking_date", "amount_cents").groupBy("booking_date").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total"))


@query(f"""SELECT auto_category, count(*) AS n, {_TOTAL}, {_BOTH}, CAST(round(sum(amount_cents) * 1.0 / count(*)) AS BIGINT) AS average
FROM live WHERE auto_category IS NOT NULL GROUP BY 1""")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "amount_cents", "auto_category").where("auto_category IS NOT NULL")
    average = F.round(F.sum("amount_cents") * 1.0 / F.count("*")).cast("long")
    return rows.groupBy("auto_category").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total"), expenses().alias("expenses"), income().alias("income"), average.alias("average"))


@query(f"SELECT auto_category, {_TOTAL} {_SPENT} GROUP BY 1 ORDER BY abs(sum(amount_cents)) DESC, auto_category LIMIT 4")
def top_n_category_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = spent(spark, sf_dir).groupBy("auto_category").agg(F.sum("amount_cents").alias("total"))
    return sums.orderBy(F.desc(F.abs("total")), "auto_category").limit(4)


@query("SELECT id, booking_date, amount_cents, description FROM live WHERE auto_category = 'ECONOMY' AND amount_cents < 0 ORDER BY amount_cents, id, booking_date, description LIMIT 10")
def top_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "booking_date", "amount_cents", "description", "auto_category").where("auto_category = 'ECONOMY' AND amount_cents < 0")
    return rows.drop("auto_category").orderBy("amount_cents", "id", "booking_date", "description").limit(10)


@query(f""", m AS (SELECT {_MONTH}, auto_category, CAST(sum(abs(amount_cents)) AS BIGINT) AS spent {_SPENT} GROUP BY 1, 2),
t AS (SELECT auto_category, row_number() OVER (ORDER BY sum(spent) DESC, auto_category) AS place FROM m GROUP BY 1),
g AS (SELECT x.month, t.auto_category, t.place, coalesce(m.spent, 0) AS spent FROM (SELECT DISTINCT month FROM m) x CROSS JOIN t LEFT JOIN m ON m.month = x.month AND m.auto_category = t.auto_category WHERE place <= 3)
SELECT month, auto_category, CAST(place AS INTEGER) AS place, CAST(sum(spent) OVER (PARTITION BY month ORDER BY place) AS BIGINT) AS stacked FROM g""")
def stacked_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over the three largest categories of each month; a category missing from a month adds nothing.

    A month is one row with an array of the ranked categories, so nothing is multiplied out but what is returned.
    """
    sums = spent(spark, sf_dir, "booking_date").groupBy(month(), "auto_category").agg(F.sum(F.abs("amount_cents")).alias("spent"))
    top = [r[0] for r in sums.groupBy("auto_category").agg(F.sum("spent").alias("spent")).orderBy(F.desc("spent"), "auto_category").limit(3).collect()]
    wide = sums.groupBy("month").agg(*(F.coalesce(F.sum(F.when(F.col("auto_category") == c, F.col("spent"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(top)))
    rows, running = [], F.lit(0).cast("long")
    for i, c in enumerate(top):
        running = running + F.col(f"c{i}")
        rows.append(F.struct(F.lit(c).alias("auto_category"), F.lit(i + 1).alias("place"), running.alias("stacked")))
    return wide.select("month", F.explode(F.array(*rows)).alias("x")).select("month", "x.*") if top else sums.selectExpr("month", "auto_category", "1 AS place", "spent AS stacked")


@query(f"""SELECT bank_name, {_MONTH}, grouping_id(bank_name, strftime(booking_date, '%Y-%m')) AS level, {_TOTAL}
FROM live JOIN accounts a ON account_id = a.id GROUP BY ROLLUP (bank_name, strftime(booking_date, '%Y-%m'))""")
def bank_month_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: subtotals by bank and month, by bank, and overall.  Summed by account and month before the join."""
    sums = views.transactions(spark, sf_dir, "account_id", "booking_date", "amount_cents").groupBy("account_id", month()).agg(F.sum("amount_cents").alias("total"))
    banks = views.accounts(spark, sf_dir).select(F.col("id").alias("account_id"), "bank_name")
    return sums.join(banks, "account_id").rollup("bank_name", "month").agg(F.grouping_id("bank_name", "month").alias("level"), F.sum("total").alias("total"))
