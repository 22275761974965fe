"""Export files: transactions and spending as delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.spending import expenses, income, month
from tallyforge.plans import views
from tallyforge.plans.catalog import query

HEADER = "Date,Description,Counterparty,Category,Amount,Currency,Account"


def escaped(c: Column) -> Column:
    """Quoted, with doubled quotes, if it has a comma, a quote or a line break; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def fixed(cents: Column) -> Column:
    """Cents with two decimals and a dot."""
    size = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def transaction_lines(rows: DataFrame, account: str | None = None) -> DataFrame:
    """A ``line`` for each row (``account_name`` and ``currency`` among its columns); None or "All Accounts" are all accounts."""
    if account not in (None, "All Accounts"):
        rows = rows.where(F.col("account_name") == account)
    fields = [F.date_format("booking_date", "dd.MM.yyyy"), escaped(F.col("description")), escaped(F.col("counterparty_name")), escaped(F.col("auto_category")), fixed(F.col("amount_cents")), F.col("currency"), escaped(F.col("account_name"))]
    return rows.select(F.concat_ws(",", *fields).alias("line"))


def write_lines(lines: DataFrame, path: str, header: str | None = HEADER) -> None:
    """Text files below ``path``, each with the header, so that each can be read on its own."""
    options = {"header": "true"} if header else {}
    named = lines.toDF(header) if header else lines
    named.write.mode("overwrite").options(quote="", escapeQuotes="false", sep="\x01", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **options).csv(path)


def spending_lines(rows: DataFrame) -> DataFrame:
    """``section``, ``place`` and ``line`` of a spending report: totals, categories by amount, months."""
    totals = rows.agg(income().alias("i"), expenses().alias("e"))
    whole = F.greatest(F.abs(F.first("e")), F.lit(1))
    first = totals.select(F.lit(1).alias("section"), F.lit("0").alias("place"), F.concat_ws(",", F.lit("Total"), fixed(F.coalesce("i", F.lit(0))), fixed(F.coalesce("e", F.lit(0)))).alias("line"))
    sums = rows.where("amount_cents < 0").groupBy("auto_category").agg(F.sum("amount_cents").alias("t"), F.count("*").alias("n"))
    spent = totals.select(F.greatest(F.abs(F.coalesce("e", F.lit(0))), F.lit(1)).alias("whole"), F.lit(1).alias("one"))
    second = sums.withColumn("one", F.lit(1)).join(F.broadcast(spent), "one").select(F.lit(2).alias("section"), F.lpad((F.col("t") + F.lit(10**17)).cast("string"), 20, "0").alias("place"), F.concat_ws(",", escaped(F.col("auto_category")), fixed(F.col("t")), F.concat(F.floor(F.abs("t") * 100 / F.col("whole")).cast("string"), F.lit("%")), F.col("n").cast("string")).alias("line"))
    third = rows.groupBy(month()).agg(income().alias("i"), expenses().alias("e")).select(F.lit(3).alias("section"), F.col("month").alias("place"), F.concat_ws(",", "month", fixed(F.col("i")), fixed(F.col("e")), fixed(F.col("i") + F.col("e"))).alias("line"))
    return first.unionByName(second).unionByName(third).orderBy("section", "place")


_FIXED = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')"


@query(f"""SELECT strftime(booking_date, '%d.%m.%Y') || ',' || CASE WHEN contains(description, '#') THEN '"' || replace(description, '#', ',""') || '"' ELSE description END || ',' || coalesce(counterparty_name, '') || ',' || coalesce(auto_category, '') || ','
|| {_FIXED.format('amount_cents')} || ',EUR,' || a.name AS line FROM live JOIN accounts a ON account_id = a.id""")
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).withColumn("description", F.replace("description", F.lit("#"), F.lit(',"')))
    names = views.accounts(spark, sf_dir).select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return transaction_lines(rows.join(names, "account_id").withColumn("currency", F.lit("EUR")))


@query(f""", t AS (SELECT CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS e FROM live),
c AS (SELECT auto_category, CAST(sum(amount_cents) AS BIGINT) AS t, count(*) AS n FROM live WHERE amount_cents < 0 GROUP BY 1),
m AS (SELECT strftime(booking_date, '%Y-%m') AS month, CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS e FROM live GROUP BY 1)
SELECT 1 AS section, 'Total,' || {_FIXED.format('i')} || ',' || {_FIXED.format('e')} AS line FROM t
UNION ALL SELECT 2, coalesce(auto_category, '') || ',' || {_FIXED.format('c.t')} || ',' || (abs(c.t) * 100 // abs(e)) || '%,' || n FROM c, t
UNION ALL SELECT 3, month || ',' || {_FIXED.format('i')} || ',' || {_FIXED.format('e')} || ',' || {_FIXED.format('(i + e)')} FROM m""")
def export_spending_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spending_lines(views.transactions(spark, sf_dir, "booking_date", "amount_cents", "auto_category")).drop("place")


def money(cents: Column) -> Column:
    """Cents with a sign, two decimals and the currency's sign."""
    return F.concat(F.when(cents < 0, "-").otherwise("+"), F.replace(fixed(F.abs(cents)), F.lit("-"), F.lit("")), F.lit(" €"))


def transaction_content(rows: DataFrame, account: str | None = None) -> DataFrame:
    """What a printed list of transactions holds: ``place`` and ``kind`` of each part, its text, category and amount.

    Days come by their dates as they are shown, falling; a line is named by the counterparty, else by the first forty
    characters of the description; the sums stand at the end.
    """
    if account not in (None, "All Accounts"):
        rows = rows.where(F.col("account_name") == account)
    day = F.date_format("booking_date", "dd.MM.yyyy")
    none = F.lit(None).cast("string")
    part = lambda df, order, kind, label, category=none, amount=none: df.select(F.lit(order).alias("section"), day.alias("day") if order == 2 else F.lit("").alias("day"), F.lit(kind).alias("kind"), label.alias("label"), category.alias("category"), amount.alias("amount"))
    sums = rows.agg(F.count("*").alias("n"), income().alias("i"), expenses().alias("e")).select("n", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("e", F.lit(0)).alias("e"))
    head = part(sums, 1, "subtitle", F.concat(F.col("n").cast("string"), F.lit(" transactions")))
    days = rows.select("booking_date").distinct().select(F.lit(2).alias("section"), day.alias("day"), F.lit("date").alias("kind"), day.alias("label"), none.alias("category"), none.alias("amount"))
    lines = part(rows, 2, "transaction", F.coalesce("counterparty_name", F.substring("description", 1, 40)), F.col("auto_category"), money(F.col("amount_cents")))
    totals = [part(sums, 3 + i, "sum", F.lit(name), none, money(c)) for i, (name, c) in enumerate((("Total Income", F.col("i")), ("Total Expenses", F.col("e")), ("Net Balance", F.col("i") + F.col("e"))))]
    out = head.unionByName(days).unionByName(lines)
    for t in totals:
        out = out.unionByName(t)
    return out.orderBy("section", F.desc("day"), "kind")


def spending_content(rows: DataFrame) -> DataFrame:
    """What a printed spending report holds: sums, categories with expenses by amount, months."""
    none = F.lit(None).cast("string")
    sums = rows.agg(income().alias("i"), expenses().alias("e")).select(F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("e", F.lit(0)).alias("e"))
    head = [sums.select(F.lit(i).alias("section"), F.lit("").alias("place"), F.lit(name).alias("label"), money(c).alias("amount"), none.alias("more")) for i, (name, c) in enumerate((("Total Income", F.col("i")), ("Total Expenses", F.col("e")), ("Net Balance", F.col("i") + F.col("e"))))]
    spent = rows.where("amount_cents < 0").groupBy("auto_category").agg(F.sum("amount_cents").alias("t"), F.count("*").alias("n"))
    whole = sums.select(F.greatest(F.abs("e"), F.lit(1)).alias("whole"), F.lit(1).alias("one"))  # one row
    share = F.concat(F.floor(F.abs("t") * 100 / F.col("whole")).cast("string"), F.lit("% "), F.col("n").cast("string"))
    body = spent.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select(F.lit(3).alias("section"), F.lpad((F.col("t") + F.lit(10**17)).cast("string"), 20, "0").alias("place"), F.col("auto_category").alias("label"), money(F.col("t")).alias("amount"), share.alias("more"))
    months = rows.groupBy(month()).agg(income().alias("i"), expenses().alias("e")).select(F.lit(4).alias("section"), F.col("month").alias("place"), F.col("month").alias("label"), money(F.col("i") + F.col("e")).alias("amount"), F.concat_ws(" ", money(F.col("i")), money(F.col("e"))).alias("more"))
    out = head[0].unionByName(head[1]).unionByName(head[2]).unionByName(body).unionByName(months)
    return out.orderBy("section", "place")


_MONEY = "CASE WHEN {0} < 0 THEN '-' ELSE '+' END || (abs({0}) // 100) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0') || ' €'"
_T = """t AS (SELECT count(*) AS n, CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0), 0) AS BIGINT) AS i, CAST(coalesce(sum(amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS e FROM live)"""
_SUMS = "UNION ALL SELECT {0} + 1, {1} 'Total Expenses', {2} FROM t UNION ALL SELECT {0} + 2, {1} 'Net Balance', {3} FROM t"


@query(f""", {_T}, d AS (SELECT *, strftime(booking_date, '%d.%m.%Y') AS day FROM live)
SELECT 1 AS section, '' AS day, 'subtitle' AS kind, n || ' transactions' AS label, NULL AS category, NULL AS amount FROM t UNION ALL SELECT DISTINCT 2, day, 'date', day, NULL, NULL FROM d
UNION ALL SELECT 2, day, 'transaction', coalesce(counterparty_name, description[:40]), auto_category, {_MONEY.format('amount_cents')} FROM d
UNION ALL SELECT 3, '', 'sum', 'Total Income', NULL, {_MONEY.format('i')} FROM t UNION ALL SELECT 4, '', 'sum', 'Total Expenses', NULL, {_MONEY.format('e')} FROM t UNION ALL SELECT 5, '', 'sum', 'Net Balance', NULL, {_MONEY.format('(i + e)')} FROM t""")
def printed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_content(views.transactions(spark, sf_dir, "booking_date", "counterparty_name", "description", "auto_category", "amount_cents"))


@query(f""", {_T}, c AS (SELECT auto_category, CAST(sum(amount_cents) AS BIGINT) AS t, count(*) AS n FROM live WHERE amount_cents < 0 GROUP BY 1),
m AS (SELECT strftime(booking_date, '%Y-%m') AS month, CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0), 0) AS BIGINT) AS i, CAST(coalesce(sum(amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS e FROM live GROUP BY 1)
SELECT 0 AS section, 'Total Income' AS label, {_MONEY.format('i')} AS amount, NULL AS more FROM t UNION ALL SELECT 1, 'Total Expenses', {_MONEY.format('e')}, NULL FROM t UNION ALL SELECT 2, 'Net Balance', {_MONEY.format('(i + e)')}, NULL FROM t
UNION ALL SELECT 3, auto_category, {_MONEY.format('c.t')}, (abs(c.t) * 100 // abs(t.e)) || '% ' || c.n FROM c, t UNION ALL SELECT 4, month, {_MONEY.format('(i + e)')}, {_MONEY.format('i')} || ' ' || {_MONEY.format('e')} FROM m""")
def printed_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spending_content(views.transactions(spark, sf_dir, "booking_date", "amount_cents", "auto_category")).drop("place")
