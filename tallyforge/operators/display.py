"""Transactions as a user sees them, and the numbers that charts are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import categories, references
from tallyforge.operators.categorize import with_overrides
from tallyforge.operators.merchants import KEYWORD_TABLE, KEYWORDS, OWN_ALIASES, alias_table, keyword_matches, lookup_sql, merchant_categories, merchant_index, merchant_list
from tallyforge.operators.spending import month, spent
from tallyforge.operators.trends import compare, direction, latest_months
from tallyforge.plans import views
from tallyforge.plans.catalog import query


def enriched(rows: DataFrame, accounts: DataFrame, statements: DataFrame, overrides: DataFrame, custom: DataFrame, keywords: DataFrame, merchants: DataFrame) -> DataFrame:
    """``rows`` with ``category``, ``custom_name``, ``account_name`` (empty without one), ``source_path`` (of PDF statements) and ``detail``.

    The category is that of the override (OTHER beside a custom category that exists), else the stored one, else of a
    keyword, else, for expenses, of a merchant, else OTHER.  Texts are matched once for each pair of them.
    """
    stored = F.nullif(F.trim(F.coalesce("auto_category", F.lit(""))), F.lit(""))
    texts = rows.select("description", "counterparty_name").distinct().withColumn("t_whole", F.concat_ws(" ", "description", "counterparty_name"))
    found = with_overrides(texts, overrides).join(custom.select(F.col("id").alias("custom_id"), F.col("name").alias("custom_name")), "custom_id", "left")
    whole = texts.select("t_whole").distinct()
    by_word = keyword_matches(whole, "t_whole", "t_whole", keywords).select("t_whole", F.col("category").alias("by_keyword"))
    by_name = merchant_categories(whole, "t_whole", "t_whole", merchants).select("t_whole", F.col("category").alias("by_merchant"))
    found = found.join(by_word, "t_whole", "left").join(by_name, "t_whole", "left").select(F.col("description").alias("of_description"), F.col("counterparty_name").alias("of_counterparty"), "override", "custom_name", "by_keyword", "by_merchant")
    same = F.col("description").eqNullSafe(F.col("of_description")) & F.col("counterparty_name").eqNullSafe(F.col("of_counterparty"))
    out = rows.join(found, same).drop("of_description", "of_counterparty")
    known = F.when(stored.isNull(), F.coalesce("by_keyword", F.when(F.col("amount_cents") < 0, F.col("by_merchant")))).otherwise(F.when(stored.isin(categories.CATEGORIES), stored))
    category = F.when(F.col("custom_name").isNotNull(), "OTHER").otherwise(F.coalesce("override", known, F.lit("OTHER")))
    names = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    files = statements.select(F.col("id").alias("statement_id"), F.when(F.col("source_type") == "PDF", F.col("file_path")).alias("source_path"))
    out = out.withColumn("category", category).join(names, "account_id", "left").join(files, "statement_id", "left")
    detail = references.detail_text(F.col("description"), F.col("remittance_info"), F.col("counterparty_name"))
    return out.select(*rows.columns, "category", "custom_name", F.coalesce("account_name", F.lit("")).alias("account_name"), "source_path", detail.alias("detail"))


@query(f""", p AS (SELECT DISTINCT description, counterparty_name, concat_ws(' ', description, counterparty_name) AS w FROM live), n AS (SELECT DISTINCT w FROM p), {lookup_sql('n', 'w', 'w')},
kw AS (SELECT w, category, row_number() OVER (PARTITION BY w ORDER BY length(keyword) DESC, position) AS place FROM n JOIN {KEYWORD_TABLE} ON contains(' ' || replace(lower(w), '#', ' ') || ' ', ' ' || keyword || ' ')),
x AS (SELECT l.*, concat_ws(' ', l.description, l.counterparty_name) AS w FROM live l)
SELECT x.id, x.amount_cents, CASE WHEN x.counterparty_name = 'hot rod' THEN 'OTHER' WHEN x.counterparty_name = 'small rod' THEN 'TAXES' WHEN x.auto_category IS NOT NULL THEN 'OTHER' ELSE coalesce(kw.category, CASE WHEN x.amount_cents < 0 THEN f.category END, 'OTHER') END AS category,
CASE WHEN x.counterparty_name = 'hot rod' THEN 'AMERICA' END AS custom_name, coalesce(a.name, '') AS account_name, CASE WHEN s.id % 2 = 0 THEN s.file_name END AS source_path, NULL AS detail
FROM x LEFT JOIN kw ON kw.w = x.w AND kw.place = 1 LEFT JOIN found f ON f.w = x.w LEFT JOIN accounts a ON a.id = x.account_id LEFT JOIN statements s ON s.id = x.statement_id""")
def enriched_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "account_id", "statement_id", "amount_cents", "description", "counterparty_name", "auto_category").withColumn("remittance_info", F.lit(None).cast("string"))
    statements = views.statements(spark, sf_dir).select("id", F.col("file_name").alias("file_path"), F.when(F.col("id") % 2 == 0, "PDF").otherwise("CSV").alias("source_type"))
    overrides = spark.createDataFrame([("small rod", "TAXES"), ("hot rod", "custom:2"), ("old rod", "custom:77")], "pattern string, category_name string")
    keywords = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(KEYWORDS)], "position int, category string, keyword string")
    out = enriched(rows, views.accounts(spark, sf_dir), statements, overrides, views.categories(spark, sf_dir), keywords, merchant_index(merchant_list(spark), alias_table(spark, OWN_ALIASES)))
    return out.select("id", "amount_cents", "category", "custom_name", "account_name", "source_path", "detail")


_MONTHS = "m AS (SELECT strftime(booking_date, '%Y-%m') AS month, {0}, CAST(sum(amount_cents) AS BIGINT) AS total FROM live WHERE amount_cents < 0 AND auto_category IS NOT NULL AND {0} IS NOT NULL GROUP BY 1, 2), two AS (SELECT max(month) AS now, (SELECT max(month) FROM m WHERE month < (SELECT max(month) FROM m)) AS before FROM m)"
_CHANGE = "CAST(CASE WHEN p <> 0 THEN CAST((c - p) * CAST(100.0 AS DOUBLE) / abs(p) AS FLOAT) WHEN c <> 0 THEN 100 ELSE 0 END AS FLOAT)"


def with_trends(totals: DataFrame, sums: DataFrame, key: str, new: bool = False) -> DataFrame:
    """``totals`` with ``trend``, the change of each ``key`` between the two latest months of ``sums``; null where it has none."""
    months = latest_months(sums)
    if len(months) < 2:
        return totals.withColumn("trend", F.lit(None).cast("string"))
    now, before = F.col("current"), F.col("previous")
    trend = direction(now, before)
    both = compare(sums, [key], *months).where("current <> 0" if new else "current <> 0 OR previous <> 0")
    return totals.join(both.select(key, (F.when(before == 0, "NEW").otherwise(trend) if new else trend).alias("trend")), key, "left")


@query(f""", {_MONTHS.format('auto_category')}, t AS (SELECT auto_category, CAST(sum(total) AS BIGINT) AS total FROM m GROUP BY 1),
q AS (SELECT auto_category, coalesce(sum(total) FILTER (month = now), 0) AS c, coalesce(sum(total) FILTER (month = before), 0) AS p FROM m, two WHERE month IN (now, before) GROUP BY 1)
SELECT t.*, CASE WHEN c IS NULL OR c = 0 AND p = 0 THEN NULL WHEN abs({_CHANGE}) < 5 THEN 'STABLE' WHEN c < p THEN 'UP' WHEN c IS NOT NULL THEN 'DOWN' END AS trend FROM t LEFT JOIN q USING (auto_category)""")
def category_totals_with_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = spent(spark, sf_dir, "booking_date").groupBy(month(), "auto_category").agg(F.sum("amount_cents").alias("total"))
    return with_trends(sums.groupBy("auto_category").agg(F.sum("total").alias("total")), sums, "auto_category")


@query(f""", {_MONTHS.format('counterparty_name')}, t AS (SELECT counterparty_name, CAST(sum(total) AS BIGINT) AS total FROM m GROUP BY 1 ORDER BY 2, 1 LIMIT 10),
q AS (SELECT counterparty_name, coalesce(sum(total) FILTER (month = now), 0) AS c, coalesce(sum(total) FILTER (month = before), 0) AS p FROM m, two WHERE month IN (now, before) GROUP BY 1)
SELECT t.*, CASE WHEN c IS NULL OR c = 0 THEN NULL WHEN p = 0 THEN 'NEW' WHEN abs({_CHANGE}) < 5 THEN 'STABLE' WHEN c < p THEN 'UP' WHEN c IS NOT NULL THEN 'DOWN' END AS trend FROM t LEFT JOIN q USING (counterparty_name)""")
def merchant_history_with_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spent(spark, sf_dir, "booking_date", "counterparty_name").where("counterparty_name IS NOT NULL")
    sums = rows.groupBy(month(), "counterparty_name").agg(F.sum("amount_cents").alias("total"))
    top = sums.groupBy("counterparty_name").agg(F.sum("total").alias("total")).orderBy("total", "counterparty_name").limit(10)
    return with_trends(top, sums, "counterparty_name", new=True)


@query(""", c AS (SELECT auto_category, CAST(sum(amount_cents) AS BIGINT) AS total FROM live WHERE amount_cents < 0 AND auto_category IS NOT NULL GROUP BY 1), s AS (SELECT *, total * 360.0 / sum(total) OVER () AS sweep FROM c)
SELECT auto_category, round(CAST(sweep AS DOUBLE), 6) AS sweep, round(CAST(coalesce(sum(sweep) OVER (ORDER BY total, auto_category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE), 6) AS start FROM s ORDER BY total, auto_category LIMIT 8""")
def donut_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest categories as arcs: shares of 360 degrees, one after the other.  The window is over a row a category."""
    sums = spent(spark, sf_dir).groupBy("auto_category").agg(F.sum("amount_cents").alias("total"))
    sweep = F.col("total") * 360.0 / F.sum("total").over(Window.partitionBy())
    placed = sums.withColumn("sweep", sweep).withColumn("start", F.coalesce(F.sum("sweep").over(Window.orderBy("total", "auto_category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return placed.orderBy("total", "auto_category").limit(8).select("auto_category", F.round("sweep", 6).alias("sweep"), F.round("start", 6).alias("start"))


@query("""SELECT max(i) AS most_income, max(e) AS most_expenses, CAST(greatest(max(i), max(e)) AS BIGINT) AS most FROM (SELECT strftime(booking_date, '%Y-%m') AS month, CAST(coalesce(sum(amount_cents) FILTER (amount_cents > 0), 0) AS BIGINT) AS i,
CAST(coalesce(-sum(amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS e FROM live GROUP BY 1)""")
def chart_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest month of income and of expenses, to which charts are scaled."""
    sums = views.transactions(spark, sf_dir, "booking_date", "amount_cents").groupBy(month()).agg(
        F.coalesce(F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents"))), F.lit(0)).alias("i"), F.coalesce(-F.sum(F.when(F.col("amount_cents") < 0, F.col("amount_cents"))), F.lit(0)).alias("e")
    )
    return sums.agg(F.max("i").alias("most_income"), F.max("e").alias("most_expenses"), F.max(F.greatest("i", "e")).alias("most"))
