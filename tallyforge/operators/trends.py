"""Changes from one period to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.spending import month, spent
from tallyforge.plans.catalog import query

STABLE_BELOW = 5.0  # percent


def latest_months(rows: DataFrame, n: int = 2) -> list[str]:
    """The latest months that are present in ``rows`` (at most ``n`` strings come to the driver)."""
    return [r[0] for r in rows.select("month").distinct().orderBy(F.desc("month")).limit(n).collect()]


def percent_change(now: Column, before: Column) -> Column:
    """In percent of the earlier amount, as a float; 100 where there was none before, 0 where there is nothing."""
    change = ((now - before) * 100.0 / F.abs(before)).cast("float")
    return F.when(before != 0, change).when(now != 0, F.lit(100.0)).otherwise(0.0).cast("float")


def direction(now: Column, before: Column) -> Column:
    """UP is more spending: amounts are negative."""
    return F.when(F.abs(percent_change(now, before)) < STABLE_BELOW, "STABLE").when(now < before, "UP").otherwise("DOWN")


def compare(sums: DataFrame, keys: list[str], now: str, before: str) -> DataFrame:
    """``sums`` (keys, ``month``, ``total``) of two months side by side, in one pass."""
    pick = lambda m: F.coalesce(F.sum(F.when(F.col("month") == m, F.col("total"))), F.lit(0))
    return sums.where(F.col("month").isin(now, before)).groupBy(*keys).agg(pick(now).alias("current"), pick(before).alias("previous"))


def indicator(trend: Column) -> Column:
    return F.when(trend == "UP", "↑").when(trend == "DOWN", "↓").when(trend == "NEW", "✨").otherwise("→")


def percent_label(percent: Column) -> Column:
    size = F.abs(percent)
    return F.when(size < 1, "<1%").when(size > 999, ">999%").otherwise(F.concat(F.floor(size).cast("string"), F.lit("%")))


_SUMS = ", m AS (SELECT strftime(booking_date, '%Y-%m') AS month, {keys}, CAST(sum(amount_cents) AS BIGINT) AS total, count(*) AS n FROM live WHERE amount_cents < 0 AND auto_category IS NOT NULL {more} GROUP BY ALL), two AS (SELECT max(month) AS now, (SELECT max(month) FROM m WHERE month < (SELECT max(month) FROM m)) AS before FROM m)"
_PCT = "CAST(CASE WHEN previous <> 0 THEN CAST((current - previous) * CAST(100.0 AS DOUBLE) / abs(previous) AS FLOAT) WHEN current <> 0 THEN 100 ELSE 0 END AS FLOAT)"


@query(_SUMS.format(keys="auto_category", more="") + f""", p AS (
  SELECT auto_category, CAST(coalesce(sum(total) FILTER (month = now), 0) AS BIGINT) AS current, CAST(coalesce(sum(total) FILTER (month = before), 0) AS BIGINT) AS previous
  FROM m, two WHERE month IN (now, before) AND before IS NOT NULL GROUP BY 1)
SELECT auto_category, current, previous, current - previous AS change, CAST(round({_PCT}, 2) AS DECIMAL(18, 2)) AS percent,
  CASE WHEN abs({_PCT}) < 5 THEN 'STABLE' WHEN current < previous THEN 'UP' ELSE 'DOWN' END AS trend FROM p WHERE current <> 0 OR previous <> 0""")
def category_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two latest months that any category has; with one month only, nothing."""
    sums = spent(spark, sf_dir, "booking_date").groupBy(month(), "auto_category").agg(F.sum("amount_cents").alias("total"))
    months = latest_months(sums)
    if len(months) < 2:
        return sums.limit(0).selectExpr("auto_category", "total AS current", "total AS previous", "total AS change", "CAST(0 AS DECIMAL(18, 2)) AS percent", "'' AS trend")
    now, before = F.col("current"), F.col("previous")
    percent = F.round(percent_change(now, before).cast("double"), 2).cast("decimal(18,2)")
    both = compare(sums, ["auto_category"], *months).where("current <> 0 OR previous <> 0")
    return both.select("auto_category", "current", "previous", (now - before).alias("change"), percent.alias("percent"), direction(now, before).alias("trend"))


@query(_SUMS.format(keys="counterparty_name", more="AND counterparty_name IS NOT NULL") + f""", p AS (
  SELECT counterparty_name, CAST(coalesce(sum(total) FILTER (month = now), 0) AS BIGINT) AS current, CAST(coalesce(sum(total) FILTER (month = before), 0) AS BIGINT) AS previous
  FROM m, two WHERE month IN (now, before) OR month = now GROUP BY 1)
SELECT counterparty_name, current, previous,
  CASE WHEN previous = 0 THEN 'NEW' WHEN abs({_PCT}) < 5 THEN 'STABLE' WHEN current < previous THEN 'UP' ELSE 'DOWN' END AS trend
FROM p WHERE current <> 0 ORDER BY current, counterparty_name LIMIT 10""")
def merchant_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten merchants with most spending in the latest month; NEW without any in the month before."""
    rows = spent(spark, sf_dir, "booking_date", "counterparty_name").where("counterparty_name IS NOT NULL")
    sums = rows.groupBy(month(), "counterparty_name").agg(F.sum("amount_cents").alias("total"))
    months = [*latest_months(sums), "", ""][:2]
    now, before = F.col("current"), F.col("previous")
    trend = F.when(before == 0, "NEW").otherwise(direction(now, before))
    both = compare(sums, ["counterparty_name"], *months).where("current <> 0")
    return both.select("counterparty_name", "current", "previous", trend.alias("trend")).orderBy("current", "counterparty_name").limit(10)


@query(_SUMS.format(keys="counterparty_name", more="AND counterparty_name IS NOT NULL") + """, h AS (
  SELECT counterparty_name, CAST(sum(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS transactions, CAST(round(sum(total) * 1.0 / count(*)) AS BIGINT) AS average,
    array_to_string(list(month || ':' || total ORDER BY month DESC), ',') AS months FROM m GROUP BY 1)
SELECT * FROM h ORDER BY total, counterparty_name LIMIT 10""")
def merchant_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten merchants with most spending, each with its months, newest first."""
    rows = spent(spark, sf_dir, "booking_date", "counterparty_name").where("counterparty_name IS NOT NULL")
    sums = rows.groupBy(month(), "counterparty_name").agg(F.sum("amount_cents").alias("total"), F.count("*").alias("n"))
    months = F.sort_array(F.collect_list(F.struct("month", "total")), asc=False)  # one entry a month
    shown = F.concat_ws(",", F.transform(months, lambda x: F.concat_ws(":", x["month"], x["total"].cast("string"))))
    average = F.round(F.sum("total") * 1.0 / F.count("*")).cast("long")
    whole = sums.groupBy("counterparty_name").agg(F.sum("total").alias("total"), F.sum("n").alias("transactions"), average.alias("average"), shown.alias("months"))
    return whole.orderBy("total", "counterparty_name").limit(10)


@query(_SUMS.format(keys="counterparty_name", more="AND counterparty_name IS NOT NULL") + """
SELECT counterparty_name, CAST(sum(total) AS BIGINT) AS total FROM m GROUP BY 1 ORDER BY total DESC, counterparty_name LIMIT 10""")
def ranked_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By falling totals of negative amounts: the smallest spending first."""
    rows = spent(spark, sf_dir, "counterparty_name").where("counterparty_name IS NOT NULL")
    return rows.groupBy("counterparty_name").agg(F.sum("amount_cents").alias("total")).orderBy(F.desc("total"), "counterparty_name").limit(10)


@query(_SUMS.format(keys="auto_category", more="") + f""", p AS (
  SELECT auto_category, CAST(coalesce(sum(total) FILTER (month = now), 0) AS BIGINT) AS current, CAST(coalesce(sum(total) FILTER (month = before), 0) AS BIGINT) AS previous
  FROM m, two WHERE month IN (now, before) AND before IS NOT NULL GROUP BY 1),
q AS (SELECT *, {_PCT} AS pct FROM p WHERE current <> 0 OR previous <> 0)
SELECT auto_category, CASE WHEN abs(pct) < 5 THEN '→' WHEN current < previous THEN '↑' ELSE '↓' END AS sign,
  CASE WHEN abs(pct) < 1 THEN '<1%' WHEN abs(pct) > 999 THEN '>999%' ELSE CAST(CAST(floor(abs(pct)) AS BIGINT) AS VARCHAR) || '%' END AS label FROM q""")
def trend_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = category_trends(spark, sf_dir)
    percent = percent_change(F.col("current"), F.col("previous"))
    return trends.select("auto_category", indicator(F.col("trend")).alias("sign"), percent_label(percent).alias("label"))
