"""Transactions as they arrive: running sums, and rows that repeat.  An extension; the batch queries give the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans import views
from tallyforge.plans.catalog import query
from tallyforge.plans.folders import shared_folder

LATE = "1 hour"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions: purchases are spending, signups income."""
    rows = spark.readStream.schema(views.read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cents = F.expr("CASE event_type WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END * CAST(round(value * 100) AS BIGINT)")
    return rows.select(F.col("event_id").alias("id"), F.to_timestamp("ts").alias("booking_ts"), F.col("user_id").alias("account_id"), cents.alias("amount_cents"), F.col("event_type").alias("counterparty_name"))


def windowed(rows: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    """Sums by window and counterparty; a window is done, and its state gone, ``late`` after its end."""
    sums = rows.withWatermark("booking_ts", late).groupBy(F.window("booking_ts", size), "counterparty_name").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total"))
    return sums.select(F.col("window.start").cast("date").alias("day"), "counterparty_name", "n", "total")


def without_repeats(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Rows that did not come before with the same id, as far back as ``late``."""
    return rows.withWatermark("booking_ts", late).dropDuplicatesWithinWatermark(["id"])


def run_once(rows: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there and return the result, which each micro-batch has written to the checkpoint folder's neighbour."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "stream")
    schema = rows.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


_EVENTS = ", e AS (SELECT ts, event_type AS counterparty_name, CASE event_type WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END * CAST(round(value * 100) AS BIGINT) AS amount_cents FROM events)"


@query(_EVENTS + " SELECT CAST(ts AS DATE) AS day, counterparty_name, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total FROM e GROUP BY 1, 2")
def stream_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(windowed(events(spark, sf_dir)))
