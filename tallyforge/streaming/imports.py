"""Statements as they arrive: each micro-batch is compared with what is stored and written under its own number.

A batch that runs again, after a restart or a lost driver, replaces what it wrote the first time and is compared with smaller
numbers only, so that its rows get the flags that they had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import store
from tallyforge.plans import views
from tallyforge.plans.catalog import query
from tallyforge.plans.folders import shared_folder


def stored(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows below ``path``, with ``batch``; with ``before`` those of smaller batches.  Nothing is there before the first batch."""
    known = T.StructType([*schema.fields, T.StructField("is_duplicate", T.BooleanType()), T.StructField("batch", T.LongType())])
    if before == 0:
        return spark.createDataFrame([], known)
    rows = spark.read.schema(known).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def merge_batch(path: str, rows: DataFrame, number: int, order: Sequence[str]) -> None:
    """Write ``rows`` with ``is_duplicate`` as batch ``number``: an equal row is stored by an earlier batch, or stands before it in this one."""
    spark = rows.sparkSession
    flagged = store.flag_duplicates(stored(spark, path, rows.schema, number), rows, order)
    flagged.select(*rows.columns, "is_duplicate").write.mode("overwrite").parquet(f"{path}/batch={number}")


def import_stream(rows: DataFrame, path: str, state: str, order: Sequence[str] = ("id",)) -> None:
    """Run what has arrived of a stream of transactions through ``merge_batch`` into ``path``; ``state`` remembers what has been read."""
    rows.writeStream.foreachBatch(lambda batch, number: merge_batch(path, batch, number, order)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query("""SELECT id, batch, row_number() OVER (PARTITION BY account_id, booking_date, amount_cents, description ORDER BY batch, id) > 1 AS is_duplicate FROM (
  SELECT id, account_id, booking_date, -abs(amount_cents) // 5000000 AS amount_cents, 'row' AS description, CAST(statement_id % 2 AS BIGINT) AS batch FROM tx)""")
def incremental_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions in two drops, of which the second is imported twice."""
    rows = views.transactions(spark, sf_dir, "id", "account_id", "statement_id", "booking_date", "amount_cents", live=False)
    rows = rows.select("id", "account_id", "booking_date", F.floor(-F.abs("amount_cents") / 5000000).alias("amount_cents"), F.lit("row").alias("description"), F.pmod("statement_id", F.lit(2)).alias("drop"))
    folder = shared_folder(spark, "imports")
    for drop in (0, 1):  # the second comes when the first has been imported
        rows.where(F.col("drop") == drop).drop("drop").write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.drop("drop").schema).parquet(f"{folder}/in")
        import_stream(arriving, f"{folder}/out", f"{folder}/state")
    merge_batch(f"{folder}/out", rows.where("drop = 1").drop("drop"), 1, ["id"])  # as after a restart
    return stored(spark, f"{folder}/out", rows.drop("drop").schema).select("id", "batch", "is_duplicate")
