"""Which line of a document a transaction comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import NOISE
from tallyforge.functions.values import german_number

MOST_NEEDLES = 8


def needles(text: Column) -> Column:
    """Up to eight different words of three letters or more that are no noise."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    stop = F.array(*map(F.lit, NOISE))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, MOST_NEEDLES)


def amount_texts(cents: Column) -> Column:
    """An amount as lines may show it: with comma or dot, with and without separators of thousands."""
    german = german_number(F.abs(cents))
    english = F.translate(german, ",.", ".,")
    return F.array_distinct(F.array(german, F.replace(german, F.lit(".")), english, F.replace(english, F.lit(","))))


def match_lines(transactions: DataFrame, lines: DataFrame) -> DataFrame:
    """``id`` with the page and line where the transaction stands: amount and a word, else the amount alone; the first such line.

    ``transactions``: ``file``, ``id``, ``amount_cents``, ``description``; ``lines``: ``file``, ``page``, ``line_no``, ``text``.  Lines are found by the amounts
    that they show, so a transaction meets the lines with its amount only.
    """
    amounts = lines.select("*", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d[\d.,]*[.,]\d{2})(?!\d)"), F.lit(1)))).alias("shown"))
    wanted = transactions.select("file", "id", needles(F.col("description")).alias("needles"), F.explode(amount_texts(F.col("amount_cents"))).alias("shown"))
    low = F.lower("text")
    both = wanted.join(amounts, ["file", "shown"]).withColumn("weak", ~F.exists("needles", lambda w: low.contains(w)))
    best = both.groupBy("file", "id").agg(F.min(F.struct("weak", "page", "line_no")).alias("best"))
    return best.select("file", "id", "best.page", "best.line_no", (~F.col("best.weak")).alias("sure"))
