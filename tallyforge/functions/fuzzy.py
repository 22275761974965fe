"""Similarities of short strings, and the best match of each within a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.82
LEAST_LENGTH = 4


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of the string with two spaces before and one after; none of an empty one."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.when(F.length(c) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    shared, whole = F.size(F.array_intersect(trigrams(a), trigrams(b))), F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(whole == 0, 0.0).otherwise(shared / whole)


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(levenshtein_similarity(a, b), trigram_similarity(a, b))


def near_pairs(words: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``w``, ``c``, ``p`` and ``score`` of all words (``w``) and candidates (``c``, ``p``) of one first letter whose similarity is ``threshold`` or more.

    Strings that are so similar share a trigram besides the first: an edit touches three of them, and from 2/3 on there
    are more than edits can touch.  So pairs meet by trigram, not by first letter alone, and their lengths rule out others.
    """
    if not 2 / 3 < threshold <= 1:
        raise ValueError("only thresholds above 2/3 are sure to share a trigram")
    by = lambda c: F.explode(F.slice(trigrams(F.col(c)), 2, 1 << 20)).alias("gram")
    met = words.where(F.length("w") >= LEAST_LENGTH).select("w", F.substring("w", 1, 1).alias("first"), by("w")).join(known.where(F.length("c") >= LEAST_LENGTH).select("c", "p", F.substring("c", 1, 1).alias("first"), by("c")), ["first", "gram"])
    fits = F.least(F.length("w"), F.length("c")) >= F.greatest(F.length("w"), F.length("c")) * 0.5
    return met.where(fits).select("w", "c", "p").distinct().withColumn("score", similarity(F.col("w"), F.col("c"))).where(F.col("score") >= threshold)


def best_match(left: DataFrame, word: str, candidates: DataFrame, candidate: str, position: str, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``left`` whose ``word`` has a candidate of the same first letter and a similarity of ``threshold`` or more, with the best one.

    Of equal scores the candidate of the smaller ``position`` wins.  Distinct words are compared once.
    """
    scored = near_pairs(left.select(F.col(word).alias("w")).distinct(), candidates.select(F.col(candidate).alias("c"), F.col(position).alias("p")), threshold)
    best = scored.groupBy("w").agg(F.max(F.struct("score", (-F.col("p")).alias("p"), "c")).alias("best"))
    return left.join(best.select(F.col("w").alias(word), F.col("best.c").alias("match"), F.col("best.score").alias("score")), word)
