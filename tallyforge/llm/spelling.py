"""Group spelling variants: words one edit apart, by an even-partition pigeonhole join.

One edit leaves one half of a word as it is.  So each word of length l is indexed by two segments, its first l // 2 code points and
the rest, and each word of length l or l + 1 probes for them with its own beginning and, shifted by what it is longer, its own end.
A pair that meets at a segment is a candidate; one that meets at both counts once, and an edit distance
bounded by one verifies it within the join, so that only links leave it.

A segment that more than ``HOT`` words share is partitioned once more: what remains of the words holds the edit, so one half of that
is as it was too, and the key grows by it.  Keys that still have a large share of the rows are dealt to several tasks.
All of it is DataFrame expressions.  Tables that grow with the words are joined by shuffle, as Spark takes exploded ones to be as small
as the compressed file of words, and would send them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, spread_join

#: Runs of these are words: ASCII letters and U+00C0 to U+00FF.
LETTERS = r"[A-Za-z\x{C0}-\x{FF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a segment beyond which it is partitioned once more.
HOT = 100


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` (as text) and ``run``: the lower-cased (A-Z) runs of letters of each document, as often as they occur."""
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))).alias("raw"))
    return each.select("id", F.translate("raw", _UPPER, _LOWER).alias("run"))


def misspelt(run: Column, doc_id: Column, every: int = 97) -> Column:
    """``run`` less one code point where ``every`` divides the CRC-32 of ``<doc_id>:<run>``: errors that a seed fixes."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, every: int | None = 97) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``least_chars`` code points and ``least_n`` occurrences; ``every``: see ``misspelt``.

    Words are counted in each task before they are shuffled.  A null or empty text has no words; a null id is written
    as null.  Rows of one id count each.
    """
    found = runs(docs, id_col, text_col)
    word = misspelt(F.col("run"), F.col("id"), every) if every else F.col("run")
    counted = found.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_n)


def _part(text: Column, part: str, of: Column) -> Column:
    """The first ``of // 2`` code points of ``text``, or as many of its last as are left of ``of``."""
    half = F.floor(of / 2).cast("int")
    size = of - half
    return F.substring(text, F.lit(1), half) if part == "first" else F.substring(text, F.length(text) - size + 1, size)


def _rest(text: Column, part: str, of: Column) -> Column:
    """What ``_part`` leaves of ``text``."""
    half = F.floor(of / 2).cast("int")
    return F.substring(text, half + 1, F.length(text)) if part == "first" else F.substring(text, F.lit(1), F.length(text) - (of - half))


def _segments(words: DataFrame, shorter: list[int]) -> DataFrame:
    """``words`` with ``of``, ``part``, ``segment`` and ``rest``: the two segments of each word, as a word shorter by each of ``shorter`` has them."""
    text, keys = F.col("word"), []
    for d in shorter:
        of = F.length(text) - d
        keys += [F.struct(of.alias("of"), F.lit(p).alias("part"), _part(text, p, of).alias("segment"), _rest(text, p, of).alias("rest")) for p in ("first", "last")]
    return words.withColumn("key", F.explode(F.array(*keys))).select("word", "key.*")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``a`` and ``b`` of all pairs of ``words`` (``word``, each once) that one inserted, deleted or replaced code point tells apart, each pair once.

    Of two words of one length ``a`` is the smaller one, else the shorter.  Words of less than two code points have an empty
    segment, which is a segment like others.
    """
    words = words.select("word")
    index, probe = _segments(words, [0]), _segments(words, [0, 1])
    key = ["of", "part", "segment"]
    many = cut(index.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key), "segments")
    one = (F.levenshtein(F.col("a"), F.col("b"), 1) == 1) & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    few = index.join(many, key, "left_anti").withColumnRenamed("word", "a").drop("rest")
    found = few.join(probe.withColumnRenamed("word", "b").drop("rest").hint("merge"), key).where(one).select("a", "b")
    fine = []  # hashes of the longer keys deal the rows; the keys themselves are compared
    for side, alias in ((index, "a"), (probe, "b")):
        again = side.join(many, key, "left_semi").withColumnRenamed("word", alias)
        of = F.length("rest") - (F.length(alias) - F.col("of"))
        parts = F.array(*(F.struct(F.lit(p).alias("half"), _part(F.col("rest"), p, of).alias("piece")) for p in ("first", "last")))
        again = again.withColumn("key", F.explode(parts)).select(alias, *key, "key.*")
        fine.append(again.select(alias, F.xxhash64(*key, "half", "piece").alias("key"), F.struct(*key, "half", "piece").alias(f"at_{alias}")))
    met = spread_join(fine[0], fine[1], "key", "a").where((F.col("at_a") == F.col("at_b")) & one).select("a", "b")
    return found.unionByName(met).distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """``words`` (``word``, ``n``) with ``n_near``, ``form`` and ``form_n``: the near word of largest n, the smallest of equals, if that is ``times`` a word's own n."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    known = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("by"), "near")).alias("best"))
    better = -F.col("best.by") >= times * F.col("n")
    return words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.by")).alias("form_n")
    )


def roots(words: DataFrame) -> DataFrame:
    """``word`` and ``root`` of each word with a ``form``: the last of its forms.

    Each form is at least twice as frequent, so a chain has fewer than 64 links, and every round doubles what a
    word has followed: six rounds reach the end of any.
    """
    step = cut(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = cut(step.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    return step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, every: int | None = 97, hot: int = HOT) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of the words of ``docs``: see ``vocabulary``, ``near_pairs``, ``forms`` and ``roots``.

    An empty table has no words.  Other columns of ``docs`` are not read.  Words of equal n are no forms of each other.
    """
    words = cut(vocabulary(docs, id_col, text_col, least_chars, least_n, every), "words")
    known = cut(forms(words, cut(near_pairs(words, hot), "links")), "forms")
    return known.join(roots(known).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
