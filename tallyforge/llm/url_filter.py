"""URL filters: host and path rules first, then a ratio of two character models.

Two smoothed variable-order Markov models are counted, of URLs that the rules allow and of
those that they block.  A model predicts each character from the longest context it has
kept: p(c | h) = (n(hc) + m p(c | h')) / (n(h) + m), where h' is h without its first
character.  All runs of characters are kept, so the models grow with the URLs.  A URL's score is the mean over its
characters of log p_allowed - log p_blocked, turned into a probability by the means and the
spread that held-out rule-labelled URLs show.

All of it is DataFrame expressions.  A position's value depends on its longest run alone, so
the models are asked once for each different run.  Tables are broadcast only up to
``BROADCAST_ROWS``, counted, and joined by shuffle beyond: Spark's own estimate is that of
compressed files, which a row for each character outgrows many times.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
SMOOTHING = 4.0
CHARACTERS = 256  # of the uniform distribution that the shortest context falls back on
#: Largest tables of runs (a row is below 200 bytes) that are broadcast, of which the driver holds dozens; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``by_rule``, its verdict."""
    urls = urls.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    rule = by_rule = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, by_rule = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(by_rule)
    return urls.withColumns({"rule": rule, "by_rule": by_rule})


def _positions(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of ``url`` and its end: the runs ``g0`` to ``g<order>`` that end there, null where it has no such many before."""
    chars = F.split(F.concat(F.lit("\x02"), "url", F.lit("\x03")), "")  # by code points; a place of an array is found at once, one of a string is counted out
    marked = urls.withColumn("marked", chars).drop("url")

    def runs(c: Column, i: Column) -> Column:
        upto = [F.get(F.col("marked"), i - k) for k in range(order, 0, -1)]
        return F.struct(*(F.when(i >= k, F.concat(*upto[order - k :], c)).alias(f"g{k}") for k in range(order + 1)))

    each = marked.withColumn("at", F.explode(F.slice(F.transform("marked", runs), F.lit(2), F.size("marked"))))
    return each.select(*(c for c in urls.columns if c != "url"), "at.*")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _sizes(grams: DataFrame) -> dict[int, int]:
    """How many runs of each length there are."""
    return {r["n"]: r["count"] for r in grams.groupBy(F.length("gram").alias("n")).count().collect()}  # a row for each length


def train(urls: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> tuple[DataFrame, DataFrame, float] | None:
    """The models of ``urls`` (``url`` and boolean ``accepted``), as differences of logarithms.

    Returns the runs with ``ratio`` (of a character after its context), the contexts with ``fall``
    (of the factors by which an unseen character falls back), and the ratio of a character that no
    run has.  None if either kind of URL is missing.  All runs are kept.
    """
    runs = _positions(urls, order).select("accepted", F.explode(F.array(*(f"g{k}" for k in range(order + 1)))).alias("gram")).where("gram is not null")
    count = lambda kind: F.count_if(F.col("accepted") == kind).cast("double")
    grams = cut(runs.groupBy("gram").agg(count(True).alias("a"), count(False).alias("b")), "runs")
    sizes = _sizes(grams)
    total = grams.where(F.length("gram") == 1).agg(F.sum("a"), F.sum("b")).first()
    if not total[0] or not total[1]:
        return None
    contexts = grams.where(F.length("gram") > 1).groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"))
    known = None
    for k in range(order + 1):
        level = grams.where(F.length("gram") == k + 1)
        if k == 0:
            p = [(F.col(c) + smoothing / CHARACTERS) / (n + smoothing) for c, n in zip("ab", total, strict=True)]
            below = level.select("gram", p[0].alias("pa"), p[1].alias("pb"))
            known = below
            continue
        shorter = _small(below.select(F.col("gram").alias("suffix"), F.col("pa").alias("sa"), F.col("pb").alias("sb")), sizes.get(k, 0))
        before = _small(contexts.where(F.length("context") == k), sizes.get(k + 1, 0))
        level = level.withColumns({"suffix": F.expr("substring(gram, 2)"), "context": F.expr("left(gram, length(gram) - 1)")}).join(shorter, "suffix").join(before, "context")
        p = [(F.col(x) + smoothing * F.col(f"s{x}")) / (F.col(f"in_{x}") + smoothing) for x in "ab"]
        below = cut(level.select("gram", p[0].alias("pa"), p[1].alias("pb")), "level")
        known = known.unionByName(below)
    ratios = cut(known.select("gram", (F.log("pa") - F.log("pb")).alias("ratio")), "ratios")
    falls = cut(contexts.select("context", (F.log(F.col("in_b") + smoothing) - F.log(F.col("in_a") + smoothing)).alias("fall")), "falls")
    return ratios, falls, math.log(total[1] + smoothing) - math.log(total[0] + smoothing)


def score(urls: DataFrame, model: tuple[DataFrame, DataFrame, float], order: int = ORDER) -> DataFrame:
    """``urls`` (``url`` and other columns) without ``url``, with the ``score`` of each row."""
    ratios, falls, unseen = model
    rows = cut(urls.withColumn("row", F.monotonically_increasing_id()), "rows")
    each = _positions(rows.select("row", "url"), order).select("row", F.coalesce(*(f"g{k}" for k in reversed(range(order + 1)))).alias("run"))
    sizes = _sizes(ratios)
    runs = each.select("run").distinct()
    value = F.lit(unseen)
    for k in range(order + 1):
        runs = runs.withColumn(f"g{k}", F.when(F.length("run") > k, F.expr(f"right(run, {k + 1})")))
        if k:
            context = _small(falls.where(F.length("context") == k).select(F.col("context").alias(f"c{k}"), F.col("fall").alias(f"fall{k}")), sizes.get(k + 1, 0))
            runs = runs.withColumn(f"c{k}", F.expr(f"left(g{k}, {k})")).join(context, f"c{k}", "left")
            value = value + F.coalesce(f"fall{k}", F.lit(0.0))
        level = _small(ratios.where(F.length("gram") == k + 1).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"ratio{k}")), sizes.get(k + 1, 0))
        runs = runs.join(level, f"g{k}", "left")
        value = F.coalesce(f"ratio{k}", value)
    values = cut(runs.select("run", value.alias("value")), "values")
    means = each.join(_small(values, values.count()), "run").groupBy("row").agg(F.avg("value").alias("score"))  # a character carries a number, not its URL's columns
    return rows.drop("url").join(means.hint("merge"), "row").drop("row")


def fold(id_col: str) -> Column:
    """Whether a labelled URL trains the models (else it calibrates them): half of the ids, by an MD5."""
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 1) < "8"


def calibrate(scored: DataFrame) -> tuple[float, float] | None:
    """Slope and offset of the log odds, from the two classes' mean scores and their common variance."""
    stats = scored.groupBy("accepted").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_pop("score").alias("var")).collect()
    by = {r["accepted"]: r for r in stats}
    if len(by) < 2:
        return None
    a, b = by[True], by[False]
    spread = max((a["n"] * a["var"] + b["n"] * b["var"]) / (a["n"] + b["n"]), 1e-9)
    slope = (a["mean"] - b["mean"]) / spread
    return slope, -slope * (a["mean"] + b["mean"]) / 2


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``p_allow`` for each row of ``pages``.

    A rule's verdict stands; the models judge the rest, and allow a URL from an even chance on.
    Rows with a rule have no score.  A null or empty URL, or one without "://", has an empty host
    and path, so no rule; its characters are judged as any other's, and no characters but the end
    are the end alone.  Without URLs of both verdicts to learn from, the rest is allowed and
    has no score.  Repeated rows are judged alike.  Other columns are not returned.
    """
    urls = cut(judged(pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")), rules), "urls")
    named = [F.col("id").alias(id_col), "host", "path", "rule"]
    ruled = urls.where("by_rule is not null")
    learn = ruled.select("id", "url", (F.col("by_rule") == "allow").alias("accepted"))
    model = train(learn.where(fold("id")))
    odds = calibrate(score(learn.where(~fold("id")), model)) if model else None
    rest = urls.where("by_rule is null").drop("by_rule")
    if odds is None:
        scored = rest.select(*named, F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("p_allow"))
    else:
        p = 1 / (1 + F.exp(-(F.col("score") * odds[0] + odds[1])))
        scored = score(rest, model).withColumn("p_allow", p).select(*named, F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block").alias("verdict"), "score", "p_allow")
    return ruled.select(*named, F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("p_allow")).unionByName(scored)
