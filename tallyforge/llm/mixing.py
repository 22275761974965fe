"""Mix sources to target weights: raking of token weights, then calibrated sampling.

Iterative proportional fitting brings the token weights of the cells (source, language,
topic) to given marginals.  A document is then kept with the probability of its cell,
min(1, c * raked weight / present weight), where c is set so that the expected tokens
meet the budget although no document can be kept more than once.

All of it is DataFrame expressions.  Documents are read to count tokens by cell and to
look up their cell; the rounds work on the table of cells alone.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

DIMENSIONS = ("source", "lang", "topic")
#: Topics by what a text contains, the first that fits; other texts are "prose".
TOPICS = (("legal", ("license", "copyright")), ("web", ("http://", "https://", "www.")), ("contact", ("@",)), ("code", ("{", "};", "=")))
#: Largest tables of factors and of cells (a row is below 200 bytes) that are broadcast, or raked as one row of arrays; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Rounds go on until none moves a cell by more than ``SETTLED``; a job does up to ``BLOCK`` of them.
SETTLED, BLOCK = 1e-9, 1000


def topic(text: Column, topics: Sequence[tuple[str, Sequence[str]]] = TOPICS) -> Column:
    low = F.lower(text)
    out = F.lit("prose")
    for name, parts in reversed(topics):
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = F.when(hit, name).otherwise(out)
    return out


def describe(docs: DataFrame, text_col: str = "text", topics: Sequence[tuple[str, Sequence[str]]] = TOPICS) -> DataFrame:
    """``docs`` with ``topic`` and ``n_tokens``, the runs of characters other than ASCII white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"topic": topic(text, topics), "n_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets in proportion to the present tokens to ``power``: 1 keeps the shares, 0 makes them equal."""
    raised = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("target"))
    return raised


def _bound(value: Column, f) -> Column:
    """``f(value)``, where ``value`` is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _packed(state: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: the cells' ``weights`` in the order of their names, and for each dimension its values' goals and cells, and the value of each cell."""
    number = {"i": F.row_number().over(Window.orderBy(*names)) - 1} | {f"k_{d}": F.dense_rank().over(Window.orderBy(d)) - 1 for d in names}
    of = F.array(*(F.struct(F.col(f"k_{d}").alias("k"), F.col(f"goal_{d}").alias("goal")) for d in names))
    long = state.withColumns(number).select("i", "weight", F.posexplode(of).alias("d", "of"))
    groups = long.groupBy("d", F.col("of.k").alias("k")).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("cells"), F.max("of.goal").alias("goal"))
    sides = groups.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("k", "cells", "goal"))).alias("groups"))
    one = sides.agg(F.array_sort(F.collect_list(F.struct("d", "groups"))).alias("sides"))
    made = {"weights": F.transform(F.array_sort(F.flatten(F.transform(F.col("sides")[0]["groups"], lambda g: g["cells"]))), lambda c: c["weight"])}
    for j in range(len(names)):
        side = F.col("sides")[j]["groups"]
        pairs = F.transform(side, lambda g: F.transform(g["cells"], lambda c: F.struct(c["i"].alias("i"), g["k"].alias("k"))))  # noqa: B023  called at once
        made |= {f"goals_{j}": F.transform(side, lambda g: g["goal"]), f"cells_{j}": F.transform(side, lambda g: F.transform(g["cells"], lambda c: c["i"])), f"of_{j}": F.transform(F.array_sort(F.flatten(pairs)), lambda x: x["k"])}
    return one.select(*(v.alias(k) for k, v in made.items()))


def _rounds(weights: Column, dimensions: int, settled: float, most: int) -> Column:
    """``weights`` after up to ``most`` rounds, the largest move of the last one, and how many there were, as a struct."""
    kind = "struct<weights:array<double>,moved:double,rounds:bigint>"

    def scaled(w: Column, j: int) -> Column:
        sums = F.zip_with(F.col(f"goals_{j}"), F.col(f"cells_{j}"), lambda goal, own: goal / F.aggregate(own, F.lit(0.0), lambda a, i: a + F.get(w, i)))
        return _bound(sums, lambda factors: F.transform(w, lambda x, i: x * F.get(factors, F.get(F.col(f"of_{j}"), i))))

    def turn(state: Column, w: Column, j: int) -> Column:
        if j < dimensions:
            return _bound(scaled(w, j), lambda new: turn(state, new, j + 1))
        moved = F.array_max(F.zip_with(w, state["weights"], lambda a, b: F.abs(a / b - 1)))
        return F.struct(w.alias("weights"), moved.alias("moved"), (state["rounds"] + 1).alias("rounds")).cast(kind)

    first = F.struct(weights.alias("weights"), F.lit(1e308).alias("moved"), F.lit(0).alias("rounds")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda state, _: F.when(state["moved"] < settled, state).otherwise(turn(state, state["weights"], 0)))


def _settle_in_a_row(state: DataFrame, names: Sequence[str], settled: float, rounds: int | None) -> tuple[DataFrame, float | None, int]:
    """Many rounds a job, over cells that are one row of arrays."""
    row = cut(_packed(state, names), "cells")
    moved, done = None, 0
    while True:
        most = BLOCK if rounds is None else min(BLOCK, rounds - done)
        row = cut(row.withColumn("ran", _rounds(F.col("weights"), len(names), settled, most)).withColumn("weights", F.col("ran.weights")), "cells")
        before, (moved, more) = moved, row.select("ran.moved", "ran.rounds").first() or (None, 0)
        row, done = row.drop("ran"), done + (more or 0)
        if moved is None or moved < settled or done == rounds or (before is not None and moved > before * 0.99):
            break
    numbered = state.drop("weight").withColumn("i", F.row_number().over(Window.orderBy(*names)) - 1)
    return numbered.join(F.broadcast(row.select(F.posexplode("weights").alias("i", "weight"))), "i").drop("i"), moved, done


def _settle_by_shuffle(state: DataFrame, names: Sequence[str], settled: float, rounds: int | None) -> tuple[DataFrame, float | None, int]:
    """A job a round: each task sums its cells by value before the sums are shuffled."""
    least, done, last = None, 0, 0
    while True:
        state = state.withColumn("step", F.lit(1.0))
        for d in names:
            now = state.groupBy(d).agg((F.max(f"goal_{d}") / F.sum("weight")).alias("factor"))
            state = state.join(now, d).withColumns({"weight": F.col("weight") * F.col("factor"), "step": F.col("step") * F.col("factor")}).drop("factor")
        state, done = cut(state, "weights"), done + 1
        moved = state.agg(F.max(F.abs(F.col("step") - 1))).first()[0]
        state = state.drop("step")
        if moved is None or moved < settled or done == rounds or done - last >= BLOCK:
            break
        if least is None or moved < 0.99 * least:
            least, last = moved, done
    return state, moved, done


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int | None = None, settled: float = SETTLED) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``share``, their raked share of all tokens.

    Rounds go on until none moves a cell by more than ``settled``, or until ``BLOCK`` rounds no longer bring that nearer, as where targets
    contradict each other; ``rounds``, if it is given, ends them earlier.  Where they have not settled, a warning gives the largest
    error that a marginal is left with, as a share of its target.

    A value without a target gets the share 0, as does a cell without tokens; targets of values that no cell has
    are left out, and the rest is scaled to 1.  Where cells are missing, so that the
    targets can't all be met, the last rounds stay as near as the order of the dimensions gives.
    """
    names = list(targets)
    state = cells.where("tokens > 0")
    for d in names:
        goal = targets[d].select(F.col("value").alias(d), F.col("target").cast("double").alias("target")).where("target > 0")
        goal = cut(goal.join(state.select(d).distinct(), d, "left_semi"), "targets")
        n, whole = goal.agg(F.count("*"), F.sum("target")).first()
        state = state.join(_small(goal.select(d, (F.col("target") / (whole or 1.0)).alias(f"goal_{d}")), n), d)
    state = cut(state.withColumn("weight", F.col("tokens")), "weights")
    n = state.count()
    settle = _settle_in_a_row if n <= BROADCAST_ROWS else _settle_by_shuffle
    state, moved, done = settle(state, names, settled, rounds) if n else (state, None, 0)
    if moved is not None and moved >= settled:
        left = [state.groupBy(d).agg(F.abs(F.sum("weight") / F.max(f"goal_{d}") - 1).alias("error")).agg(F.max("error")).first()[0] or 0.0 for d in names]
        warnings.warn(f"raking has not settled in {done} rounds: a marginal is left with an error of {max(left, default=0.0):.2g} of its target", RuntimeWarning, stacklevel=2)
    total = state.agg(F.sum("weight")).first()[0] or 1.0
    out = cells.select(*names, "tokens").join(state.select(*names, "weight"), names, "left")
    return out.select(*names, "tokens", F.coalesce(F.col("weight") / total, F.lit(0.0)).alias("share"))


def calibrate(raked: DataFrame, keep: float) -> DataFrame:
    """``raked`` with ``probability``, such that the expected kept tokens are ``keep`` of all, if the targets allow so many.

    A cell without tokens has the probability 1: keeping its documents costs nothing.
    """
    total = raked.agg(F.sum("tokens")).first()[0] or 0.0
    ratio = F.col("share") * total / F.col("tokens")
    full, free, scale = 0.0, float(total), keep
    while total:
        capped = ratio * scale >= 1
        now = raked.where("tokens > 0").agg(
            F.coalesce(F.sum(F.when(capped, F.col("tokens"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("tokens") * ratio)), F.lit(0.0)).alias("free")
        ).first()
        if now["full"] <= full or now["free"] <= 0 or now["full"] >= keep * total:
            break
        full, free = now["full"], now["free"]
        scale = (keep * total - full) / free
    return raked.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio * scale)).otherwise(1.0))


def drawn(id_col: str, seed: str) -> Column:
    """A number of [0, 1) for each id, from the first 52 bits of an MD5."""
    bits = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(bits, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.7, keep: float = 0.8, seed: str = "mix:", dimensions: Sequence[str] = DIMENSIONS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (with the dimensions and ``n_tokens``, as ``describe`` gives) with ``weight``, ``probability`` and ``sampled``.

    ``targets`` names the weights of the values of a dimension; a dimension that it leaves out
    has tempered targets (``power``).  ``weight`` is the raked share of a cell's tokens over
    their present share.  Null values of a dimension count as the value "" and stay null.  Rows of one id
    are kept or left together; a null id is an id of its own.  Documents without tokens share
    their cell's probability.  Columns with the names of the three new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("weight", "probability", "sampled")
    cells = cut(docs.groupBy(*(F.coalesce(d, F.lit("")).alias(d) for d in dimensions)).agg(F.sum(F.coalesce("n_tokens", F.lit(0))).cast("double").alias("tokens")), "cells")
    given = {d: spark.createDataFrame([(v, float(x)) for v, x in t.items()], "value string, target double") for d, t in (targets or {}).items()}
    goals = {d: given[d] if d in given else tempered(cells, d, power) for d in dimensions}
    chances = cut(calibrate(cut(rake(cells, goals), "raked"), keep), "chances")
    total, rows = chances.agg(F.sum("tokens"), F.count("*")).first()
    weight = F.when(F.col("tokens") > 0, F.col("share") * (total or 0.0) / F.col("tokens")).otherwise(1.0)
    own = {d: f"cell_{uuid.uuid4().hex}" for d in dimensions}  # no column of docs has these names
    chances = _small(chances.select(*(F.col(d).alias(own[d]) for d in dimensions), weight.alias("weight"), "probability"), rows)
    of_cell = [F.coalesce(docs[d], F.lit("")) == F.col(own[d]) for d in dimensions]
    return docs.join(chances, of_cell).drop(*own.values()).withColumn("sampled", drawn(id_col, seed) < F.col("probability"))
