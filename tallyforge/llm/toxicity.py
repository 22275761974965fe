"""Toxicity grades by cumulative-link (proportional-odds) regression on sparse text features.

A text's features are its words and their first four to six bytes, so that invented
endings of a known stem count too.  P(grade <= k) = logistic(t_k - w.x): one weight
vector w is shared by all ordered thresholds t_1 < t_2 < ..., and the expected
severity is the sum of P(grade > k).

The model is fitted on a bounded sample of labelled rows (``SAMPLE``); which features
it has is counted in Spark over that sample.  Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import LOWER_ALNUM, cut, give_back, segments, words

#: Labelled rows in the sample, about (each row is in it with the same chance, by a hash of its id).
SAMPLE = 20_000
#: The grade that a row of labels gives, as SQL: 0 is not toxic, 1 toxic, 2 toxic in a text that is also bad otherwise.
GRADE = "CASE WHEN toxic = 0 THEN 0 WHEN toxic > 0 AND quality = 0 THEN 2 WHEN toxic > 0 THEN 1 END"
#: Least likelihood-ratio statistic of a feature with the label (3.8 standard errors).
_TELLING = 3.8**2
PREFIXES = (4, 5, 6)
_U = np.uint64


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature keys of all words, and their documents: a hash of the word, and the bytes of each prefix as they are."""
    found = words(texts, LOWER_ALNUM, lower=True)
    doc = np.repeat(np.arange(len(texts)), found.counts())
    size = found.end - found.start
    keys, of = [found.hash >> _U(8)], [doc]
    packed = np.zeros(len(doc), np.uint64)
    last = max(len(found.data) - 1, 0)
    for i in range(max(PREFIXES)):
        if len(doc):
            packed |= found.data[np.minimum(found.start + i, last)].astype(np.uint64) << _U(8 * i)
        if i + 1 in PREFIXES:
            long = size > i + 1
            keys.append(packed[long] | _U((i + 1) << 56))
            of.append(doc[long])
    return np.concatenate(keys), np.concatenate(of)


@dataclass
class Model:
    """Sorted feature keys with weights, and the thresholds between grades."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(1, 30.0))
    least: float = 0.5

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, feature and number of occurrences, of the model's features only."""
        keys, doc = features(texts)
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        pair, n = np.unique(doc[hit] * len(self.keys) + at[hit], return_counts=True)
        return pair // len(self.keys), pair % len(self.keys), n

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        doc, at, n = self.counts(texts)
        x = np.bincount(doc, self.weights[at] * np.log1p(n), len(texts))
        return _logistic(x[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(doc: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, penalty: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam over all rows.

    The thresholds are the first one and the logarithms of the steps to the next, so they stay in order.
    """
    levels = int(grade.max())
    share = np.clip([(grade > k).mean() for k in range(levels)], 1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(size), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(len(grade))
    for step in range(1, steps + 1):
        w, gaps = p[:size], np.exp(p[size + 1 :])
        t = p[size] + np.append(0, np.cumsum(gaps))
        x = np.bincount(doc, w[at] * value, len(grade))
        edge = np.concatenate([np.zeros((len(grade), 1)), _logistic(t[None, :] - x[:, None]), np.ones((len(grade), 1))], 1)
        lo, hi = edge[rows, grade], edge[rows, grade + 1]
        slope = edge * (1 - edge)
        likely = np.maximum(hi - lo, 1e-12)
        up, down = slope[rows, grade + 1] / likely, slope[rows, grade] / likely
        by_x = (up - down) / len(grade)  # of the mean negative log likelihood
        by_t = np.array([(down[grade == k + 1].sum() - up[grade == k].sum()) for k in range(levels)]) / len(grade)
        g = np.concatenate([np.bincount(at, by_x[doc] * value, size) + penalty * w, [by_t.sum()], gaps * by_t[::-1].cumsum()[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:size], p[size] + np.append(0, np.cumsum(np.exp(p[size + 1 :])))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in segments(batch.column(0)):
            keys, doc = features(batch.column(0)[i:j])
            toxic = batch.column(1)[i:j].to_numpy(zero_copy_only=False)
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, doc = keys[new], doc[new]
            distinct, first = np.unique(keys, return_index=True)
            n = np.diff(np.append(first, len(keys)))
            bad = np.add.reduceat(toxic[doc], first) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(bad.astype(np.int64))], ["key", "n", "bad"])
    give_back()


def _sparse(keys: np.ndarray):
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(keys)
        for batch in batches:
            for i, j in segments(batch.column(0)):
                doc, at, n = model.counts(batch.column(0)[i:j])
                edges = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], *lists], ["grade", "at", "n"])
        give_back()

    return sparse


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grade: str = GRADE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``docs`` and the grades (0, 1, ...) that ``labels`` give to about ``sample`` of them.

    The grades come from the labels alone.  Of several labels of a document the largest grade holds; labels without an
    id or a grade are left out, and grades that none has leave no gap.  Every feature that tells enough of toxicity in
    the sample is in the model.  Without labelled rows of both kinds the model calls nothing toxic.
    """
    given = labels.select(F.col(id_col).alias("id"), F.expr(grade).cast("long").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").alias("grade"))
    n = given.count()
    if n > sample:
        given = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # about `sample` rows of two numbers: a bound of 16 bytes a row
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(given), "id").select("text", (F.col("grade") > 0).cast("long").alias("toxic"), "grade")
    rows = cut(rows, "labelled")
    count, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < count:
        return Model()
    good = count - bad
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    n, b = F.col("n"), F.col("bad")
    ratio = part(b, n * bad / count) + part(n - b, n * good / count) + part(bad - b, (count - n) * bad / count) + part(good - n + b, (count - n) * good / count)
    seen = rows.mapInArrow(_tally, "key long, n long, bad long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n >= 4")
    seen = seen.withColumn("g", 2 * ratio).where(F.col("g") >= _TELLING)
    keys = np.sort(seen.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))  # of the words of the sample
    if not len(keys):
        return Model()
    table = rows.select("text", "grade").mapInArrow(_sparse(keys), "grade long, at array<int>, n array<int>").toArrow()
    grade = np.unique(table["grade"].to_numpy(), return_inverse=True)[1]
    flat = [table[c].combine_chunks() for c in ("at", "n")]
    doc = np.repeat(np.arange(len(grade)), np.diff(flat[0].offsets.to_numpy()))
    at, times = (x.flatten().to_numpy().astype(np.int64) for x in flat)
    weights, thresholds = fit_ordinal(doc, at, np.log1p(times), grade, len(keys))
    model = Model(keys, weights, thresholds)
    model.least = best_cut(_logistic(np.bincount(doc, weights[at] * np.log1p(times), len(grade)) - thresholds[0]), grade > 0)
    return model


def best_cut(p: np.ndarray, truth: np.ndarray) -> float:
    """The threshold of the best F1, between 0.1 and 0.9; of equal ones the middle."""
    grid = np.linspace(0.1, 0.9, 81)
    caught = np.array([(truth & (p >= x)).sum() for x in grid])
    called = np.array([(p >= x).sum() for x in grid])
    f1 = 2 * caught / (called + truth.sum())
    return float(np.median(grid[f1 == f1.max()]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic``, ``grade`` and ``toxic``.

    A document is toxic if P(grade > 0) is the model's ``least`` or more, the best cut on its sample.  Its grade is then the
    median, 1 at least; that of others is 0.  Each row is judged on its own
    whole text; a null or empty text has no features.  Columns of these four names are replaced.
    """
    made = T.StructType.fromDDL("severity double, p_toxic double, grade int, toxic boolean")
    docs = docs.drop(*made.names)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col))
            for i, j in segments(texts):
                above = model.above(texts[i:j])
                toxic = above[:, 0] >= model.least
                grade = np.where(toxic, np.maximum((above >= 0.5).sum(1), 1), 0)
                new = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(toxic)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], [*names, *made.names])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made.fields]))


def grade_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``score`` of all ``docs`` by a model fitted to ``labels``."""
    return score(docs, fit(docs, labels, **options))
