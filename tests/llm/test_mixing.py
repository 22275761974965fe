import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing


def fitted(tokens, goals, rounds=200):
    """Raked shares by plain numpy: tokens is an array with one axis for each of the goals."""
    w = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            other = tuple(i for i in range(w.ndim) if i != axis)
            now = w.sum(other)
            shape = [1] * w.ndim
            shape[axis] = len(goal)
            w = w * np.where(now > 0, goal / np.where(now > 0, now, 1), 0).reshape(shape)
    return w / w.sum()


def cells(spark, tokens):
    rows = [(str(i), str(j), float(x)) for (i, j), x in np.ndenumerate(tokens)]
    return spark.createDataFrame(rows, "source string, lang string, tokens double")


def target(spark, values):
    return spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "value string, target double")


@pytest.mark.parametrize("limit", [mixing.BROADCAST_ROWS, 0])
def test_raking_equals_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    tokens = np.random.default_rng(1).integers(1, 1000, (4, 3)).astype(float)
    tokens[1, 2] = 0
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25])]
    raked = mixing.rake(cells(spark, tokens), {"source": target(spark, goals[0] * 7), "lang": target(spark, goals[1])})
    got = {(int(r.source), int(r.lang)): r.share for r in raked.collect()}
    want = fitted(tokens, goals)
    assert got == pytest.approx({k: v for k, v in np.ndenumerate(want)}, abs=1e-6)


def test_targets_that_contradict_each_other_leave_the_last_dimension_met(spark):
    raked = mixing.rake(cells(spark, np.array([[1.0, 0.0], [0.0, 1.0]])), {"source": target(spark, [1, 3]), "lang": target(spark, [1, 1])})
    assert {(r.source, r.lang): r.share for r in raked.collect()} == pytest.approx({("0", "0"): 0.5, ("0", "1"): 0, ("1", "0"): 0, ("1", "1"): 0.5})


@pytest.mark.parametrize("limit", [mixing.BROADCAST_ROWS, 0])
def test_raking_goes_on_until_it_settles(spark, monkeypatch, limit):
    tokens = np.array([[1000.0, 1.0], [1.0, 10.0]])  # strongly tied, so slow
    goals = [np.array([0.3, 0.7]), np.array([0.5, 0.5])]
    by = {"source": target(spark, goals[0]), "lang": target(spark, goals[1])}
    got = {(int(r.source), int(r.lang)): r.share for r in mixing.rake(cells(spark, tokens), by).collect()}
    assert got == pytest.approx({k: v for k, v in np.ndenumerate(fitted(tokens, goals, 5000))}, abs=1e-7)
    assert got[0, 0] + got[0, 1] == pytest.approx(0.3, abs=1e-7)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    with pytest.warns(RuntimeWarning, match="not settled in 2 rounds"):
        mixing.rake(cells(spark, tokens), by, rounds=2)


def test_values_without_a_target_get_nothing(spark):
    raked = mixing.rake(cells(spark, np.ones((2, 2))), {"source": spark.createDataFrame([("0", 1.0), ("9", 5.0)], "value string, target double"), "lang": target(spark, [1, 1])})
    assert {(r.source, r.lang): r.share for r in raked.collect()} == pytest.approx({("0", "0"): 0.5, ("0", "1"): 0.5, ("1", "0"): 0, ("1", "1"): 0})


@pytest.mark.parametrize("keep", [0.2, 0.8, 1.0])
def test_probabilities_meet_the_budget(spark, keep):
    rows = [("a", 100.0, 0.6), ("b", 300.0, 0.3), ("c", 600.0, 0.1), ("d", 0.0, 0.0)]
    got = mixing.calibrate(spark.createDataFrame(rows, "source string, tokens double, share double"), keep).collect()
    assert all(0 <= r.probability <= 1 for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(keep * 1000)
    assert {r.source: r.probability for r in got}["d"] == 1.0


ROWS = [
    (1, "some words here", "en", "a", 1.0), (1, "some words here", "en", "a", 1.0), (2, None, None, None, 1.0), (3, "", "en", "b", 1.0), (None, "License text", "de", "b", 1.0), (4, "word " * 40000, "de", "a", 1.0),
    *((10 + i, f"doc {i} of many", "en" if i % 3 else "fr", "hot" if i % 2 else "b", 1.0) for i in range(60)),
]


def test_mix_keeps_columns_and_is_reproducible(spark):
    docs = mixing.describe(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, weight double"))
    got = mixing.mix(docs, keep=0.5)
    assert got.columns == ["doc_id", "text", "lang", "source", "topic", "n_tokens", "weight", "probability", "sampled"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        u = int(hashlib.md5(f"mix:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.sampled == (u < r.probability)
        assert r.n_tokens == len((r.text or "").split()) and r.topic == ("legal" if r.text and "License" in r.text else "prose")
    assert [r for r in rows if r.doc_id == 2][0].source is None
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.5 * tokens, rel=1e-6)


def test_given_targets_shift_the_tokens(spark):
    docs = mixing.describe(spark.createDataFrame([(i, "ten words " * 5, "en", "a" if i < 900 else "b") for i in range(1000)], "doc_id long, text string, lang string, source string"))
    got = mixing.mix(docs, {"source": {"a": 1, "b": 1}}, keep=0.15).where("sampled").groupBy("source").agg(F.count("*").alias("n")).collect()
    n = {r.source: r.n for r in got}
    assert 50 <= n["a"] <= 100 and 50 <= n["b"] <= 100


def test_columns_with_names_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x", 3, 5.0)], "doc_id long, topic string, lang string, source string, n_tokens int, cell_source double")
    assert mixing.mix(docs, keep=1.0).select("cell_source", "sampled").collect() == [(5.0, True)]


def test_empty_table(spark):
    docs = mixing.describe(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))
    assert mixing.mix(docs).count() == 0
