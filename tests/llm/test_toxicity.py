import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import toxicity
from tallyforge.llm.common import word_hash
from tallyforge.llm.toxicity import Model, fit, fit_ordinal, score

BAD = ["moron", "idiot", "scum", "veju"]


def corpus(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(plain, rng.integers(3, 60)))
        toxic = int(rng.random() < 0.15)
        times = rng.integers(1, 10) if toxic else 0
        for _ in range(times):
            bad = rng.choice(BAD)
            text.insert(rng.integers(len(text)), bad + "".join(rng.choice(list("abcdefgh"), 3)) if bad == "veju" else bad.capitalize() + ",")
        rows.append((i, " ".join(text)))
        labels.append((i, int(times < 5), toxic))  # the graver half is of bad quality too
    return rows, labels


def plain(model, text):
    """P(grade > k) of one text, word by word."""
    import re

    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    counts = {}
    for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()):
        own = [word_hash(word.decode("utf-8", "surrogateescape")) >> 8] if word.isascii() else []
        own += [int.from_bytes(word[:k], "little") | k << 56 for k in toxicity.PREFIXES if len(word) > k]
        for key in own:
            counts[key] = counts.get(key, 0) + 1
    x = sum(weight[k] * np.log1p(n) for k, n in counts.items() if k in weight)
    return [1 / (1 + np.exp(t - x)) for t in model.thresholds]


def test_scores_equal_a_plain_version(spark):
    rows, labels = corpus(400, seed=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in score(docs, model).collect():
        want = plain(model, r.text)
        assert r.p_toxic == pytest.approx(want[0], abs=1e-9) and r.severity == pytest.approx(sum(want), abs=1e-9)
        assert r.toxic == (r.p_toxic >= model.least) and r.grade == (max(1, sum(p >= 0.5 for p in want)) if r.toxic else 0)


def test_no_feature_is_left_out(spark):
    stems = ["".join(np.random.default_rng(i).choice(list("bcdfgh"), 9)) for i in range(3000)]
    rows = [(i, " ".join(stems[10 * (i // 6) : 10 * (i // 6) + 10]) if i % 6 < 5 and i < 1800 else "fine words here") for i in range(18000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t != "fine words here")) for i, t in rows], "doc_id long, quality int, toxic int")
    assert len(fit(docs, labels).keys) > 8192


def test_the_gradient_is_that_of_the_likelihood():
    """At the fitted point no small step makes the penalised likelihood better."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (600, 3))
    grade = np.digitize(x @ [1.0, -0.5, 0.3] + rng.logistic(size=600), [0.0, 1.5])
    doc, at = np.nonzero(x)
    w, t = fit_ordinal(doc, at, x[doc, at].astype(float), grade, 3, penalty=1e-3, steps=3000, rate=0.02)

    def loss(p):
        edges = np.concatenate([np.zeros((600, 1)), 1 / (1 + np.exp(-(p[None, 3:] - (x @ p[:3])[:, None]))), np.ones((600, 1))], 1)
        rows = np.arange(600)
        return -np.log(edges[rows, grade + 1] - edges[rows, grade]).mean() + 0.5e-3 * (p[:3] ** 2).sum()

    p = np.concatenate([w, t])
    assert all(loss(p) <= loss(p + step) + 1e-7 for k in range(5) for step in (0.02 * np.eye(5)[k], -0.02 * np.eye(5)[k]))


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([x for x in labels if x[0] < 800], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in score(docs, model).collect()}
    held = [(x[2], got[x[0]]) for x in labels if x[0] >= 800]
    assert sum(bool(y) == r.toxic for y, r in held) >= 0.98 * len(held)
    assert not any(r.toxic for y, r in held if not y)
    assert (np.diff(model.thresholds) > 0).all()
    by = {g: np.mean([r.severity for _, r in held if r.grade == g]) for g in {r.grade for _, r in held}}
    assert sorted(by.values()) == [by[g] for g in sorted(by)] and len(by) >= 3


def test_ordinal_fit_finds_weights_and_ordered_thresholds():
    rng = np.random.default_rng(2)
    n = 4000
    x = rng.integers(0, 4, (n, 2))
    latent = 1.5 * x[:, 0] - 1.0 * x[:, 1] + rng.logistic(size=n)
    grade = np.digitize(latent, [0.0, 2.0])
    doc, at = np.nonzero(x)
    w, t = fit_ordinal(doc, at, x[doc, at].astype(float), grade, 2, penalty=1e-6, steps=1500)
    assert w == pytest.approx([1.5, -1.0], abs=0.15) and t == pytest.approx([0.0, 2.0], abs=0.2)


def test_prefixes_are_exact():
    keys, doc = toxicity.features(pa.array(["abcdefgh", None, "", "abcd"]))
    other, _ = toxicity.features(pa.array(["abcdefxx"]))
    assert doc.tolist().count(0) == 4 and doc.tolist().count(3) == 1
    assert len(set(keys[doc == 0].tolist()) & set(other.tolist())) == 3


def test_edge_cases(spark):
    rows, labels = corpus(300)
    extra = [(None, "no id moron idiot scum"), (900, None), (901, ""), (902, "moron idiot scum " * 20000), (3, rows[3][1]), (903, "...")]
    docs = spark.createDataFrame([(*r, "kept", 7) for r in rows + extra], "doc_id long, text string, other string, grade int")
    given = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (3, 0, labels[3][2])], "doc_id long, quality int, toxic int")
    got = toxicity.grade_documents(docs, given)
    assert got.columns == ["doc_id", "text", "other", "severity", "p_toxic", "grade", "toxic"]
    out = got.collect()
    assert len(out) == len(rows) + len(extra)
    by = {(r.doc_id, r.text): r for r in out}
    assert by[None, "no id moron idiot scum"].toxic and by[902, extra[3][1]].toxic
    assert not by[900, None].toxic and not by[901, ""].toxic
    assert by[900, None].severity == by[901, ""].severity


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "moron")], "doc_id long, text string")
    for labels in ([], [(1, 1, 1)]):
        got = toxicity.grade_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert [r.toxic for r in got] == [False]
    assert toxicity.grade_documents(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert Model().above(pa.array(["x"])).max() < 1e-6
