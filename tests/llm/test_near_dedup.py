import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import near_dedup
from tallyforge.llm.components import components
from tallyforge.llm.near_dedup import near_duplicates, superminhash


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def expected(rows, n, percent):
    """By id, so that rows of one id are one document of several texts."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and a != b and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(rng.choice(words, rng.integers(1, 80)))))
    for i in range(60):  # edited copies, in chains
        text = rows[rng.integers(len(rows))][1].split()
        for _ in range(rng.integers(0, 4)):
            text[rng.integers(len(text))] = str(rng.choice(words))
        rows.append((100 + i, " ".join(text)))
    rows += [(200 + i, "HOT copy of ONE text that many have " * 3) for i in range(50)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "two words"), (304, "TWO\nwords"), (None, "two words"), (305, "é ü " * 3000), (306, "é ü " * 3001), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80), (1, 50)])
def test_equals_brute_force(spark, n, percent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    got = near_duplicates(docs, n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, n, percent)


def test_an_id_of_several_texts_links_them(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a + " x"), (2, a), (5, a), (5, b), (9, b + " x"), (5, None), (11, "c d e f"), (11, "g h i j"), (12, "g h i j")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 5: 1, 9: 1, 11: 11, 12: 11}


def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark):
    x = [0]
    while len(x) < 1024:
        x += [1 - i for i in x]
    rows = [(k, "".join("ab"[i ^ k] for i in x)) for k in (0, 1)]
    assert [r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [0, 1]


def test_links_that_only_hashes_show_are_not_taken(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "shingle_hashes", lambda texts, size: (np.ones(len(texts), np.uint64), np.arange(len(texts))))
    batch = pa.RecordBatch.from_pydict({"a": [2, 3], "b": [1, 1], "text_a": ["a b c", "x y z"], "text_b": ["A  b c", "A  b c"]})
    assert [b.to_pylist() for b in near_dedup._verify(3, 85)(iter([batch]))] == [[{"a": 2, "b": 1}]]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    places, errors = 128, []
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (60, 20, 20))
        items = np.concatenate([both, a, both, b])
        sig = superminhash(items, np.repeat([0, 1], [80, 80]), 2, places)
        errors.append((sig[0] == sig[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.1 * np.sqrt(0.24 / places)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (4, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_empty_table_and_plan(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    bands = near_dedup.band_plan(85)
    assert (1 - 0.85**5) ** bands <= 1e-9


def test_signatures_of_many_short_documents_need_little_memory():
    """Documents of fewer shingles than places keep all their permutations open: they are made for some documents at a time."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 150)) for _ in range(1000)] + ["", "one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    sign = near_dedup._sign(5, 53, 5)
    tracemalloc.start()
    whole = pa.Table.from_batches(sign([batch])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for i in (0, 1, 500, 999, 1000, 1001):
        assert pa.Table.from_batches(sign([batch.slice(i, 1)])).to_pylist() == [whole[i]]
