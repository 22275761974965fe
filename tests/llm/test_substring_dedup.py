import re

import numpy as np
import pytest

from tallyforge.llm.substring_dedup import remove_repeated


def expected(rows, window):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in sorted(rows, key=key)]
    seen, out = set(), []
    for i, words in docs:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            run = tuple(words[s : s + window])
            if run in seen:
                gone[s : s + window] = [True] * window
            seen.add(run)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(rng.choice(["a", "b", "ü", "d,"], n))
    passage = word(30)
    rows = [(int(i), f"{word(rng.integers(0, 40))}\n{passage if i % 3 else ''}\t{word(10)}") for i in rng.permutation(60)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (100, None), (101, ""), (102, " \n "), (None, passage), (103, "x " * 5000)]
    return rows


@pytest.mark.parametrize("chunk_bytes", [100, 1 << 20])
@pytest.mark.parametrize("window", [1, 4, 20])
def test_equals_brute_force(spark, chunk_bytes, window):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, kept_text string").repartition(3)
    got = remove_repeated(docs, window, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "removed", "kept_text"]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=str) == expected(rows, window)
    assert all(sum(x["past"] - x["first"] for x in r.removed) == r.n_removed for r in found)


def thue_morse(n, a, b):
    x = [0]
    while len(x) < n:
        x += [1 - i for i in x]
    return "".join(b if i else a for i in x)


@pytest.mark.parametrize("chunk_bytes", [100, 1 << 20])
def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark, chunk_bytes):
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{thue_morse(1024, 'a', 'b')} {rest}"), (2, f"{thue_morse(1024, 'b', 'a')} {rest}")]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 20, chunk_bytes=chunk_bytes)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, 0]


@pytest.mark.parametrize("chunk_bytes", [100, 1 << 20])
def test_equal_hashes_of_unequal_words_change_nothing(spark, chunk_bytes, monkeypatch):
    from tallyforge.llm import substring_dedup

    plain = substring_dedup._windows
    monkeypatch.setattr(substring_dedup, "_windows", lambda texts, window: plain(texts, window) % np.uint64(7) << np.uint64(60))
    import pyarrow as pa

    rows = [(1, "a b c d e"), (2, "x b c d y"), (3, "b c d p q r"), (4, "q r s t p q r"), (5, "a b c d e")]
    tables = [pa.table({"doc_id": [i], "text": [t], "chunk": [i]}) for i, t in rows]
    if chunk_bytes > 100:
        tables = [pa.concat_tables(tables).set_column(2, "chunk", pa.array([0] * len(rows)))]
    by = lambda t, name: [t.filter(pa.compute.equal(t[name], k)) for k in sorted(set(t[name].to_pylist()))]
    join = lambda f, name, parts: [f(x) for x in by(pa.concat_tables(parts), name)]
    own = lambda parts, k: t.filter(pa.compute.equal(t["chunk"], k)) if (t := pa.concat_tables(parts)).num_rows else t
    told = join(substring_dedup._share, "bucket", [substring_dedup._send(3, 2, "text")(t) for t in tables])
    proposed = [substring_dedup._propose(3, 2, "doc_id", "text")(t, own(told, t["chunk"][0].as_py())) for t in tables]
    back = join(substring_dedup._confirm, "bucket", proposed) if any(p.num_rows for p in proposed) else proposed
    out = pa.schema([("doc_id", "int64"), ("n_removed", "int64"), ("removed", pa.list_(pa.struct([("first", "int64"), ("past", "int64")])))])
    got = pa.concat_tables([substring_dedup._remove(3, "doc_id", "text", True, out)(t, own(back, t["chunk"][0].as_py())) for t in tables])
    assert list(zip(*(got[c].to_pylist() for c in ("doc_id", "n_removed")), strict=True)) == [(i, n) for i, _, n, _ in expected(rows, 3)]


def test_columns_with_names_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "z a b c", 6)], "doc_id long, text string, chunk_of int")
    got = remove_repeated(docs, 3, chunk_bytes=3).orderBy("doc_id").collect()
    assert [(r.chunk_of, r.n_removed) for r in got] == [(5, 0), (6, 3)]


def test_white_space_stays_without_reflow(spark):
    docs = spark.createDataFrame([(1, "a b\nc  d e"), (2, "x\n\ty  a b\nc z")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in remove_repeated(docs, 3, reflow=False).collect()}
    assert got[1] == "a b\nc  d e" and got[2] == "x\n\ty  z"


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="need numbers"):
        remove_repeated(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
