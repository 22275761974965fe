import random
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least_chars=5, least_n=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least_n}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def corpus():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdeÄéß") for _ in range(draw.randint(4, 9))) for _ in range(60)] + ["prefix" + "".join(draw.choice("ab") for _ in range(4)) for _ in range(40)]
    words = list(base)
    for w in base:
        k = draw.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], w.upper()]
    pick = [w for w in words for _ in range(draw.choice([1, 3, 6, 20]))]
    draw.shuffle(pick)
    rows = [(i, " ".join(pick[i::80]) + ", 12_x÷×") for i in range(80)]
    return [*rows, (3, rows[0][1]), (3, rows[0][1]), (90, None), (91, ""), (None, "Variant variant variants variants"), (92, "long" * 3000 + " " + "long" * 3000 + "x"), (93, "long" * 3000 + " " + "long" * 3000), (94, ("long" * 3000 + "x ") * 5)]


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_equals_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = expected(rows)
    assert found(spelling.variants(docs, hot=hot)) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[5] for w in want)


@pytest.mark.parametrize("hot", [0, 1000])
def test_pairs_of_short_words(spark, hot):
    words = ["", "a", "b", "ab", "ba", "abc", "abd", "xabc", "abcx", "aabc", "😀b", "😀", "aa", "aaa", "aaaa", "aaaaa"]
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), hot).collect()
    want = {(a, b) for a in words for b in words if one_edit(a, b) and ((len(a), a) < (len(b), b))}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_chains_reach_their_last_form(spark):
    words = [("form" + "x" * k, None if k == 40 else "form" + "x" * (k + 1)) for k in range(41)]
    got = spelling.roots(spark.createDataFrame(words, "word string, form string")).collect()
    assert len(got) == 40 and {r.root for r in got} == {"form" + "x" * 40}


def test_empty_table(spark):
    assert found(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_words_are_not_broadcast(spark, monkeypatch):
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    cut = spelling.cut
    monkeypatch.setattr(spelling, "cut", lambda df, purpose: (planned(df), cut(df, purpose))[1])
    planned(spelling.variants(spark.createDataFrame(corpus(), "doc_id long, text string"), hot=3))
    # what is broadcast are segments that many words share, and keys of many rows: those anti, semi and left joins only
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in line for line in joins) >= 6
    assert not [line for line in joins if "Broadcast" in line and "Inner" in line or "n_near" in line and "Broadcast" in line]
    assert not [p for p in plans if "ahead" in p and "Broadcast" in p]
