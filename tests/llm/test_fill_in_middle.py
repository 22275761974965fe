import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from tallyforge.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(i, text, rate=50):
    units = UNIT.findall(text or "")
    h = [int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text or ""
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "a", " a ", "one two  three\n", "<P> x", "a<M>b c", "half < P> <S", "<S", "P>", "äöü 日本語 x   y\x1f", "\t\n x", "😀 😀😀 z", "a\x00b c", "a " * 3000, " " * 1000, "x" * 5000]


def test_equals_brute_force(spark):
    rows = [(i * 20 + k, t) for i, t in enumerate(TEXTS) for k in range(12)]
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, form string, other int").repartition(3)
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = {r.doc_id: r for r in got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()}
    for i, t in rows:
        r = found[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(i, t)
        assert r.back == (t or "")
    assert {r.form for r in found.values()} == {"plain", "psm", "spm"}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    got = fim.fill_in_middle(docs, rate=100).collect()
    assert sorted((r.form, r.output) for r in got) == sorted(expected(i, "a b c", 100)[1::3] for i in (1, 1, "null"))


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["ab c  d" * 300_000, " " * 2_000_000, "x" * 2_000_000, "\n" * 1_000_000 + "end"])
def test_long_texts(text):
    began = time.perf_counter()
    split = Split(Regex(fim.UNIT), "isolated")
    for piece in (1000, fim.PIECE):
        assert fim.unit_ends(text, split, piece).tolist() == [m.end() for m in UNIT.finditer(text)]
    assert time.perf_counter() - began < 30
