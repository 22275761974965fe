import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing import fitted
from test_near_dedup import expected as near_copies
from test_substring_dedup import expected as without_repeats
from test_toxicity import plain as plain_severity
from tokenizers import Tokenizer

from tallyforge.llm import mixing, toxicity
from tallyforge.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        if name == "bpe":
            assert {r.doc_id: r.ids for r in rows} == {i: real.encode(r.text or "", add_special_tokens=False).ids for i, r in before.items()}
            break
        assert out.columns == corpus_pipeline.COLUMNS
        now = {r.doc_id: r for r in rows}
        assert set(now) <= set(before)
        if name == "substring_dedup":
            assert set(now) == set(before) and any(now[i].text != before[i].text for i in now)
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            assert all(now[i] == before[i] for i in now) and 0 < len(now) < len(before)
        docs, before = out, now


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def plain_run(spark):
    """All stages over sf0.001 in plain Python, but for the fit of the first."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs.select(*corpus_pipeline.COLUMNS), labels)
    rows = {r.doc_id: r for r in docs.collect() if plain_severity(model, r.text)[0] < model.least}
    kept = {i for i, _, _, first in near_copies([(i, r.text) for i, r in rows.items()], 5, 80) if first}
    left = {i: text for i, _, _, text in without_repeats([(i, rows[i].text) for i in kept], 20)}
    cell = {i: (rows[i].source or "", rows[i].lang or "", next((n for n, parts in mixing.TOPICS if any(p in text.lower() for p in parts)), "prose")) for i, text in left.items()}
    size = {i: len(text.split()) for i, text in left.items()}
    values = [sorted({c[k] for c in cell.values()}) for k in range(3)]
    tokens = np.zeros([len(v) for v in values])
    for i, c in cell.items():
        tokens[tuple(v.index(x) for v, x in zip(values, c, strict=True))] += size[i]
    goals = []
    for axis in range(3):
        own = tokens.sum(tuple(k for k in range(3) if k != axis)) ** 0.7
        goals.append(own / own.sum())
    ratio = fitted(tokens, goals, 2000) * tokens.sum() / np.where(tokens > 0, tokens, 1)
    low, high = 0.0, 1e6
    for _ in range(200):
        scale = (low + high) / 2
        low, high = (scale, high) if (np.minimum(1, scale * ratio) * tokens).sum() < 0.8 * tokens.sum() else (low, scale)
    chance = np.where(tokens > 0, np.minimum(1, scale * ratio), 1)
    drawn = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
    sampled = [i for i, c in cell.items() if drawn(i) < chance[tuple(v.index(x) for v, x in zip(values, c, strict=True))]]
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: real.encode(left[i], add_special_tokens=False).ids for i in sampled}


def test_run_equals_a_plain_version(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    found = {r.doc_id: r.ids for r in got.collect()}
    assert found == plain_run(spark)


ODD = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", None, "a", 2), (None, "word " * 50, "en", None, 250), (4, "long " * 60_000, "en", "hot", 300_000), (5, "same text here", "en", "hot", 14), (6, "same text here", "de", "hot", 14)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_nulls_repeats_long_and_no_rows(spark, rows):
    """Null and empty texts stay and have no tokens, repeated rows are one document to near-dedup and stay, further columns go."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = plain.withColumns({"toxic": F.lit("x"), "kept": F.lit(1), "chunk": F.lit(2), "topic": F.lit("t"), "weight": F.lit(0.5), "removed": F.lit(None).cast("string"), "cell_source": F.lit("c")})
        got = stage(spark, docs, SF).collect()
        assert len(got) <= len(rows) and {r.doc_id for r in got} <= {r[0] for r in rows}
        if name == "bpe":
            assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == ({1: 0, 2: 0, 3: 0} if rows else {})
        elif name == "near_dedup" and rows:
            assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5}
        elif name == "substring_dedup" and rows:
            assert {r.doc_id: r.text for r in got if r.doc_id in (1, 2, 5, 6)} == {1: None, 2: "", 5: "same text here", 6: "same text here"}
