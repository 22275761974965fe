import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import winnowing
from tallyforge.llm.winnowing import winnow


M = (1 << 64) - 1


def mixed(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * factor & M
    return h ^ h >> 33


def rolling(text):
    """The polynomial of a run of characters, one character after the other."""
    h = 0
    for c in text:
        h = (h * winnowing._BASE + mixed(ord(c) + 1)) & M
    return mixed(h)


def plain(text, gram, window):
    """Winnowing as its definition has it, one window after the other."""
    if not text:
        return []
    gram = min(gram, len(text))
    hashes = [rolling(text[i : i + gram]) >> 20 for i in range(len(text) - gram + 1)]
    window = min(window, len(hashes))
    out = []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        at = max(k for k in range(i, i + window) if hashes[k] == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out


def pairs(text, gram, window):
    value, position = winnow(text, gram, window)
    return list(zip(value.tolist(), position.tolist(), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.text("abé\U0001f600", max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_equals_the_definition(text, gram, window):
    assert pairs(text, gram, window) == plain(text, gram, window)


def test_ties_take_the_rightmost():
    assert [p for _, p in pairs("aaaaaaaa", 2, 3)] == [2, 3, 4, 5, 6]


def test_segments_change_nothing(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abc "), 5000))
    whole = pairs(text, 5, 20)
    monkeypatch.setattr(winnowing, "_SEGMENT", 256)
    monkeypatch.setattr(winnowing, "_HIGH", ~np.uint64(255))
    parts = [p for _, p in pairs(text, 5, 20)]
    assert parts == [p for _, p in whole]


@settings(max_examples=50, deadline=None)
@given(st.text("ab", max_size=30), st.text("ab", max_size=30), st.text("abc", min_size=12, max_size=20))
def test_a_long_match_is_always_found(before, after, shared):
    gram, window = 4, 9  # 12 characters in a row
    a, b = winnow(before + shared, gram, window)[0], winnow(shared + after, gram, window)[0]
    assert set(a.tolist()) & set(b.tolist())


def test_half_of_a_short_text_is_seen():
    text, other = "a text of some forty characters, not more", "quite another text, which shares nothing"
    new = winnowing.edited(text * 2, other * 2)
    assert winnowing.likeness(winnow(text * 2)[0], winnow(new)[0]) > 0.1


def expected(rows, gram, window):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        sets = [{h for h, _ in plain(x, gram, window)} for x in (text, new, other)]
        alike = [1.0 if not sets[0] | s else len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), *alike))
    return sorted(out, key=str)


ROWS = [
    (5, "the first text, which is the fifth"), (7, None), (9, ""), (2, "the first text, which is the second, \U0001f600é\U0001f600"), (None, "no id"), (None, None),
    (11, "repeated"), (11, "repeated"), (11, "other"), (40, "x"), (30, "long " * 3000),
]


def test_compare_with_next(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, chunk int, guest string").repartition(3)
    for chunk_bytes in (1 << 20, 40):
        got = winnowing.compare_with_next(docs, 5, 8, chunk_bytes=chunk_bytes)
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
        rows = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got.collect()]
        assert sorted(rows, key=str) == expected(ROWS, 5, 8)
        places = {(i, tuple(p for _, p in plain(t or "", 5, 8))) for i, t in ROWS}
        assert {(r.doc_id, tuple(r.positions)) for r in got.collect()} == places


def test_fingerprints_keep_positions(spark):
    docs = spark.createDataFrame([(1, "abcdefgh" * 9, 0), (2, None, 0)], "doc_id long, text string, hashes int")
    rows = {r.doc_id: r for r in winnowing.fingerprints(docs, 5, 8).collect()}
    assert list(zip(rows[1].hashes, rows[1].positions, strict=True)) == plain("abcdefgh" * 9, 5, 8)
    assert rows[2].hashes == []


def test_empty_table_and_single_document(spark):
    assert winnowing.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert winnowing.compare_with_next(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).collect()[0].near_next == 1.0
