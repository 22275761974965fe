import hashlib
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(open(PATH, "rb").read())
TEXTS = [
    None, "", " \n\t ", "Hello  wörld's 123 <|endoftext|>x<|startoftext|>", "aaaaaaaaaaaaaaaaaaaaaa", "a\x1cb \x1f c", "İstanbul ΑΣ ǅ ﬁ",
    "é é ̈x", "\U0001f600\U0001f601 !?!?--- don't we'll I'D", "x" * 5000 + " " + "ab" * 3000, "1234567", "　wide space line", "<|endoftext", "\u0000",
]


def expected(text):
    ids = REAL.encode(text or "", add_special_tokens=False).ids
    return ids, REAL.decode(ids, skip_special_tokens=False)


def encoded(text, remembered=bpe.REMEMBERED):
    encoder = bpe.Encoder(VOCABULARY, remembered)
    return memoryview(encoder.encode(encoder.texts([text])[0])).cast("i").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    ids, decoded = expected(text)
    assert encoded(text) == ids
    assert VOCABULARY.decode(ids) == decoded


YOUNG = [c for a, b in [*bpe.UNMOVED, *bpe.MORE_NUMBERS, *bpe.MORE_LETTERS] for c in (a, b)] + [*bpe.MORE_LOWER, 0x11935, 0x11938]


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*map(chr, YOUNG), "a", "e", "\u0301", "\u0323", "\u0308", "!", "7", "Σ"])), max_size=40))
def test_equals_the_library_on_any_text(text):
    assert encoded(text) == expected(text)[0]


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "aäeß"])
def test_long_words_equal_the_library_and_take_seconds(alphabet):
    draw = random.Random(7)
    for n in (bpe.LONG, bpe.LONG + 1, 5000, 200_000):
        word = "".join(draw.choice(alphabet) for _ in range(n))
        began = time.perf_counter()
        got = encoded(f"short {word} words")
        assert time.perf_counter() - began < 20
        assert got == REAL.encode(f"short {word} words", add_special_tokens=False).ids


def test_equals_the_library_on_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shown in ("a{0}b", "{0}{0}", "!{0}7"):
        encoder = bpe.Encoder(VOCABULARY)
        for i in range(0, len(points), 1 << 14):
            text = " ".join(shown.format(chr(c)) for c in points[i : i + (1 << 14)])
            got = encoder.encode(encoder.texts([text])[0])
            assert memoryview(got).cast("i").tolist() == REAL.encode(text, add_special_tokens=False).ids, hex(points[i])


def test_merging_all_places_of_a_pair_at_once_is_safe():
    """No merge ranks below one that makes a part of it, so the order of places in a word does not matter."""
    made = dict(zip(VOCABULARY.merged.tolist(), VOCABULARY.ranks.tolist()))
    low = (1 << 20) - 1
    for key, rank in zip(VOCABULARY.keys.tolist(), VOCABULARY.ranks.tolist()):
        assert made.get(key >> 20, -1) < rank and made.get(key & low, -1) < rank
    assert len(made) == len(VOCABULARY.merged)


def test_round_trip_and_encode_agree(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, "no id", "kept"), (1, "again", "kept"), (1, "again", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(expected(t)[0]), sha(" ".join(map(str, expected(t)[0]))), sha(expected(t)[1])) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    both = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "ids", "decoded").collect()
    assert sorted(((r[0], r[1], r[2]) for r in both), key=str) == sorted(((i, *expected(t)) for i, t, _ in rows), key=str)


def test_a_small_memory_changes_nothing(spark):
    encoder = bpe.Encoder(VOCABULARY, remembered=2)
    for text in TEXTS:
        assert memoryview(encoder.encode(encoder.texts([text])[0])).cast("i").tolist() == expected(text)[0]


def test_columns_with_names_of_the_operator_stay(spark):
    docs = spark.createDataFrame([("a b", 1, "own", 9)], "text string, doc_id long, _text string, n_tokens int")
    assert bpe.encode(docs, PATH).drop("ids").collect() == [(1, "own", 2)]


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
