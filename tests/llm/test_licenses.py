import re
import time

import numpy as np
import pytest

from tallyforge.llm import licenses
from tallyforge.llm.licenses import _hashes, compile_template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "...", "Released under the MIT License.", "under the mit license under the mit license", "CC BY-NC 4.0, and cc by nc by nc",
    "é " * 50_000 + "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. More.",
    "This work is licensed under the GNU General Public License, version 3.", "under the mit", "license under the mit license", "UNDER THE MIT LICENSÉ",
    "Copyright 2020 A. Nobody. " + licenses._MIT_GRANT.replace("<<beginOptional>>(including the next paragraph)<<endOptional>>", "") + "\n" + licenses._MIT_DISCLAIMER.replace("<<var>>", "the authors or copyright holders " * 30),
    licenses._MIT_GRANT + " but never on a Sunday. " + licenses._MIT_DISCLAIMER.replace("<<var>>", "the authors"),
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    found = WORD.findall(lower(text))
    starts, labels = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(found) - len(p) + 1):
            if found[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[3], "x")], "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[8] == "gpl-3" and labels[7] == "apache-2" and labels[12] == "mit" and labels[13] == "" and labels[9] == ""
    score = {r.doc_id: r.score for r in rows}
    assert score[3] == 1.0 and score[0] == 0.0 and 0.98 < score[12] < 1


def as_regex(markup):
    out = []
    for i, part in enumerate(licenses.MARK.split(markup)):
        if i % 2 and part == "beginOptional":
            out.append("(?:")
        elif i % 2 and part == "endOptional":
            out.append(")?")
        elif i % 2:
            out.append("(?: [^ ]+){0,%s}" % re.search("max=([0-9]+)", part)[1] if "max=" in part else "(?: [^ ]+)*")
        else:
            out.append("".join(f" {w}" for w in WORD.findall(lower(part))))
    return re.compile("".join(out))


@pytest.mark.parametrize("markup", ["a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> e <<var;max=2>> f", "a b <<var;max=3>> a", "a b <<var>> c <<beginOptional>>d<<endOptional>>", "a b c"])
def test_automaton_accepts_what_a_pattern_does(markup):
    import itertools

    automaton, pattern = compile_template("x", markup), as_regex(markup)
    for n in range(3, 7):
        for rest in itertools.product("abcdef", repeat=n - 2):
            text = " ".join(["a", "b", *rest])
            tokens = np.array(_hashes(text), np.uint64)
            accepted = [k for k in range(1, n + 1) if pattern.fullmatch("".join(f" {w}" for w in text.split()[:k]))]
            assert automaton.longest(tokens) == [max(accepted, default=0)]


@pytest.mark.parametrize("markup", ["a b <<beginOptional>>c<<endOptional>> e", "a b <<var;max=3>> a", "a b <<var>> c <<beginOptional>>d<<endOptional>>", "a a a"])
def test_all_starts_at_once_equal_each_alone(markup):
    automaton, draw = compile_template("x", markup), np.random.default_rng(3)
    for n in (1, 5, 40, 200):
        tokens = np.array(_hashes(" ".join(draw.choice(list("aabbcde"), n))), np.uint64)
        for starts in (range(n), draw.choice(n, n // 3, replace=False)):
            starts = sorted(int(s) for s in starts)
            assert automaton.longest(tokens, starts) == [automaton.longest(tokens[s:])[0] for s in starts]


def test_a_long_text_of_grants_that_never_end(spark):
    began = time.perf_counter()
    grant = dict(reversed(licenses.TEMPLATES))["mit"].split("<<")[0] + " and so on. "
    [row] = licenses.scan(spark.createDataFrame([(1, grant * 2000 + "the mit license")], "doc_id long, text string")).collect()
    assert row.n_words > 100_000 and row.spans == [] and time.perf_counter() - began < 60


@pytest.mark.parametrize("markup", ["<<var;max=3>> x", "a <<beginOptional>>b<<endOptional>>", "a b <<beginOptional>>c", "a b <<endOptional>>"])
def test_bad_templates_are_refused(markup):
    with pytest.raises(ValueError):
        compile_template("x", markup)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
