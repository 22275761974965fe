import math
import time

import numpy as np
import pytest

from tallyforge.llm import url_filter


def plain_model(urls, order, m):
    """log p(c | h) of the smoothed model of some URLs, by its definition."""
    count = {}
    for url in urls:
        s = "\x02" + url + "\x03"
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                count[s[i - k : i + 1]] = count.get(s[i - k : i + 1], 0) + 1
    inside = {}
    for gram, n in count.items():
        inside[gram[:-1]] = inside.get(gram[:-1], 0) + n

    def p(c, h):
        below = 1 / url_filter.CHARACTERS if not h else p(c, h[1:])
        return (count.get(h + c, 0) + m * below) / (inside.get(h, 0) + m)

    def log_likelihood(url):
        s = "\x02" + url + "\x03"
        return np.mean([math.log(p(s[i], s[max(0, i - order) : i])) for i in range(1, len(s))])

    return log_likelihood


GOOD = ["http://a.org/fr/read/12", "https://b.org/fr/read/77", "http://c.org/fr/essay"]
POOR = ["http://spam.net/buy/now", "http://x.net/buy/cheap", "https://buy.net/!"]


def test_score_equals_the_definition(spark):
    learn = spark.createDataFrame([(u, True) for u in GOOD] + [(u, False) for u in POOR], "url string, accepted boolean")
    asked = [*GOOD, *POOR, "", "http://new.com/read", "é\U0001f600", "http://" + "buy" * 5000]
    got = url_filter.score(spark.createDataFrame(list(enumerate(asked)), "id int, url string"), url_filter.train(learn)).collect()
    a, b = plain_model(GOOD, 4, 4.0), plain_model(POOR, 4, 4.0)
    assert {r.id: r.score for r in got} == pytest.approx({i: a(u) - b(u) for i, u in enumerate(asked)}, abs=1e-9)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_all_runs_are_kept_however_many(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
    letters = np.random.default_rng(2).integers(33, 127, (1500, 50))
    urls = ["http://" + "".join(map(chr, x)) for x in letters]
    learn = spark.createDataFrame([(u, i % 2 == 0) for i, u in enumerate(urls)], "url string, accepted boolean")
    model = url_filter.train(learn)
    marked = ["\x02" + u + "\x03" for u in urls]
    grams = {s[i - k : i + 1] for s in marked for i in range(1, len(s)) for k in range(min(4, i) + 1)}
    assert model[0].count() == len(grams) > 100_000
    got = url_filter.score(spark.createDataFrame(list(enumerate(urls[:20])), "id int, url string"), model).collect()
    a, b = plain_model(urls[::2], 4, 4.0), plain_model(urls[1::2], 4, 4.0)
    assert {r.id: r.score for r in got} == pytest.approx({i: a(u) - b(u) for i, u in enumerate(urls[:20])}, abs=1e-9)


def test_a_bounded_model_keeps_the_frequent_runs(spark):
    learn = spark.createDataFrame([(u, True) for u in GOOD] + [(u, False) for u in POOR], "url string, accepted boolean")


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://Sub.Example.NET/en/1?q#f", "sub.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
        ("http://notnet/x", "notnet", "/x", None, None),
        ("http://a.net", "a.net", "", None, None),
        ("http://a.net?x=/", "a.net", "", None, None),
        ("http://a.net/", "a.net", "/", "net/", "block"),
        ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
        ("ftp://q.org/fr/a#://b/", "q.org", "/fr/a", "org/fr/", "allow"),
        ("//nothing/", "", "", None, None),
        (None, "", "", None, None),
        ("a\nb://c.net/d\ne", "c.net", "/d\ne", "net/", "block"),
        ("x://y://z.net/", "y:", "//z.net/", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    got = url_filter.judged(spark.createDataFrame([(url,)], "url string")).first()
    assert (got.host, got.path, got.rule, got.by_rule) == (host, path, rule, verdict)


def test_models_judge_the_rest(spark):
    rows = [(i, f"http://site{i}.org/fr/read/essay{i}") for i in range(60)] + [(100 + i, f"http://spam{i}.net/buy/cheap{i}") for i in range(60)]
    rows += [(300, "http://new.com/fr/read/essay9"), (301, "http://new.com/buy/cheap7"), (302, None), (303, ""), (None, "http://no.id/x"), (300, "http://new.com/fr/read/essay9")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    assert [r.verdict for r in got if r.page_id == 300] == ["allow"] * 2 and [r.verdict for r in got if r.page_id == 301] == ["block"]
    assert all(r.verdict in ("allow", "block") for r in got)


def test_without_examples_the_rest_is_allowed(spark):
    got = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")).collect()
    assert [(r.verdict, r.score) for r in got] == [("allow", None)]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_a_url_of_many_characters(spark):
    began = time.perf_counter()
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.example.net/en/{i}" if i % 3 else f"http://example.com/de/{i}") for i in range(60)]
    rows += [(100, "http://other.org/" + "äb/c" * 50_000), (101, "http://other.org/x")]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 62 and {got[100], got[101]} <= {"allow", "block"}
    assert time.perf_counter() - began < 90


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    plans, cut = [], url_filter.cut
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(url_filter, "cut", lambda df, purpose: (planned(df), cut(df, purpose))[1])
    learn = spark.createDataFrame([(u, True) for u in GOOD] + [(u, False) for u in POOR], "url string, accepted boolean")
    planned(url_filter.score(learn.select("url"), url_filter.train(learn)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8
    assert not [p for p in plans if "Broadcast" in p]
