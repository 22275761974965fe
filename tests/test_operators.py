import datetime
import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import categories, fuzzy, signals, text
from tallyforge.operators import categorize, learning, merchants, store, trends


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("raw", "words", "token"),
    [
        ("REWE Markt 1234 Berlin", "rewe", "rewe"),
        ("Apple Pay Lidl sagt Danke", "lidl", "lidl"),
        ("C24 Bank GmbH", "c24 bank", "c24"),
        ("Filiale 12, 4711", "", None),
        ("Müller & Söhne KG", "müller söhne", "müller"),
        (None, None, None),
    ],
)
def test_merchant_words(spark, raw, words, token):
    assert list(one(spark, text.normalize(F.lit(raw).cast("string")), text.merchant_token(F.lit(raw).cast("string")))) == [words, token]


def test_canonical_key_falls_back(spark):
    key = lambda c, d: one(spark, text.canonical_key(F.lit(c).cast("string"), F.lit(d).cast("string")))[0]
    assert key("Rewe Berlin", "x") == "rewe" and key("GmbH", "Lidl 12") == "lidl" and key("GmbH", "Berlin") == "gmbh" and key(None, "!!!") == "!!!"


@pytest.mark.parametrize(("a", "b", "score"), [("", "", 1.0), ("rewe", "rewe", 1.0), ("abcd", "abce", 0.75), ("", "x", 0.0)])
def test_levenshtein_similarity(spark, a, b, score):
    assert one(spark, fuzzy.levenshtein_similarity(F.lit(a), F.lit(b)))[0] == pytest.approx(score)


def test_best_match_takes_the_first_of_equals(spark):
    left = spark.createDataFrame([("rossmnn",), ("xy",), ("zzzz",)], "word string")
    known = spark.createDataFrame([("rossmann", 2), ("rossmenn", 1), ("ross", 3)], "name string, position int")
    assert [tuple(r)[:2] for r in fuzzy.best_match(left, "word", known, "name", "position").collect()] == [("rossmnn", "rossmenn")]


def test_statement_score(spark):
    full = "IBAN DE89 3704 0044 0532 0130 00 BIC X Kontostand 1.234,56 EUR am 01.02.2024 Buchung"
    got = one(spark, *(signals.statement_score(F.lit(x).cast("string"), F.lower(F.lit(x).cast("string"))) for x in (full, "", None, "nothing here")))
    assert list(got) == [110, 0, 0, 0]


@pytest.mark.parametrize(
    ("words", "cents", "category", "suggested"),
    [
        ("Netflix.com", -999, "SUBSCRIPTIONS", None), ("Gehalt Januar", 100, "SALARY", None), ("Miete", -5, "RENT", None), ("Miete", 5, "REFUND", None), ("Entgelt", -5, "OTHER", "OTHER"),
        ("something", 30_001, "OTHER", "SALARY"), ("something", 30_000, "OTHER", "REFUND"), ("something", -1, "OTHER", None), (None, 0, "OTHER", None),
    ],
)
def test_cascade(spark, words, cents, category, suggested):
    got = one(spark, categories.gated(categories.cascade(F.lower(F.lit(words).cast("string")), F.lit(cents))).alias("x")).x
    assert (got.category, got.suggested) == (category, suggested)


def test_overrides_come_first(spark):
    rows = spark.createDataFrame([("Rewe Berlin", "a"), ("Shell", "tank"), ("Nobody", "b"), ("Aral Station", "x")], "counterparty_name string, description string")
    known = spark.createDataFrame([("rewe berlin", "SUPERMARKET"), ("tank shell", "custom:7"), ("aral", "TRANSPORT")], "pattern string, category_name string")
    got = {r.counterparty_name: (r.override, r.custom_id) for r in categorize.with_overrides(rows, known).collect()}
    assert got == {"Rewe Berlin": ("SUPERMARKET", None), "Shell": (None, 7), "Nobody": (None, None), "Aral Station": ("TRANSPORT", None)}


def test_longest_keyword_wins(spark):
    rows = spark.createDataFrame([(1, "The Burger King!"), (2, "kingdom"), (3, "an ax"), (4, None)], "id int, words string")
    known = spark.createDataFrame([(0, "A", "king"), (1, "B", "burger king"), (2, "C", "ax")], "position int, category string, keyword string")
    assert [tuple(r) for r in merchants.keyword_matches(rows, "id", "words", known).collect()] == [(1, "B", "burger king")]


def test_display_name_is_the_most_frequent(spark):
    rows = spark.createDataFrame([("Rewe", "x", -1)] * 2 + [("REWE Berlin", "x", -1)] * 2 + [(None, "Rewe 12", -1), ("  ", "!!", -1)], "counterparty_name string, description string, amount_cents long")
    got = {r.key: (r.n, r.display_name) for r in merchants.canonical_groups_of(rows).collect()}
    assert got["rewe"] == (5, "REWE Berlin")


def test_trend_arithmetic(spark):
    pairs = [(-110, -100, "UP", 10), (-104, -100, "STABLE", 4), (-90, -100, "DOWN", -10), (-5, 0, "UP", 100), (0, 0, "STABLE", 0)]
    for now, before, trend, size in pairs:
        got = one(spark, trends.direction(F.lit(now), F.lit(before)), F.abs(trends.percent_change(F.lit(now), F.lit(before))))
        assert got[0] == trend and got[1] == pytest.approx(abs(size))
    assert [one(spark, trends.percent_label(F.lit(x)))[0] for x in (0.5, 42.9, -1500.0)] == ["<1%", "42%", ">999%"]


def test_duplicates_of_stored_and_earlier_rows(spark):
    schema = "id long, account_id long, booking_date date, amount_cents long, description string, is_duplicate boolean"
    day = datetime.date(2024, 1, 1)
    old = spark.createDataFrame([(1, 1, day, -5, "a", False), (2, 1, day, -6, "b", True)], schema)
    new = spark.createDataFrame([(10, 1, day, -5, "a", None), (11, 1, day, -6, "b", None), (12, 1, day, -6, "b", None), (13, 2, day, -5, "a", None)], schema)
    assert {r.id: r.is_duplicate for r in store.flag_duplicates(old, new, ["id"]).collect()} == {10: True, 11: False, 12: True, 13: False}


def test_upsert_and_update(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "key string, value string, seq int")
    out = store.upsert(table, spark.createDataFrame([("a", "z", 3), ("c", "w", 4)], "key string, value string, seq int"), "key", "seq")
    assert sorted((r.key, r.value) for r in out.collect()) == [("a", "z"), ("b", "y"), ("c", "w")]
    out = store.update_by_key(table, spark.createDataFrame([("a", None, 9)], "key string, value string, seq int"), "key")
    assert sorted(map(tuple, out.collect())) == [("a", "x", 9), ("b", "y", 2)]


def test_training_and_scoring(spark):
    rows = [(i, f"rewe lidl food {i % 7}" if i % 2 else f"hotel flight booking {i % 5}", "SUPERMARKET" if i % 2 else "TRAVEL") for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, words string, label string").withColumns({"who": F.lit(None).cast("string"), "amount": F.lit(-20.0)})
    frame = learning.with_feature_text(frame, "words", "who", "amount")
    model = learning.train(frame)
    scored = model.transform(frame)
    assert scored.where("prediction = label_index").count() == 60
    assert learning.folds(frame, "id").groupBy("label", "fold").count().count() == 10
    with pytest.raises(ValueError):
        learning.folds(frame.limit(1), "id")


def _three_kinds(spark):
    kinds = {"SUPERMARKET": "rewe lidl food", "TRAVEL": "hotel flight booking", "RENT": "flat house rent"}
    rows = [(i, f"{words} {words.split()[i % 3]} n{i % 7} {'hotel' if i % 11 == 0 else ''}", name) for i in range(45) for name, words in [list(kinds.items())[i % 3]]]
    return spark.createDataFrame(rows, "id int, feature_text string, label string")


def test_serving_computes_what_training_computes(spark, tmp_path):
    rows = _three_kinds(spark)
    model = learning.train(rows, vocabulary=40)
    own = {r.id: (r.predicted, r.confidence) for r in learning.predictions(model, rows, "id").collect()}
    learning.save_model(learning.model_of(model), str(tmp_path))
    served = learning.classify(rows, "id", "feature_text", learning.load_model(spark.read.text(f"{tmp_path}/model"))).collect()
    assert len(served) == 45 and {r.label for r in served} == {"SUPERMARKET", "TRAVEL", "RENT"}
    for r in served:
        assert r.label == own[r.id][0] and r.probability == pytest.approx(own[r.id][1], abs=1e-9)
    assert spark.read.text(f"{tmp_path}/labels").first().value == '["RENT","SUPERMARKET","TRAVEL"]'


def test_out_of_fold_predictions_come_from_other_folds(spark):
    rows = _three_kinds(spark)
    got = learning.out_of_fold(rows, "id", most=3).collect()
    assert sorted(r.id for r in got) == list(range(45)) and {r.fold for r in got} == {0, 1, 2}
    fold = {r.id: r.fold for r in learning.folds(rows, "id", most=3).collect()}
    assert all(fold[r.id] == r.fold for r in got)
    folded = learning.folds(rows, "id", most=3)
    by_hand = learning.predictions(learning.train(folded.where("fold <> 1").drop("fold")), folded.where("fold = 1"), "id").collect()
    assert {(r.id, r.predicted, round(r.confidence, 9)) for r in got if r.fold == 1} == {(r.id, r.predicted, round(r.confidence, 9)) for r in by_hand}


def test_split_of_labels(spark, tmp_path):
    rows = _three_kinds(spark)
    held = learning.split(rows, "id").groupBy("label").agg(F.count_if("held_out").alias("n")).collect()
    assert {r.n for r in held} == {3}
    single = rows.unionByName(spark.createDataFrame([(99, "x", "ALONE")], rows.schema))
    assert 0 < learning.split(single, "id").where("held_out").count() < 25
    learning.write_errors(spark.createDataFrame([("a", "b", 0.5), ("a", "a", 0.9), ("b", "a", 0.7)], "label string, predicted string, confidence double"), str(tmp_path / "e"))
    assert [r.confidence for r in spark.read.csv(str(tmp_path / "e"), header=True).collect()] == ["0.7", "0.5"]


def test_softmax_of_a_given_model(spark):
    weights = spark.createDataFrame([(1, "rewe", 1.0), (2, "none", 1.0)], "id int, term string, weight double")
    coefficients = spark.createDataFrame([("rewe", "A", 2.0), ("rewe", "B", -1.0)], "term string, label string, value double")
    got = {r.id: (r.label, r.probability) for r in learning.softmax_scores(weights, "id", coefficients, spark.createDataFrame([("A", 0.0), ("B", 0.5)], "label string, value double")).collect()}
    assert got[1] == ("A", pytest.approx(1 / (1 + 2.718281828459045**-2.5), abs=1e-9)) and got[2][0] == "B"


@pytest.mark.parametrize(
    ("description", "cents", "found"),
    [
        ("REWE Köln 12345 GmbH ARN123", -1200, "hint_supermarket amount_expense amount_small amount_grocery_plausible rewe koeln"),
        ("VISA Netflix Kaufumsatz 3", -2000, "netflix netflix hint_transport hint_subscription amount_expense amount_meal_range netflix"),
        (None, 0, "amount_zero amount_micro"),
    ],
)
def test_feature_text(spark, description, cents, found):
    row = spark.createDataFrame([(description, None, cents / 100)], "description string, counterparty_name string, amount double")
    assert learning.with_feature_text(row).first().feature_text == found


def test_runs_of_words(spark):
    assert [one(spark, learning.ngrams(F.lit(words).cast("array<string>"), 3))[0] for words in (["a", "b", "c"], ["a"], [])] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_an_upsert_has_no_large_groups(spark):
    kinds = "k string, v map<string,int>, n long"
    got = store.upsert(spark.createDataFrame([("a", {"x": 1}, 1), ("b", None, None), ("c", {"x": 7}, 9)], kinds), spark.createDataFrame([("a", {"x": 2}, 2), ("c", {"x": 8}, 8)], kinds), "k", "n")
    assert sorted((r.k, r.v, r.n) for r in got.collect()) == [("a", {"x": 2}, 2), ("b", None, None), ("c", {"x": 7}, 9)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_model_is_joined_to_pairs_of_texts(spark):
    rows = spark.createDataFrame([(1, 5, "shop", "hot rod")], "id long, amount_cents long, counterparty_name string, description string")
    model = rows.select("description", "counterparty_name", F.lit("EDUCATION").alias("label"), F.lit(0.5).alias("probability"))
    tree = categorize.categorize(rows, *categorize._given(spark), model, "BALANCED")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(tree) if "Join" in line)
    left = [i for i in range(top + 1, len(tree)) if tree[i].lstrip().startswith(":-")][0]
    right = next(i for i in range(left + 1, len(tree)) if tree[i].index("-") == tree[left].index("-") and tree[i].lstrip().startswith("+-"))
    assert not any("Join" in line for line in tree[left:right])  # a transaction is joined once


def test_what_arrives_is_not_gathered_in_one_task(spark, tmp_path, monkeypatch):
    from tallyforge.streaming import imports

    monkeypatch.setattr(imports, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        imports.incremental_import(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list(tmp_path.glob("imports/in/*.parquet"))) > 2


def test_terms_are_made_once_and_never_broadcast(spark):
    rows = spark.createDataFrame([(1, "ab cd ab"), (1, "cd"), (2, "ab"), (3, None)], "id long, text string")
    found = learning.tfidf(rows, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "HashJoin" not in plan  # of few rows all terms were broadcast
    idf = {"ab": math.log(5 / 3) + 1} | dict.fromkeys(("cd", "ab cd", "cd ab", "ab cd ab"), math.log(5 / 2) + 1)
    raw = {t: (1 + math.log(2 if t in ("ab", "cd") else 1)) * x for t, x in idf.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    got = {(r.id, r.term): r.weight for r in found.collect()}
    assert got == pytest.approx({(2, "ab"): 1.0} | {(1, t): x / norm for t, x in raw.items()})
