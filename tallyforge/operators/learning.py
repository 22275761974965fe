"""The learned fallback: features of a transaction's text, TF-IDF, scoring, training and evaluation."""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.references import VISA, found
from tallyforge.functions.text import TORN, contains_any, repaired
from tallyforge.plans import views
from tallyforge.plans.catalog import query
from tallyforge.operators.weighting import Plus, Sublinear

# Hints, and the parts of texts that speak for them.
HINTS = [
    ("hint_transport", ["flix", "db vertrieb", "deutsche bahn", "bvg", "bahn", "logpay"]),
    ("hint_supermarket", ["flaschenpost", "rewe", "lidl", "aldi", "edeka", "kaufland", "netto", "penny", "alnatura", "bio company", "reformhaus", "go asia"]),
    ("hint_restaurant", ["backerei", "baeckerei", "bakery", "coffee", "cafe", "bistro", "gastro", "food", "drei koche", "sironi", "burger", "pizza", "sushi", "takeaway", "zeit fuer brot", "kame", "dashi", "ice cr"]),
    ("hint_shopping", ["dm drogerie", "drogerie", "rossmann", "muji", "bauhaus", "ikea", "ebay", "amazon"]),
    ("hint_subscription", ["apple services", "youtube premium", "google one", "spotify", "netflix", "lagoa yoga"]),
    ("hint_entertainment", ["cinemaxx", "movietainment", "ticket messe", "fienta", "myjump", "therme"]),
    ("hint_travel", ["hotel", "booking", "airbnb", "flight", "flug", "lufthansa", "easyjet", "ryanair"]),
    ("hint_transfer", ["atm", "geldautomat", "abhebung", "auszahlung", "money transfer", "klarna"]),
    ("hint_rent", ["miete", "hausverwaltung", "strom", "telekom", "enstroga", "gehag", "rundfunk"]),
    ("hint_insurance", ["versicherung", "krankenversicherung", "generali", "astra"]),
    ("hint_salary", ["gehalt", "rente", "bundeskasse", "bezuege"]),
]
# Upper bounds of amounts in units, and their words.
BANDS = [(5, "amount_micro"), (15, "amount_small"), (35, "amount_meal_range"), (100, "amount_medium"), (500, "amount_large")]
TERM = r"[\p{L}\p{N}_]{2,}"
# Words that say nothing of a category, and legal forms.
BANK_NOISE = [
    "lastschrift", "basislastschrift", "einzug", "ueberweisung", "überweisung", "sepa", "svwz", "mref", "eref", "kref", "mandat", "referenz", "iban", "bic", "konto", "girokonto", "kontoauszug",
    "buchungstag", "valuta", "wertstellung", "betrag", "saldo", "neuer", "alter", "kunden", "information", "seite", "nummer", "nr", "xxxx", "arn", "visa", "mastercard", "girocard", "debitk", "kaufumsatz",
    "zahlung", "bezahlung", "rechnung", "abbuchung", "gutschrift", "entgelt", "gebühr", "gebuehr", "kundennummer", "kartenzahlung", "sagt", "danke", "paypal", "europe", "cie", "pp", "uhr", "kurs", "de",
    "nrxxxx", "januar", "februar", "maerz", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember",
]
LEGAL = ["gmbh", "ag", "kg", "ohg", "ug", "se", "inc", "ltd", "llc", "bv", "ab", "as", "sarl", "sca", "co", "et"]
# Torn words that the model's texts are mended of besides.
MORE_TORN = [(r"(?i)movietainm\s+ent", "movietainment"), (r"(?i)icketing", "ticketing"), (r"(?i)krankenversich\s+erung", "krankenversicherung")]
# Names of labels.
LABELS = {
    "rent & utilities": "RENT", "rent": "RENT", "housing": "RENT", "transport": "TRANSPORT", "supermarket": "SUPERMARKET", "groceries": "SUPERMARKET", "restaurant": "RESTAURANT", "shopping": "SHOPPING",
    "health": "HEALTH", "insurance": "INSURANCE", "entertainment": "ENTERTAINMENT", "subscriptions": "SUBSCRIPTIONS", "subscription": "SUBSCRIPTIONS", "investment": "INVESTMENT", "travel": "TRAVEL",
    "salary": "SALARY", "refund": "REFUND", "transfer": "TRANSFER", "education": "EDUCATION", "taxes": "TAXES", "tax": "TAXES", "other": "OTHER",
}
# Words in a text, bounds of an amount, and the word that both together give.
PLAUSIBLE = [
    (["restaurant", "gastro", "food", "coffee", "cafe", "bistro", "backerei", "baeckerei", "bakery"], 5, 80, "amount_restaurant_plausible"),
    (["restaurant", "gastro", "food", "coffee", "cafe", "bistro", "backerei", "baeckerei", "bakery"], 100.000001, None, "amount_restaurant_high"),
    (["hotel", "booking", "airbnb", "flight", "flug", "lufthansa", "easyjet", "ryanair"], 80, None, "amount_travel_plausible"),
    (["aldi", "lidl", "rewe", "edeka", "kaufland", "netto", "penny", "flaschenpost", "reformhaus", "go asia"], 1, 250, "amount_grocery_plausible"),
    (["strom", "telekom", "miete", "gehag", "enstroga", "rundfunk", "hausverwaltung"], 20, None, "amount_rent_utilities_plausible"),
]
# Names of merchants in texts of a payment service and of cards.
PAYPAL_NAMES = [
    r"(?i)i\s*hr\s+einkauf\s+b\s*ei\s+(.+?)(?:\s+mandat:|\s+referenz:|/abbuchung|\s+awv-meldepflicht|\s+mref\+|\s+eref\+|$)",
    r"(?i)/\.?\s*([^/]+?),\s*i\s*hr\s+einkauf",
    r"(?i)svwz\+.*?\.\s*([^,]+?),\s*i\s*hr\s+einkauf",
]
CARD_NAME = r"(?i)(?:debitkartenzahlung|kartenzahlung|lastschrift\s+aus\s+kartenzahlung)?\s*([A-ZÄÖÜ0-9 .&'\-]+?)//[A-ZÄÖÜa-zäöüß .\-]+/DE"
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
SCRAPS = (r"(?i)arn\w+", r"\b\w*gkka\w*\b", r"\b\d{1,2}\.\d{1,2}(?:\.\d{2,4})?\b", r"\b\d+[,.]\d+\b", r"\b\d{3,}\b", r"[^a-z0-9 ]+")


def clean(c: Column) -> Column:
    """Lower case with umlauts spelled out, without references, dates, long numbers, noise and single letters."""
    x = F.lower(repaired(F.coalesce(c, F.lit("")), [*TORN, *MORE_TORN]))
    for letter, spelled in UMLAUTS:
        x = F.replace(x, F.lit(letter), F.lit(spelled))
    for pattern in SCRAPS:
        x = F.regexp_replace(x, pattern, " ")
    stop = F.array(*map(F.lit, sorted({*BANK_NOISE, *LEGAL})))
    return F.array_join(F.filter(F.split(x, r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), " ")


def merchant_name(text: Column) -> Column:
    """The merchant that a text of a payment service or of a card names, as it stands there; else null."""
    service = F.lower(text).contains("paypal")
    return F.coalesce(*(F.when(service, found(text, p)) for p in PAYPAL_NAMES), found(text, VISA), found(text, CARD_NAME))


def amount_words(amount: Column, text: Column | None = None) -> Column:
    """The sign and the size of an amount, and what makes it plausible for the words of ``text``."""
    size = F.abs(amount)
    band = F.lit("amount_very_large")
    for most, word in reversed(BANDS):
        band = F.when(size < most, word).otherwise(band)
    plausible = [] if text is None else [F.when(contains_any(text, parts) & (size >= lo) & (F.lit(True) if hi is None else size <= hi), word) for parts, lo, hi, word in PLAUSIBLE]
    return F.concat_ws(" ", F.when(amount > 0, "amount_income").when(amount < 0, "amount_expense").otherwise("amount_zero"), band, *plausible)


def with_feature_text(rows: DataFrame, description: str = "description", counterparty: str = "counterparty_name", amount: str = "amount") -> DataFrame:
    """``rows`` with ``feature_text``: the merchant twice, hints, words of the amount, and the clean text.

    The parts are columns of their own on the way, so that each is made once.
    """
    made = rows.withColumn("f_text", F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(counterparty, F.lit(""))))
    made = made.withColumn("f_merchant", F.nullif(clean(merchant_name(F.col("f_text"))), F.lit(""))).withColumn("f_clean", clean(F.col("f_text")))
    made = made.withColumn("f_source", F.concat_ws(" ", "f_merchant", "f_clean"))
    hints = F.concat_ws(" ", *(F.when(contains_any("f_source", parts), hint) for hint, parts in HINTS))
    words = amount_words(F.coalesce(F.col(amount), F.lit(0.0)), F.col("f_source"))
    whole = F.concat_ws(" ", "f_merchant", "f_merchant", F.nullif(hints, F.lit("")), words, F.nullif(F.col("f_clean"), F.lit("")))
    return made.withColumn("feature_text", whole).select(*rows.columns, "feature_text")


def label_of(name: Column) -> Column:
    """The category that a label's name stands for, else the name in capitals."""
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), F.replace(F.upper(F.trim(name)), F.lit(" "), F.lit("_")))


def load_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Rows of delimited files with a header, which has to name ExpectedCategory and Description; with ``label`` and ``feature_text``."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for needed in ("ExpectedCategory", "Description"):
        if needed not in rows.columns:
            raise ValueError(f"the file has no column {needed}; its columns are {rows.columns}")
    for c in ("Counterparty", "Amount"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    return labelled(rows)


def labelled(rows: DataFrame) -> DataFrame:
    """Rows (``Description``, ``Counterparty``, ``Amount``, ``ExpectedCategory``) with ``label`` and ``feature_text``; blank ones are left out."""
    rows = rows.withColumns({"amount": F.coalesce(F.col("Amount").try_cast("double"), F.lit(0.0)), "label": label_of(F.col("ExpectedCategory"))})
    return with_feature_text(rows, "Description", "Counterparty", "amount").where("label <> '' AND feature_text <> ''")


def _sql_clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for pattern, word in [*TORN, *MORE_TORN]:
        x = f"regexp_replace({x}, '{pattern}', '{word}', 'g')"
    x = f"lower({x})"
    for letter, spelled in UMLAUTS:
        x = f"replace({x}, '{letter}', '{spelled}')"
    for pattern in SCRAPS:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    stop = "[" + ", ".join(f"'{w}'" for w in sorted({*BANK_NOISE, *LEGAL})) + "]"
    return f"array_to_string(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({stop}, w)), ' ')"


def _any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_NAMED = ", ".join([*(f"CASE WHEN contains(lower(f_text), 'paypal') THEN nullif(trim(regexp_extract(f_text, '{p}', 1)), '') END" for p in PAYPAL_NAMES), *("nullif(trim(regexp_extract(f_text, '{}', 1)), '')".format(p.replace("'", "''")) for p in (VISA, CARD_NAME))])
_BAND = " ".join(f"WHEN abs(amount) < {most} THEN '{word}'" for most, word in BANDS)
_AMOUNT = f"CASE WHEN amount > 0 THEN 'amount_income' WHEN amount < 0 THEN 'amount_expense' ELSE 'amount_zero' END, CASE {_BAND} ELSE 'amount_very_large' END"
_PLAUSIBLE = ", ".join(f"CASE WHEN {_any('f_source', parts)} AND abs(amount) >= {lo}{'' if hi is None else f' AND abs(amount) <= {hi}'} THEN '{word}' END" for parts, lo, hi, word in PLAUSIBLE)
_HINTED = ", ".join(f"CASE WHEN {_any('f_source', parts)} THEN '{hint}' END" for hint, parts in HINTS)


@query(f""", r AS (SELECT id, concat_ws(' ', description, coalesce(counterparty, '')) AS f_text, (CAST(split_part(id, '#', 2) AS BIGINT) - 5) * 17.5 AS amount FROM bank_texts),
m AS (SELECT *, {_sql_clean(f"coalesce({_NAMED})")} AS f_merchant, {_sql_clean('f_text')} AS f_clean FROM r), s AS (SELECT *, concat_ws(' ', nullif(f_merchant, ''), f_clean) AS f_source FROM m)
SELECT id, concat_ws(' ', nullif(f_merchant, ''), nullif(f_merchant, ''), nullif(concat_ws(' ', {_HINTED}), ''), {_AMOUNT}, {_PLAUSIBLE}, nullif(f_clean, '')) AS feature_text FROM s""")
def feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model reads of each text."""
    rows = views.bank_texts(spark, sf_dir).withColumn("amount", (F.element_at(F.split("id", "#"), -1).cast("long") - 5) * 17.5)
    return with_feature_text(rows, "description", "counterparty").select("id", "feature_text")


@query(f""", t AS (SELECT DISTINCT CAST(amount_cents AS DOUBLE) / 100 AS amount FROM live) SELECT amount, concat_ws(' ', {_AMOUNT}) AS words FROM t""")
def amount_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "amount_cents").distinct().select((F.col("amount_cents") / 100).alias("amount"))
    return rows.select("amount", amount_words(F.col("amount")).alias("words"))


@query("""SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN ' ' || upper(name) || ' ' ELSE name END AS name, label FROM (
  SELECT p_size, coalesce({0}[1 + p_partkey % {2}], p_type) AS name, coalesce({1}[1 + p_partkey % {2}], upper(p_type)) AS label FROM part)""".format([*LABELS], [*LABELS.values()], len(LABELS) + 3))
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of labels as people write them, known ones and others, and the categories that they stand for."""
    known = F.get(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % (len(LABELS) + 3)).cast("int"))
    name = F.coalesce(known, "p_type")
    names = views.read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).otherwise(name).alias("name")).distinct()
    return names.select("name", label_of(F.col("name")).alias("label"))


def ngrams(words: Column, most: int) -> Column:
    """All runs of one to ``most`` words of an array, joined by a space."""
    n = F.size(words)

    def runs(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(n >= k, each).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*(runs(k) for k in range(1, most + 1))))


def term_weights(rows: DataFrame, key: str, words: str, most: int = 3) -> DataFrame:
    """``key``, ``term``, ``raw``: sublinear counts times smoothed idf, not yet of length 1.

    Rows are dealt by term before they are counted, so terms are made and shuffled once, and those of a term are counted where they
    meet.  A join with the terms' idf would shuffle them again, and Spark, which takes exploded rows to be as few as their input, broadcast it.
    """
    tokens = rows.select(key, F.regexp_extract_all(F.lower(words), F.lit(TERM), F.lit(0)).alias("words")).select(key, F.explode(ngrams(F.col("words"), most)).alias("term"))
    counts = tokens.repartition("term").groupBy("term", key).agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("n"))  # one row
    often = counts.withColumn("df", F.count("*").over(Window.partitionBy("term"))).join(F.broadcast(n))
    return often.select(key, "term", ((1 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)).alias("raw"))


def tfidf(rows: DataFrame, key: str, words: str, most: int = 3) -> DataFrame:
    """``key``, ``term``, ``weight``: sublinear counts times smoothed idf, of length 1 for each key.

    Terms are runs of one to ``most`` words; a word has two letters, digits or underscores at least.
    """
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return term_weights(rows, key, words, most).select(key, "term", (F.col("raw") / norm).alias("weight"))


@query(r""", s AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM conversations),
t AS (SELECT id, unnest(w) AS term FROM s UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM s UNION ALL SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM s),
c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT id, c.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM conversations)) / (1.0 + df)) + 1) AS raw FROM c JOIN d USING (term))
SELECT id, count(*) AS terms, round(max(raw / s), 6) AS heaviest FROM (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS s FROM w) GROUP BY 1""")
def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")))
    return term_weights(rows, "id", "text").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("raw") / norm, 6).alias("heaviest"))


def softmax_scores(weights: DataFrame, key: str, coefficients: DataFrame, intercepts: DataFrame) -> DataFrame:
    """``key``, ``label`` and ``probability`` of the likeliest label of a linear model.

    ``coefficients``: ``term``, ``label``, ``value``; ``intercepts``: ``label``, ``value`` (a row a label).
    """
    labels = [(r["label"], r["value"]) for r in intercepts.collect()]
    wide = coefficients.groupBy("term").agg(*(F.sum(F.when(F.col("label") == name, F.col("value")).otherwise(0.0)).alias(f"c{i}") for i, (name, _) in enumerate(labels)))
    sums = weights.join(wide, "term", "left").groupBy(key).agg(*(F.coalesce(F.sum(F.col("weight") * F.col(f"c{i}")), F.lit(0.0)).alias(f"z{i}") for i in range(len(labels))))
    z = [F.col(f"z{i}") + b for i, (_, b) in enumerate(labels)]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    label = F.coalesce(*(F.when(x == top, name) for x, (name, _) in zip(z, labels, strict=True)))
    return sums.select(key, label.alias("label"), (1 / sum((F.exp(x - top) for x in z), F.lit(0.0))).alias("probability"))


def train(rows: DataFrame, vocabulary: int = 12_000, regularization: float = 0.5) -> PipelineModel:
    """TF-IDF of runs of one to three words and multinomial logistic regression on ``feature_text`` and ``label``, classes weighted to equal shares.

    The weights of terms are those of ``tfidf`` and ``classify``: sublinear counts times smoothed idf, of length 1.  The ``vocabulary`` most
    frequent terms count.  The model adds its columns on the way as ``model_...``.
    """
    shares = rows.groupBy("label").agg(F.count("*").alias("n"))
    total, kinds = rows.count(), shares.count()
    weighed = rows.join(F.broadcast(shares) if kinds <= 10_000 else shares, "label").withColumn("class_weight", F.lit(total / max(kinds, 1)) / F.col("n"))
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            RegexTokenizer(inputCol="feature_text", outputCol="model_words", pattern=TERM, gaps=False),
            *(NGram(n=k, inputCol="model_words", outputCol=f"model_runs_{k}") for k in (1, 2, 3)),
            SQLTransformer(statement="SELECT *, concat(model_runs_1, model_runs_2, model_runs_3) AS model_terms FROM __THIS__"),
            CountVectorizer(inputCol="model_terms", outputCol="model_counts", vocabSize=vocabulary),
            Sublinear(inputCol="model_counts", outputCol="model_tf"),
            IDF(inputCol="model_tf", outputCol="model_idf"),
            Plus(inputCols=["model_tf", "model_idf"], outputCol="model_weights"),  # tf * idf + tf: the idf gets one more
            Normalizer(inputCol="model_weights", outputCol="features"),
            LogisticRegression(labelCol="label_index", featuresCol="features", weightCol="class_weight", family="multinomial", regParam=regularization / max(total, 1), maxIter=100, standardization=False),
        ]
    ).fit(weighed.drop("n"))


def _drawn(key: str) -> list[Column]:
    """An order by chance that is the same in every run."""
    return [F.md5(F.col(key).cast("string").cast("binary")), F.col(key)]


def folds(rows: DataFrame, key: str, label: str = "label", most: int = 5) -> DataFrame:
    """``rows`` with a stratified ``fold``: by label, in the order of a digest of the key."""
    smallest = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    k = min(most, smallest)
    if k < 2:
        raise ValueError("each label needs two rows at least")
    return rows.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(*_drawn(key))), F.lit(k)))


def split(rows: DataFrame, key: str, label: str = "label", share: float = 0.2) -> DataFrame:
    """``rows`` with ``held_out``, true for ``share`` of the rows of each label; if a label has one row only, for about ``share`` of all rows.

    Which rows these are depends on a digest of the key, so every run holds out the same.
    """
    own = Window.partitionBy(label)
    numbered = rows.withColumns({"of_label": F.count("*").over(own), "place": F.row_number().over(own.orderBy(*_drawn(key)))})
    if rows.groupBy(label).count().where("count < 2").isEmpty():
        held = F.col("place") <= F.floor(F.col("of_label") * share + 0.5)
    else:
        held = F.conv(F.substring(_drawn(key)[0], 1, 13), 16, 10).cast("double") / float(1 << 52) < share
    return numbered.withColumn("held_out", held).drop("of_label", "place")


def predictions(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``label``, ``predicted`` and ``confidence`` of rows that ``train``'s model reads."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(rows.withColumn("class_weight", F.lit(1.0))).select(key, "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def out_of_fold(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """``predictions`` with ``fold`` of every row, each by a model that is trained on the other folds."""
    folded = folds(rows, key, most=most)
    k = folded.agg(F.max("fold")).first()[0] + 1  # up to ``most`` models
    parts = [predictions(train(folded.where(F.col("fold") != i).drop("fold")), folded.where(F.col("fold") == i), key).withColumn("fold", F.lit(i)) for i in range(k)]
    return functools.reduce(DataFrame.unionByName, parts)


_GRADED = ", g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS label FROM labels)"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("plain").alias("label"))


@query(_GRADED + " SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY label) * CAST(0.2 AS DOUBLE) + 0.5) AS held_out FROM g")
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(_graded(spark, sf_dir), "doc_id")


@query(_GRADED + ", k AS (SELECT least(5, min(n)) AS k FROM (SELECT count(*) AS n FROM g GROUP BY label)) SELECT doc_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) % k AS INTEGER) AS fold FROM g, k")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds(_graded(spark, sf_dir), "doc_id")


def coverage(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: share of rows of that confidence, and how many of them are right.  One pass, one row a threshold."""
    right = F.col("label") == F.col("predicted")
    sums = scored.agg(F.count("*").alias("n"), *(f for i, t in enumerate(thresholds) for f in (F.count_if(F.col("confidence") >= t).alias(f"in{i}"), F.count_if((F.col("confidence") >= t) & right).alias(f"ok{i}"))))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"in{i}").alias("covered"), F.col(f"ok{i}").alias("correct"), F.col("n")) for i, t in enumerate(thresholds)))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


_SCORED = ", s AS (SELECT quality AS label, CAST(n_chars > 500 AS INTEGER) AS predicted, CAST(n_chars AS DOUBLE) / (n_chars + 500) AS confidence FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(views.read(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("predicted"), (F.col("n_chars") / (F.col("n_chars") + 500)).alias("confidence"))


@query(_SCORED + " SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (confidence >= t) AS covered, count(*) FILTER (confidence >= t AND label = predicted) AS correct, count(*) AS n FROM s, (VALUES (0.25), (0.5), (0.75)) AS v(t) GROUP BY t")
def threshold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(_scored(spark, sf_dir), [0.25, 0.5, 0.75])


def report(scored: DataFrame) -> DataFrame:
    """Counts by label: rows of it, predictions of it, and right ones (precision, recall and F1 follow from them)."""
    each = scored.select(F.explode(F.array(F.struct(F.col("label").alias("k"), F.lit(1).alias("is"), F.lit(0).alias("says")), F.struct(F.col("predicted").alias("k"), F.lit(0).alias("is"), F.lit(1).alias("says")))).alias("x"), (F.col("label") == F.col("predicted")).cast("int").alias("right"))
    sums = each.groupBy(F.col("x.k").alias("label")).agg(F.sum("x.is").alias("support"), F.sum("x.says").alias("predicted"), F.sum(F.col("x.is") * F.col("right")).alias("correct"))
    return sums.withColumns({"precision": F.round(F.col("correct") / F.greatest("predicted", F.lit(1)), 6), "recall": F.round(F.col("correct") / F.greatest("support", F.lit(1)), 6)})


@query(_SCORED + """, k AS (SELECT DISTINCT label AS k FROM s UNION SELECT DISTINCT predicted FROM s)
SELECT k AS label, count(*) FILTER (label = k) AS support, count(*) FILTER (predicted = k) AS predicted, count(*) FILTER (label = k AND predicted = k) AS correct,
round(count(*) FILTER (label = k AND predicted = k) / CAST(greatest(count(*) FILTER (predicted = k), 1) AS DOUBLE), 6) AS precision, round(count(*) FILTER (label = k AND predicted = k) / CAST(greatest(count(*) FILTER (label = k), 1) AS DOUBLE), 6) AS recall FROM s, k GROUP BY k""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_scored(spark, sf_dir))


@query(_SCORED + " SELECT label, count(*) AS n FROM s GROUP BY 1")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


MODEL_SCHEMA = "model_version string, labels array<string>, ngram_min int, ngram_max int, sublinear_tf boolean, vocabulary map<string,int>, idf array<double>, intercepts array<double>, coefs array<array<double>>"


def model_row(labels: list[str], terms: DataFrame, coefficients: DataFrame, intercepts: DataFrame, version: str = "1") -> DataFrame:
    """A model as one row of ``MODEL_SCHEMA``, from ``term`` and ``idf``, from ``term``, ``label``, ``value``, and from ``label``, ``value``.

    The row has a number for each term and label, so it is for models of the size that a reader loads whole.
    """
    if len(labels) < 3:
        raise ValueError(f"a model of several classes needs three labels at least, not {len(labels)}")
    placed = terms.withColumn("place", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    names = F.array(*map(F.lit, labels))
    wide = coefficients.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("value"))), F.lit(0.0)).alias(f"c{i}") for i, x in enumerate(labels)))
    rows = placed.join(wide, "term", "left").agg(F.array_sort(F.collect_list(F.struct("place", "term", "idf", *(F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(len(labels)))))).alias("x"))
    base = intercepts.agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("b")).select("b", F.lit(1).alias("one"))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(base), "one").select(
        F.lit(version).alias("model_version"), names.alias("labels"), F.lit(1).alias("ngram_min"), F.lit(3).alias("ngram_max"), F.lit(True).alias("sublinear_tf"),
        F.map_from_arrays(F.col("x.term"), F.col("x.place")).alias("vocabulary"), F.col("x.idf").alias("idf"), F.transform(names, lambda n: F.coalesce(F.try_element_at(F.col("b"), n), F.lit(0.0))).alias("intercepts"),
        F.array(*(F.col(f"x.c{i}") for i in range(len(labels)))).alias("coefs"),
    )


def model_of(model: PipelineModel, version: str = "1") -> DataFrame:
    """What ``train`` has learned as a model of one row, with which ``classify`` computes the same."""
    labels, counted, idf, fitted = model.stages[0].labels, next(x for x in model.stages if hasattr(x, "vocabulary")), next(x for x in model.stages if hasattr(x, "idf")), model.stages[-1]
    spark = SparkSession.getActiveSession()
    terms = spark.createDataFrame([(t, float(x) + 1) for t, x in zip(counted.vocabulary, idf.idf.toArray(), strict=True)], "term string, idf double")
    values = fitted.coefficientMatrix.toArray()
    coefficients = spark.createDataFrame([(t, n, float(v)) for i, n in enumerate(labels) for t, v in zip(counted.vocabulary, values[i], strict=True)], "term string, label string, value double")
    return model_row(list(labels), terms, coefficients, spark.createDataFrame([(n, float(b)) for n, b in zip(labels, fitted.interceptVector.toArray(), strict=True)], "label string, value double"), version)


def save_model(model: DataFrame, path: str) -> None:
    """The model as a line of JSON below ``path``/model, and its labels, in order, as one below ``path``/labels."""
    model_json(model).write.mode("overwrite").text(f"{path}/model")
    model.select(F.to_json(F.array_sort("labels"))).write.mode("overwrite").text(f"{path}/labels")


def model_json(model: DataFrame) -> DataFrame:
    return model.select(F.to_json(F.struct(*model.columns)).alias("value"))


def load_model(lines: DataFrame) -> DataFrame:
    """The models of JSON ``value`` lines; blank and broken ones give no row, and classify nothing."""
    return lines.select(F.from_json("value", MODEL_SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).where("m.labels IS NOT NULL AND size(m.labels) > 0 AND m.vocabulary IS NOT NULL").select("m.*")


def classify(rows: DataFrame, key: str, words: str, model: DataFrame) -> DataFrame:
    """``key``, ``label`` and ``probability`` by a model of one row: the likeliest label, of equal ones the first.

    Texts without a term of the model and labels that are no category, or OTHER, have no row.  The model is broadcast:
    it is one row that its reader holds whole.
    """
    from tallyforge.functions.categories import CATEGORIES

    m = model.limit(1)
    terms = m.select(F.explode("vocabulary").alias("term", "place"), "idf", "coefs").select("term", F.get("idf", F.col("place")).alias("idf"), F.transform("coefs", lambda row: F.get(row, F.col("place"))).alias("by_label"))
    tokens = rows.select(key, F.explode(ngrams(F.regexp_extract_all(F.lower(words), F.lit(TERM), F.lit(0)), 3)).alias("term"))
    counts = tokens.join(F.broadcast(terms.select("term")), "term").groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(terms), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    n_labels = m.select(F.size("labels")).first()
    if n_labels is None:
        return rows.select(key, F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("probability")).limit(0)
    sums = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), *(F.sum(F.col("raw") * F.get("by_label", F.lit(i))).alias(f"z{i}") for i in range(n_labels[0])))
    heads = m.select("labels", "intercepts", F.lit(1).alias("one"))
    z = F.array(*(F.col(f"z{i}") / F.col("norm") + F.get("intercepts", F.lit(i)) for i in range(n_labels[0])))
    scored = sums.withColumn("one", F.lit(1)).join(F.broadcast(heads), "one").withColumn("z", z).withColumn("top", F.array_max("z"))
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    label = F.get("labels", (F.array_position("z", F.col("top")) - 1).cast("int"))
    return scored.select(key, label.alias("label"), (1 / total).alias("probability")).where(F.col("label").isin([c for c in CATEGORIES if c != "OTHER"]))


def errors(scored: DataFrame) -> DataFrame:
    """Rows whose prediction is wrong, the surest first: what an error file holds."""
    return scored.where("label <> predicted").orderBy(F.desc("confidence"))


def write_errors(scored: DataFrame, path: str) -> None:
    """The errors as delimited files with a header below ``path``, the surest first."""
    errors(scored).write.mode("overwrite").option("header", "true").csv(path)


# A small model, as terms with idf and a value for each label.
_LABELS = ["SHOPPING", "TRAVEL", "OTHER"]
_MODEL = [("ring", 1.5, 2.0, 0.0, -1.0), ("hot", 1.0, 0.0, 1.0, 0.5), ("hot ring", 2.0, -3.0, 4.0, 0.0), ("cold", 1.2, 0.1, 0.2, 0.9), ("gear", 1.1, 0.4, 0.4, 0.4)]
_BASE = [0.1, 0.2, 0.0]


def _small_model(spark: SparkSession) -> DataFrame:
    terms = spark.createDataFrame([(t, i) for t, i, *_ in _MODEL], "term string, idf double")
    values = spark.createDataFrame([(t, n, float(v)) for t, _, *vs in _MODEL for n, v in zip(_LABELS, vs, strict=True)], "term string, label string, value double")
    return model_row(_LABELS, terms, values, spark.createDataFrame(list(zip(_LABELS, _BASE, strict=True)), "label string, value double"))


_Z = ", ".join(f"sum(raw * v{i}) / sqrt(sum(raw * raw)) + {b} AS z{i}" for i, b in enumerate(_BASE))


@query(f""", m(term, idf, v0, v1, v2) AS (VALUES {', '.join(map(str, _MODEL))}), s AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part),
t AS (SELECT name, unnest(w) AS term FROM s UNION ALL SELECT name, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM s),
c AS (SELECT name, term, count(*) AS tf FROM t GROUP BY 1, 2), r AS (SELECT name, (1 + ln(tf)) * idf AS raw, v0, v1, v2 FROM c JOIN m USING (term)), z AS (SELECT name, {_Z} FROM r GROUP BY 1),
b AS (SELECT *, greatest(z0, z1, z2) AS top FROM z), l AS (SELECT name, CASE top WHEN z0 THEN 'SHOPPING' WHEN z1 THEN 'TRAVEL' ELSE 'OTHER' END AS label, round(1 / (exp(z0 - top) + exp(z1 - top) + exp(z2 - top)), 9) AS probability FROM b)
SELECT * FROM l WHERE label <> 'OTHER'""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model, written as JSON and read again, on the names of parts."""
    model = load_model(model_json(_small_model(spark)))
    names = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return classify(names, "name", "name", model).select("name", "label", F.round("probability", 9).alias("probability"))


@query(_SCORED + " SELECT label, predicted, round(confidence, 9) AS confidence FROM s WHERE label <> predicted")
def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(_scored(spark, sf_dir)).select("label", "predicted", F.round("confidence", 9).alias("confidence"))
