"""Categories of transactions: overrides, keywords, rules, and the learned fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import categories, references, signals, text
from tallyforge.operators.merchants import KEYWORD_TABLE, KEYWORDS, OWN_ALIASES, alias_table, any_of, keyword_matches, lookup_sql, merchant_categories, merchant_index, merchant_list
from tallyforge.plans import views
from tallyforge.plans.catalog import query


def with_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rows`` with ``override`` and ``custom_id``: of the counterparty's pattern, else of both texts', else of the merchant's token.

    ``overrides`` hold a ``pattern`` once each, and a ``category_name`` that is a category or ``custom:<id>``.
    """
    keys = {"primary": text.normalize_light("counterparty_name"), "full": text.normalize_light(F.concat_ws(" ", "description", "counterparty_name")), "token": text.merchant_token("counterparty_name")}
    out = rows.withColumns({f"key_{k}": c for k, c in keys.items()})
    for k in keys:
        known = overrides.select(F.col("pattern").alias(f"key_{k}"), F.col("category_name").alias(f"by_{k}"))
        if k == "token":
            known = known.where(F.length(f"key_{k}") >= 4)
        out = out.join(known, f"key_{k}", "left")
    name = F.coalesce("by_primary", "by_full", "by_token")
    custom = F.regexp_extract(name, r"^custom:(\d+)$", 1)
    out = out.withColumns({"override": F.when(~name.startswith("custom:"), name), "custom_id": F.nullif(custom, F.lit("")).cast("long")})
    return out.select(*rows.columns, "override", "custom_id")


_RULES = [f"WHEN {any_of('x', parts)} THEN '{c}|0.88'" for c, parts in categories.STRONG_TEXT] + [
    f"WHEN {any_of('x', signals.SIGNALS[kind])}{'' if not sign else ' AND amount > 0' if sign > 0 else ' AND amount < 0'} THEN '{c}|{confidence}'" for kind, c, confidence, sign in categories.STRONG_SIGNALS
]


@query(f""", t AS (SELECT doc_id, lower(coalesce(text, '')) AS x, (doc_id % 3 - 1) * doc_id * 100 AS amount FROM documents),
r AS (SELECT doc_id, CASE {' '.join(_RULES)} WHEN amount > 30000 THEN 'SALARY|0.55' WHEN amount > 0 THEN 'REFUND|0.65' ELSE 'OTHER|0.0' END AS r FROM t),
s AS (SELECT doc_id, split_part(r, '|', 1) AS c, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence FROM r)
SELECT doc_id, CASE WHEN confidence >= 0.8 THEN c ELSE 'OTHER' END AS category, confidence, CASE WHEN confidence < 0.8 AND confidence > 0 THEN c END AS suggested FROM s""")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = docs.select("doc_id", categories.cascade(F.col("low"), F.expr("(doc_id % 3 - 1) * doc_id * 100")).alias("found"))
    return found.select("doc_id", categories.gated(F.col("found")).alias("x")).select("doc_id", "x.category", "x.confidence", "x.suggested")


@query(""", k AS (SELECT DISTINCT counterparty_name FROM live), o AS (SELECT DISTINCT counterparty_name AS pattern, CASE WHEN length(counterparty_name) % 2 = 0 THEN 'SHOPPING' ELSE 'custom:' || length(counterparty_name) END AS category_name FROM live WHERE counterparty_name < 'm')
SELECT counterparty_name, CASE WHEN category_name NOT LIKE 'custom:%' THEN category_name END AS override, CAST(CASE WHEN category_name LIKE 'custom:%' THEN substr(category_name, 8) END AS BIGINT) AS custom_id
FROM k LEFT JOIN o ON k.counterparty_name = o.pattern""")
def override_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "counterparty_name").distinct()
    name = F.when(F.length("counterparty_name") % 2 == 0, "SHOPPING").otherwise(F.concat(F.lit("custom:"), F.length("counterparty_name").cast("string")))
    overrides = rows.where("counterparty_name < 'm'").select(F.col("counterparty_name").alias("pattern"), name.alias("category_name"))
    return with_overrides(rows.withColumn("description", F.lit(None).cast("string")), overrides).drop("description")


def categorize(rows: DataFrame, overrides: DataFrame, keywords: DataFrame, merchants: DataFrame | None = None, model: DataFrame | None = None, mode: str = "SAFE") -> DataFrame:
    """``rows`` with the stored ``category``, its ``confidence`` and ``source``, and a ``suggested`` one.

    ``merchants`` is a ``merchant_index``.  ``model`` has a ``label`` and a ``probability`` for pairs of ``description`` and
    ``counterparty_name``, which count as the ``mode`` lets them.  Texts are matched once for each pair of them, not for
    each transaction.
    """
    description, counterparty = F.col("description"), F.col("counterparty_name")
    texts = rows.select("description", "counterparty_name").distinct().withColumn("pair", F.xxhash64(F.struct("description", "counterparty_name")))
    texts = texts.withColumn("whole", references.whole_text(description, counterparty)).withColumn("low", F.lower("whole")).withColumn("kind", references.kind(F.col("low")))
    texts = texts.withColumn("merchant", references.effective_merchant(F.col("kind"), counterparty, F.col("whole")))
    texts = texts.withColumns({"asked": F.coalesce("merchant", "whole"), "hint": references.category_hint(F.col("whole"))})
    texts = texts.withColumn("low", F.lower(F.concat_ws(" ", "merchant", "asked", "description", "counterparty_name")))
    made = F.struct("merchant", "asked", "hint", "low")  # through explode, so that no filter on a join's key is put in terms of all these patterns
    texts = texts.select("description", "counterparty_name", F.explode(F.array(made)).alias("t")).select("description", "counterparty_name", "t.*")
    found = with_overrides(texts, overrides)
    asked = texts.select("asked").distinct()
    by_word = keyword_matches(asked, "asked", "asked", keywords).select("asked", F.col("category").alias("keyword_category"))
    found = found.join(by_word, "asked", "left")
    if merchants is not None:
        named = merchant_categories(texts.where("merchant IS NOT NULL").select("merchant").distinct(), "merchant", "merchant", merchants)
        found = found.join(named.select("merchant", F.col("category").alias("merchant_category")), "merchant", "left")
    else:
        found = found.withColumn("merchant_category", F.lit(None).cast("string"))
    found = found.select(
        description.alias("of_description"), counterparty.alias("of_counterparty"), "low", "override", "merchant_category", "hint", "keyword_category",
        F.when(F.col("merchant").isNotNull(), F.col("keyword_category")).alias("merchant_keyword"),
    )
    same = F.col("description").eqNullSafe(F.col("of_description")) & F.col("counterparty_name").eqNullSafe(F.col("of_counterparty"))
    if model is not None:  # joined to the pairs, of which there are fewer than transactions
        known = model.select(F.col("description").alias("m_description"), F.col("counterparty_name").alias("m_counterparty"), "label", "probability")
        found = found.join(known, F.col("of_description").eqNullSafe(F.col("m_description")) & F.col("of_counterparty").eqNullSafe(F.col("m_counterparty")), "left")
    first = categories.cascade(F.col("low"), F.col("amount_cents"), F.col("override"), F.col("merchant_category"), F.col("keyword_category"), F.col("hint"), F.col("merchant_keyword"))
    say = [] if model is None else ["label", "probability"]
    out = rows.join(found, same).select(*rows.columns, *say, first.alias("first"))  # a column of its own: its rules are planned once
    out = out.select(*rows.columns, *say, categories.gated(F.col("first")).alias("x"))
    if model is not None:
        out = out.select(*rows.columns, categories.with_model(F.col("x"), F.col("label"), F.col("probability"), mode).alias("x"))
    return out.select(*rows.columns, "x.*")


_CASCADE = f"""p AS (SELECT DISTINCT description, counterparty_name FROM live), t AS (SELECT *, coalesce(counterparty_name, description) AS asked FROM p),
n AS (SELECT DISTINCT counterparty_name AS merchant FROM p WHERE counterparty_name IS NOT NULL), {lookup_sql('n', 'merchant', 'merchant')},
kw AS (SELECT asked, category, row_number() OVER (PARTITION BY asked ORDER BY length(keyword) DESC, position) AS place FROM (SELECT DISTINCT asked FROM t) JOIN {KEYWORD_TABLE} ON contains(' ' || asked || ' ', ' ' || keyword || ' ')),
b AS (SELECT t.*, f.category AS m, kw.category AS k FROM t LEFT JOIN found f ON f.merchant = t.counterparty_name LEFT JOIN kw ON kw.asked = t.asked AND kw.place = 1),
c AS (SELECT l.id, l.amount_cents, CASE WHEN b.counterparty_name = 'small rod' THEN 'TAXES|1.0|USER_OVERRIDE' WHEN m IS NOT NULL THEN m || '|0.9|MERCHANT' WHEN b.counterparty_name IS NOT NULL AND k IS NOT NULL THEN k || '|0.82|KEYWORD'
  WHEN k IS NOT NULL THEN k || '|0.75|KEYWORD' WHEN amount_cents > 30000 THEN 'SALARY|0.55|SIGNAL_RULE' WHEN amount_cents > 0 THEN 'REFUND|0.65|SIGNAL_RULE' ELSE 'OTHER|0.0|UNKNOWN' END AS r
  FROM live l JOIN b ON l.description = b.description AND l.counterparty_name IS NOT DISTINCT FROM b.counterparty_name),
s AS (SELECT id, amount_cents, split_part(r, '|', 1) AS c, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence, split_part(r, '|', 3) AS source FROM c),
g AS (SELECT id, amount_cents, CASE WHEN confidence >= 0.8 THEN c ELSE 'OTHER' END AS category, confidence, source, CASE WHEN confidence < 0.8 AND source <> 'UNKNOWN' THEN c END AS suggested FROM s)"""


def _given(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    keywords = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(KEYWORDS)], "position int, category string, keyword string")
    overrides = spark.createDataFrame([("small rod", "TAXES")], "pattern string, category_name string")
    return overrides, keywords, merchant_index(merchant_list(spark), alias_table(spark, OWN_ALIASES))


@query(f", {_CASCADE} SELECT * FROM g")
def categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of every transaction, with where it comes from."""
    rows = views.transactions(spark, sf_dir, "id", "amount_cents", "counterparty_name", "description")
    return categorize(rows, *_given(spark)).drop("counterparty_name", "description")


@query(f""", {_CASCADE}, l AS (SELECT id, amount_cents, counterparty_name, CASE WHEN length(counterparty_name) % 2 = 0 THEN 'EDUCATION' ELSE 'OTHER' END AS label, CASE WHEN length(counterparty_name) % 3 = 0 THEN 0.25 ELSE 0.5 END AS p FROM live)
SELECT g.id, g.amount_cents, CASE WHEN ask AND p >= 0.3 THEN label ELSE category END AS category, CASE WHEN ask AND p >= 0.3 THEN p ELSE confidence END AS confidence, CASE WHEN ask AND p >= 0.3 THEN 'ML' ELSE source END AS source,
CASE WHEN ask THEN CASE WHEN p < 0.3 THEN label END ELSE suggested END AS suggested
FROM (SELECT g.*, l.label, CAST(l.p AS DOUBLE) AS p, coalesce(g.category = 'OTHER' AND l.label = 'EDUCATION', false) AS ask FROM g JOIN l ON g.id = l.id AND g.amount_cents = l.amount_cents) g""")
def categorized_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a model's say; here the model goes by the length of the counterparty's name."""
    rows = views.transactions(spark, sf_dir, "id", "amount_cents", "counterparty_name", "description")
    size = F.length("counterparty_name")
    model = rows.select("description", "counterparty_name").distinct().where("counterparty_name IS NOT NULL").select("*", F.when(size % 2 == 0, "EDUCATION").otherwise("OTHER").alias("label"), F.when(size % 3 == 0, 0.25).otherwise(0.5).alias("probability"))
    return categorize(rows, *_given(spark), model, "BALANCED").drop("counterparty_name", "description")


def backfill(rows: DataFrame, *given: DataFrame) -> DataFrame:
    """``id`` and the ``new_category`` of live transactions that have no category yet."""
    return categorize(rows.where(F.trim(F.coalesce("auto_category", F.lit(""))) == ""), *given).select("id", F.col("category").alias("new_category"))


# Names that no restaurant has.
SUPERMARKETS = ["lidl", "rewe", "edeka", "aldi", "penny", "netto", "kaufland"]


def repair_supermarkets(rows: DataFrame, *given: DataFrame, wrong: str = "RESTAURANT", brands: list[str] = SUPERMARKETS) -> DataFrame:
    """``id`` and ``new_category`` of transactions of the ``wrong`` category with a brand's name as a word, where the rules now say otherwise."""
    words = F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "description", "counterparty_name")), "[^a-z0-9äöüß]", " "), " +")
    again = categorize(rows.where((F.col("auto_category") == wrong) & F.arrays_overlap(words, F.array(*map(F.lit, brands)))), *given)
    return again.where("category <> auto_category").select("id", F.col("category").alias("new_category"))


@query(f", {_CASCADE} SELECT g.id, g.category AS new_category FROM g JOIN (SELECT id, amount_cents FROM live WHERE auto_category IS NULL) l ON g.id = l.id AND g.amount_cents = l.amount_cents")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "amount_cents", "counterparty_name", "description", "auto_category")
    return backfill(rows, *_given(spark))


@query(f""", {_CASCADE} SELECT g.id, g.category AS new_category FROM g JOIN (SELECT id, amount_cents FROM live WHERE auto_category = 'ECONOMY' AND (list_has_any(string_split(counterparty_name, ' '), ['ring', 'gear']) OR list_has_any(string_split(description, ' '), ['ring', 'gear']))) l
ON g.id = l.id AND g.amount_cents = l.amount_cents""")
def repaired_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "amount_cents", "counterparty_name", "description", "auto_category")
    return repair_supermarkets(rows, *_given(spark), wrong="ECONOMY", brands=["ring", "gear"])


def recategorize_like(rows: DataFrame, description: str, counterparty: str | None, category: str) -> DataFrame:
    """``rows`` where all that have the match key of the given texts get the category."""
    key = references.match_key(F.lit(counterparty).cast("string"), F.lit(description))
    same = references.match_key(F.col("counterparty_name"), F.col("description")) == key
    return rows.withColumn("auto_category", F.when(same, category).otherwise(F.col("auto_category")))


@query("SELECT id, amount_cents, CASE WHEN coalesce(counterparty_name, lower(replace(description, '#', ' '))) = 'hot rod' THEN 'TAXES' ELSE auto_category END AS auto_category FROM live")
def bulk_recategorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "amount_cents", "counterparty_name", "description", "auto_category")
    return recategorize_like(rows, "anything", "HOT, rod", "TAXES").select("id", "amount_cents", "auto_category")
