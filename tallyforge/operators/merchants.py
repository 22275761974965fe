"""Merchants out of noisy text: groups, names, keywords, aliases and fuzzy matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import fuzzy, signals, text, values
from tallyforge.operators.spending import month, spent
from tallyforge.plans import views
from tallyforge.plans.catalog import query

LIGHT = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9äöüß\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in [*text.NOISE, *text.CITIES]) + "]"
_WORDS = (
    r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '" + text.WALLETS + "', ' ', 'g'), '" + text.BRANCHES + "', ' ', 'g'), '" + text.NOT_LIGHT
    + r"', ' ', 'g'), '\b\d+\b', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains(" + _STOP + ", w))"
)
_TOKEN = "list_filter(" + _WORDS + r", lambda w: NOT regexp_full_match(w, '\d+'))[1]"
_KEY = f"coalesce({_TOKEN.format('counterparty_name')}, {_TOKEN.format('description')}, nullif({LIGHT.format('coalesce(counterparty_name, description)')}, ''))"


@query(f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {LIGHT.format('text')} AS x FROM documents)")
def normalize_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = views.read(spark, sf_dir, "documents").select("doc_id", text.normalize_light("text").alias("x"))
    return light.select("doc_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query(f"""SELECT page_id, array_to_string({_WORDS.format("url || ' GmbH Filiale 12 Berlin'")}, ' ') AS words, {_TOKEN.format("url || ' GmbH Filiale 12 Berlin'")} AS token FROM pages""")
def merchant_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat("url", F.lit(" GmbH Filiale 12 Berlin"))
    return views.read(spark, sf_dir, "pages").select("page_id", text.normalize(noisy).alias("words"), text.merchant_token(noisy).alias("token"))


def canonical_groups_of(rows: DataFrame) -> DataFrame:
    """Count, sum and name of each canonical key; the key is found once for each pair of texts.

    The name is the counterparty that occurs most, of equal counts the longer, then the smaller; else the smallest description.
    """
    pairs = rows.groupBy("counterparty_name", "description").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total"))
    keyed = pairs.withColumn("key", text.canonical_key("counterparty_name", "description")).where("key IS NOT NULL")
    names = keyed.groupBy("key", "counterparty_name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("description").alias("description"))
    first = Window.partitionBy("key").orderBy(F.col("counterparty_name").isNull(), F.desc("n"), F.desc(F.length("counterparty_name")), "counterparty_name")
    named = names.withColumn("place", F.row_number().over(first))
    name = F.max(F.when(F.col("place") == 1, F.coalesce("counterparty_name", "description")))
    return named.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), name.alias("display_name"))


@query(f""", k AS (SELECT *, {_KEY} AS key FROM (SELECT counterparty_name, description, count(*) AS n, sum(amount_cents) AS total FROM live GROUP BY 1, 2)),
c AS (SELECT key, counterparty_name, sum(n) AS n, sum(total) AS total, min(description) AS description FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY counterparty_name IS NULL, n DESC, length(counterparty_name) DESC, counterparty_name) AS place FROM c)
SELECT key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total, max(coalesce(counterparty_name, description)) FILTER (place = 1) AS display_name FROM r GROUP BY 1""")
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_groups_of(views.transactions(spark, sf_dir, "counterparty_name", "description", "amount_cents"))


def merchant_groups_of(rows: DataFrame) -> DataFrame:
    """Groups by canonical key, those of one name as one."""
    return canonical_groups_of(rows).groupBy("display_name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(f""", t AS (SELECT id, CASE WHEN i % 2 = 0 THEN counterparty END AS counterparty_name, description, i FROM (SELECT *, CAST(split_part(id, '#', 2) AS BIGINT) AS i FROM bank_texts)),
k AS (SELECT counterparty_name, description, count(*) AS n, sum(i) AS total, {_KEY} AS key FROM t GROUP BY 1, 2),
c AS (SELECT key, counterparty_name, sum(n) AS n, sum(total) AS total, min(description) AS description FROM k WHERE key IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY counterparty_name IS NULL, n DESC, length(counterparty_name) DESC, counterparty_name) AS place FROM c),
g AS (SELECT key, sum(n) AS n, sum(total) AS total, max(coalesce(counterparty_name, description)) FILTER (place = 1) AS display_name FROM r GROUP BY 1)
SELECT display_name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total FROM g GROUP BY 1""")
def merchant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.element_at(F.split("id", "#"), -1).cast("long")
    rows = views.bank_texts(spark, sf_dir).select(F.when(number % 2 == 0, F.col("counterparty")).alias("counterparty_name"), "description", number.alias("amount_cents"))
    return merchant_groups_of(rows)


@query(f""", k AS (SELECT *, {_KEY} AS key FROM live WHERE amount_cents < 0)
SELECT strftime(booking_date, '%Y-%m') AS month, key, CAST(sum(amount_cents) AS BIGINT) AS total, count(*) AS n, min(auto_category) AS auto_category FROM k WHERE auto_category IS NOT NULL GROUP BY 1, 2""")
def merchant_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed by text before the key is found, so that the patterns run once for each text of a month."""
    rows = spent(spark, sf_dir, "booking_date", "counterparty_name", "description")
    sums = rows.groupBy(month(), "counterparty_name", "description").agg(F.sum("amount_cents").alias("total"), F.count("*").alias("n"), F.min("auto_category").alias("auto_category"))
    keyed = sums.withColumn("key", text.canonical_key("counterparty_name", "description"))
    return keyed.groupBy("month", "key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("auto_category").alias("auto_category"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: ('  ' || {0} || ' ')[i:i + 2]))"
_LEVENSHTEIN = "(1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)))"
_JACCARD = f"(CAST(len(list_intersect({_GRAMS.format('a')}, {_GRAMS.format('b')})) AS DOUBLE) / len(list_distinct(list_concat({_GRAMS.format('a')}, {_GRAMS.format('b')}))))"
_PAIRS = f", p AS (SELECT DISTINCT p_name AS name FROM part), x AS (SELECT a.name AS a, b.name AS b FROM p a JOIN p b ON a.name < b.name AND a.name[1] = b.name[1] WHERE least(length(a.name), length(b.name)) >= 0.5 * greatest(length(a.name), length(b.name))), q AS (SELECT * FROM x WHERE greatest({_LEVENSHTEIN}, {_JACCARD}) >= 0.7)"


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names whose similarity is 0.7 or more."""
    names = _names(spark, sf_dir)
    near = fuzzy.near_pairs(names.select(F.col("name").alias("w")), names.select(F.col("name").alias("c"), F.lit(0).alias("p")), 0.7)
    return near.where("w < c").select(F.col("w").alias("a"), F.col("c").alias("b"))


@query(_PAIRS + f" SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance, round({_LEVENSHTEIN}, 6) AS similarity FROM q")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(fuzzy.levenshtein_similarity(a, b), 6).alias("similarity"))


@query(_PAIRS + f" SELECT a, b, round({_JACCARD}, 6) AS similarity FROM q")
def trigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(fuzzy.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f""", p AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, name[1:3] || name[5:] AS typed FROM p),
s AS (SELECT typed, c.name, greatest(1.0 - CAST(levenshtein(typed, c.name) AS DOUBLE) / greatest(length(typed), length(c.name)),
  CAST(len(list_intersect({_GRAMS.format('typed')}, {_GRAMS.format('c.name')})) AS DOUBLE) / len(list_distinct(list_concat({_GRAMS.format('typed')}, {_GRAMS.format('c.name')})))) AS score
  FROM (SELECT DISTINCT typed FROM w) t JOIN p c ON typed[1] = c.name[1] WHERE least(length(typed), length(c.name)) >= greatest(length(typed), length(c.name)) * 0.5),
r AS (SELECT typed, name, row_number() OVER (PARTITION BY typed ORDER BY score DESC, name) AS place FROM s WHERE score >= 0.82)
SELECT w.name, w.typed, r.name AS match FROM w JOIN r ON w.typed = r.typed AND place = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name with its fourth letter left out, and the name that it is most like."""
    names = _names(spark, sf_dir)
    typed = names.withColumn("typed", F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")))
    order = names.withColumn("position", F.row_number().over(Window.partitionBy(F.substring("name", 1, 1)).orderBy("name")))
    return fuzzy.best_match(typed, "typed", order, "name", "position").select("name", "typed", "match")


# A small keyword list of the kind that a user supplies.
KEYWORDS = [("TOYS", "small ring"), ("TOYS", "ring"), ("TOOLS", "anvil"), ("TOOLS", "hot bolt"), ("TOOLS", "bolt"), ("PARTS", "gear"), ("PARTS", "rod"), ("HOME", "plate"), ("HOME", "gizmo"), ("HOME", "blue gizmo")]


def keyword_matches(rows: DataFrame, key: str, words: str, keywords: DataFrame) -> DataFrame:
    """``key`` and the ``category`` of the longest keyword in the light form of ``words``; of equal ones the earlier.

    A keyword of one word has to be a word of at least three letters; of a longer one, all words have to
    stand in the text in a row.  Words are looked up by the keyword's first word (``keywords``: ``category``, ``keyword``, ``position``).
    """
    known = keywords.withColumn("keyword", text.normalize_light("keyword")).withColumn("first", F.split("keyword", " ")[0])
    light = rows.select(key, text.normalize_light(words).alias("light")).where("light <> ''")
    token = light.select(key, "light", F.explode(F.array_distinct(F.split("light", " "))).alias("first"))
    hit = token.join(F.broadcast(known), "first") if known.count() <= 100_000 else token.join(known, "first")
    single = ~F.col("keyword").contains(" ")
    hit = hit.where(F.when(single, F.length("keyword") >= 3).otherwise(F.concat(F.lit(" "), "light", F.lit(" ")).contains(F.concat(F.lit(" "), "keyword", F.lit(" ")))))
    best = hit.groupBy(key).agg(F.max(F.struct(F.length("keyword").alias("size"), (-F.col("position")).alias("p"), "category", "keyword")).alias("best"))
    return best.select(key, "best.category", "best.keyword")


KEYWORD_TABLE = "(VALUES " + ", ".join(f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(KEYWORDS)) + ") AS k(position, category, keyword)"


@query(f""", t AS (SELECT DISTINCT description FROM live), h AS (
  SELECT description, category, keyword, row_number() OVER (PARTITION BY description ORDER BY length(keyword) DESC, position) AS place
  FROM t JOIN {KEYWORD_TABLE} ON contains(' ' || {LIGHT.format('description')} || ' ', ' ' || keyword || ' '))
SELECT description, category, keyword FROM h WHERE place = 1""")
def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(KEYWORDS)], "position int, category string, keyword string")
    return keyword_matches(views.transactions(spark, sf_dir, "description").distinct(), "description", "description", keywords)


def any_of(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, p.replace("'", "''")) for p in parts) + ")"


@query("SELECT doc_id, " + ", ".join(f"{any_of('x', parts)} AS {kind}" for kind, parts in signals.SIGNALS.items()) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)")
def signal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", *(signals.signal_of(kind, F.col("low")).alias(kind) for kind in signals.SIGNALS))


@query(f"""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE CASE WHEN regexp_matches(text, '{signals.IBAN}') THEN 25 ELSE 0 END + CASE WHEN {any_of('lower(text)', signals.BALANCE_WORDS)} THEN 20 ELSE 0 END
+ CASE WHEN {any_of('text', signals.CURRENCIES)} THEN 15 ELSE 0 END + CASE WHEN regexp_matches(text, '{signals.DATES}') THEN 15 ELSE 0 END + CASE WHEN {any_of('lower(text)', signals.TRANSACTION_WORDS)} THEN 15 ELSE 0 END
+ CASE WHEN regexp_matches(text, '{signals.AMOUNTS}') THEN 10 ELSE 0 END + CASE WHEN {' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in signals.BANK_WORDS)} >= 2 THEN 10 ELSE 0 END END AS score FROM documents""")
def statement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    return docs.select("doc_id", signals.statement_score(F.col("text"), F.col("low")).alias("score"))


_SHOWN = "CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || translate(format('{:,.2f}', abs(amount_cents) / 100.0), ',.', '.,')"


@query(f""", a AS (SELECT DISTINCT amount_cents, {_SHOWN} AS shown FROM live)
SELECT shown || ' EUR' AS shown, amount_cents / 100.0 AS amount FROM a""".replace("amount_cents / 100.0 AS amount", "CAST(amount_cents AS DOUBLE) / 100.0 AS amount"))
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German notation and back."""
    shown = views.transactions(spark, sf_dir, "amount_cents").distinct().select(F.concat(values.german_number(F.col("amount_cents")), F.lit(" EUR")).alias("shown"))
    return shown.select("shown", values.parse_amount(F.col("shown")).alias("amount"))


@query("""SELECT DISTINCT booking_date, strftime(booking_date, '%d.%m.%Y') AS german, booking_date AS from_german, booking_date AS from_iso, booking_date AS from_slash,
strftime(booking_date, '%b %Y') AS label FROM live""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.transactions(spark, sf_dir, "booking_date").distinct()
    read = lambda form: values.parse_date(F.concat(F.lit("on "), F.date_format("booking_date", form), F.lit(" paid")))
    label = values.month_label(F.date_format("booking_date", "yyyy-MM"))
    return d.select("booking_date", F.date_format("booking_date", "dd.MM.yyyy").alias("german"), read("dd.MM.yyyy").alias("from_german"), read("yyyy-MM-dd").alias("from_iso"), read("dd/MM/yyyy").alias("from_slash"), label.alias("label"))


# What the two letters of a merchant list stand for.
CODES = {
    "fd": "RESTAURANT", "en": "ENTERTAINMENT", "ft": "SUBSCRIPTIONS", "md": "HEALTH", "sm": "SUPERMARKET", "el": "SHOPPING", "be": "SHOPPING", "cl": "SHOPPING", "bk": "RESTAURANT", "tr": "TRAVEL",
}
# Other spellings of merchants.
ALIASES = {
    "rewe markt": "rewe", "rewe city": "rewe", "rewe to go": "rewe", "edeka markt": "edeka", "edeka neukauf": "edeka", "lidl dienstleistung": "lidl", "lidl sagt danke": "lidl",
    "aldi sued": "aldi", "aldi süd": "aldi", "aldi nord": "aldi", "kaufland dienstleistung": "kaufland", "netto marken discount": "netto", "netto deutschland": "netto", "penny markt": "penny",
    "real sb warenhaus": "real", "dm drogerie": "dm", "dm drogeriemarkt": "dm", "rossmann drogerie": "rossmann", "mueller drogerie": "mueller", "müller drogerie": "müller",
    "starbucks coffee": "starbucks", "mcdonalds restaurant": "mcdonalds", "mcdonald s": "mcdonalds", "burger king restaurant": "burger king", "kfc restaurant": "kfc", "deutsche bahn": "db",
    "db fernverkehr": "db", "db vertrieb": "db", "bvg fahrausweise": "bvg", "mvv tarifgebiet": "mvv", "amazon mktplce": "amazon", "amazon eu": "amazon", "amzn mktp": "amazon",
    "amzn digital": "amazon", "netflix com": "netflix", "spotify ab": "spotify", "apple com bill": "apple", "google one": "google", "google services": "google", "shell deutschland": "shell",
    "aral tankstelle": "aral", "esso station": "esso", "total tankstelle": "total", "booking com": "booking", "airbnb payments": "airbnb", "uber eats": "uber", "lyft ride": "lyft",
    "lieferando de": "lieferando", "wolt deliver": "wolt",
}
_AFTER_MERCHANTS = 1 << 40


def alias_table(spark: SparkSession, own: dict[str, str] | None = None) -> DataFrame:
    """``alias``, ``canonical`` and ``position`` of the known aliases and a user's ``own``, which win."""
    both = ALIASES | (own or {})
    return spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(both.items())], "alias string, canonical string, position long")


def merchant_index(merchants: DataFrame, aliases: DataFrame) -> DataFrame:
    """``phrase``, ``first`` word, number of ``words``, ``code`` and ``position`` of merchants (``name``, ``category_code``, ``position``) and of aliases of them.

    Of merchants of one name the first counts; an alias counts if its merchant is known and itself is none.
    """
    phrases = merchants.select(text.normalize_light("name").alias("phrase"), F.col("category_code").alias("code"), "position").where("phrase <> ''")
    phrases = phrases.groupBy("phrase").agg(F.min_by("code", "position").alias("code"), F.min("position").alias("position"))
    other = aliases.select(text.normalize_light("alias").alias("alias"), text.normalize_light("canonical").alias("phrase"), (F.col("position") + _AFTER_MERCHANTS).alias("at")).where("alias <> ''")
    other = other.join(phrases.drop("position"), "phrase").groupBy("alias").agg(F.max_by("code", "at").alias("code"), F.max("at").alias("position"))
    other = other.withColumnRenamed("alias", "phrase").join(phrases.select("phrase"), "phrase", "left_anti")
    words = F.split("phrase", " ")
    return phrases.unionByName(other).select("phrase", words[0].alias("first"), F.size(words).alias("words"), "code", "position")


def merchant_categories(rows: DataFrame, key: str, words: str, index: DataFrame) -> DataFrame:
    """``key``, ``category`` and ``matched`` phrase of the merchant that ``words`` names, for each row that names one.

    The longest phrase whose words stand in the text wins, of equal ones that of several words, then the one that
    stands first.  Only texts without any are matched by similarity: the best one-word merchant above 0.82 of a
    word without noise.  Texts meet phrases by their first word, and merchants that are like a word by trigrams.
    """
    light = rows.select(key, F.col(words).alias("raw"), text.normalize_light(words).alias("light"))
    token = light.where("light <> ''").select(key, "light", F.posexplode(F.array_distinct(F.split("light", " "))).alias("at", "first"))
    hit = token.join(index, "first").where((F.col("words") == 1) | (F.col("light").contains(F.col("phrase")) & (F.size(F.array_except(F.split("phrase", " "), F.split("light", " "))) == 0)))
    place = F.struct(F.length("phrase").alias("size"), (F.col("words") > 1).alias("several"), (-F.col("at")).alias("at"), (-F.col("position")).alias("position"), "code", "phrase")
    exact = hit.groupBy(key).agg(F.max(place).alias("best")).select(key, "best.code", F.col("best.phrase").alias("matched"))
    left = light.join(exact.select(key), key, "left_anti").select(key, F.posexplode(text.merchant_words("raw")).alias("at", "w"))
    near = fuzzy.near_pairs(left.select("w").distinct(), index.where("words = 1").select(F.col("phrase").alias("c"), F.col("position").alias("p"))).where(F.col("score") > fuzzy.THRESHOLD)
    scored = left.join(near, "w").join(index.select(F.col("phrase").alias("c"), "code"), "c")
    like = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("at")).alias("at"), (-F.col("p")).alias("p"), "code", "c")).alias("best")).select(key, "best.code", F.col("best.c").alias("matched"))
    category = F.try_element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), "code")
    return exact.unionByName(like).select(key, category.alias("category"), "matched")


# A small merchant list of the kind that a user supplies, and a user's aliases.
MERCHANTS = [("sm", "small ring"), ("el", "gizmo"), ("fd", "hot plate bar"), ("tr", "cold anvil"), ("cl", "widget"), ("md", "platee"), ("tr", "cold anvil"), ("xx", "rod")]
OWN_ALIASES = {"red gear": "Gizmo!", "no such": "nowhere", "widget": "rod"}


def merchant_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(MERCHANTS)], "category_code string, name string, position long")


_INDEX = "(VALUES " + ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate([*MERCHANTS, ("el", "red gear")]) if i != 6) + ") AS m(position, code, phrase)"
_CODES = "MAP {" + ", ".join(f"'{c}': '{n}'" for c, n in CODES.items()) + "}"


def lookup_sql(source: str, key: str, words: str) -> str:
    """Common table expressions that end with ``found``: ``key``, ``category`` and ``matched``."""
    return f"""lt AS (SELECT {key}, coalesce({words}, '') AS raw, {LIGHT.format(f"coalesce({words}, '')")} AS light FROM {source}),
ex AS (SELECT {key}, code, phrase, row_number() OVER (PARTITION BY {key} ORDER BY length(phrase) DESC, contains(phrase, ' ') DESC, position) AS place FROM lt JOIN {_INDEX}
  ON list_has_all(string_split(light, ' '), string_split(phrase, ' ')) AND contains(light, phrase)),
wd AS (SELECT {key}, unnest(list_filter({_WORDS.format('raw')}, lambda w: length(w) >= 4)) AS a FROM lt WHERE {key} NOT IN (SELECT {key} FROM ex)),
sc AS (SELECT {key}, code, b, greatest({_LEVENSHTEIN}, {_JACCARD}) AS score FROM (SELECT {key}, a, code, phrase AS b FROM wd JOIN {_INDEX} ON a[1] = phrase[1] AND NOT contains(phrase, ' ') AND length(phrase) >= 4)),
fz AS (SELECT {key}, code, b AS phrase, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, b) AS place FROM sc WHERE score > 0.82),
found AS (SELECT {key}, {_CODES}[code] AS category, phrase AS matched FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) WHERE place = 1)"""


@query(f", s AS (SELECT id, concat_ws(' ', description, counterparty) AS t FROM bank_texts), {lookup_sql('s', 'id', 't')} SELECT * FROM found")
def merchant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merchant that each text names: by phrase, by word, by alias, else by likeness."""
    rows = views.bank_texts(spark, sf_dir).select("id", F.concat_ws(" ", "description", "counterparty").alias("t"))
    return merchant_categories(rows, "id", "t", merchant_index(merchant_list(spark), alias_table(spark, OWN_ALIASES)))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in (ALIASES | OWN_ALIASES).items()) + ") AS x(alias, canonical)")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_table(spark, OWN_ALIASES).select("alias", "canonical")
