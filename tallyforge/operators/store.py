"""Writes as functions: a table and a change give the new table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.plans import views
from tallyforge.plans.catalog import query

DUPLICATE_KEY = ("account_id", "booking_date", "amount_cents", "description")


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended by column name; columns that they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_by_key(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows take the values of the change with their key; changes hold one row a key, and a null leaves a value as it is."""
    columns = [c for c in changes.columns if c != key]
    both = table.join(changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns)), key, "left")
    return both.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Insert or replace: of each key the row with the largest ``sequence`` stays.

    The rows of a key are aggregated before they are shuffled, so that one with many changes is no large group.
    """
    every = insert(table, rows)
    last = every.groupBy(F.col(key).alias("of")).agg(F.max_by(F.struct(*every.columns), F.struct(sequence)).alias("x"))
    return last.select("x.*")


def delete(table: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def delete_account(accounts: DataFrame, statements: DataFrame, transactions: DataFrame, account: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An account with all that hangs on it."""
    return accounts.where(F.col("id") != account), statements.where(F.col("account_id") != account), transactions.where(F.col("account_id") != account)


def delete_category(transactions: DataFrame, categories: DataFrame, category: int) -> tuple[DataFrame, DataFrame]:
    """A category goes; its transactions lose it and count as OTHER."""
    of_it = F.coalesce(F.col("category_id") == category, F.lit(False))
    return update(transactions, of_it, {"auto_category": F.lit("OTHER"), "category_id": F.lit(None)}), categories.where(F.col("id") != category)


def flag_duplicates(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """``incoming`` with ``is_duplicate``: an equal row is live already, or stands earlier among the incoming.

    Existing keys are made distinct first, so a key's window holds its incoming rows and one other.
    """
    old = existing.where("NOT is_duplicate").select(*DUPLICATE_KEY).distinct().withColumn("stored", F.lit(True))
    both = incoming.drop("is_duplicate").withColumn("stored", F.lit(False)).unionByName(old, allowMissingColumns=True)
    place = Window.partitionBy(*DUPLICATE_KEY).orderBy(F.desc("stored"), *order)
    return both.withColumn("is_duplicate", F.row_number().over(place) > 1).where("NOT stored").drop("stored")


def known_statements(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming statements of which account and file name are stored."""
    return incoming.join(stored.select("account_id", "file_name").distinct(), ["account_id", "file_name"], "left_semi")


def match_accounts(imports: DataFrame, accounts: DataFrame) -> DataFrame:
    """``imports`` (``iban``, ``bank``) with the account of the IBAN, else one of the bank, else none."""
    least = lambda key: accounts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"k_{key}")).agg(F.min("id").alias(f"by_{key}"))
    both = imports.join(least("iban"), F.col("iban") == F.col("k_iban"), "left").join(least("bank_name"), F.col("bank") == F.col("k_bank_name"), "left")
    kind = F.when(F.col("by_iban").isNotNull(), "IbanMatch").when(F.col("by_bank_name").isNotNull(), "BankMatch").otherwise("NoMatch")
    return both.select(*imports.columns, F.coalesce("by_iban", "by_bank_name").alias("account_id"), kind.alias("match"))


_ALL = "id, account_id, booking_date, amount_cents, description"


@query(f""", old AS (SELECT {_ALL} FROM live WHERE booking_date < DATE '1998-01-01'), new AS (SELECT {_ALL} FROM tx WHERE booking_date >= DATE '1997-07-01')
SELECT {_ALL}, EXISTS (SELECT 1 FROM old o WHERE o.account_id = new.account_id AND o.booking_date = new.booking_date AND o.amount_cents = new.amount_cents AND o.description = new.description)
  OR row_number() OVER (PARTITION BY account_id, booking_date, amount_cents, description ORDER BY id) > 1 AS is_duplicate FROM new""")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", *DUPLICATE_KEY, "is_duplicate", live=False)
    flagged = flag_duplicates(rows.where("booking_date < DATE '1998-01-01'"), rows.where("booking_date >= DATE '1997-07-01'"), ["id"])
    return flagged.select("id", *DUPLICATE_KEY, "is_duplicate")


@query("""SELECT * FROM statements n WHERE import_date >= DATE '1999-01-01'
AND EXISTS (SELECT 1 FROM statements o WHERE o.import_date < DATE '1999-01-01' AND o.account_id = n.account_id AND o.file_name = n.file_name)""")
def duplicate_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.statements(spark, sf_dir)
    return known_statements(rows.where("import_date >= DATE '1999-01-01'"), rows.where("import_date < DATE '1999-01-01'")).select(*rows.columns)


@query(""", i AS (SELECT id AS import_id, 'DE' || lpad(CAST(account_id * 3 AS VARCHAR), 20, '0') AS iban, CASE WHEN id % 3 = 0 THEN 'BUILDING' WHEN id % 3 = 1 THEN 'NO BANK' END AS bank FROM statements)
SELECT i.*, coalesce(a.id, b.id) AS account_id, CASE WHEN a.id IS NOT NULL THEN 'IbanMatch' WHEN b.id IS NOT NULL THEN 'BankMatch' ELSE 'NoMatch' END AS match
FROM i LEFT JOIN accounts a ON a.iban = i.iban LEFT JOIN (SELECT bank_name, min(id) AS id FROM accounts GROUP BY 1) b ON b.bank_name = i.bank""")
def account_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = views.statements(spark, sf_dir).selectExpr(
        "id AS import_id", "concat('DE', lpad(CAST(account_id * 3 AS STRING), 20, '0')) AS iban", "CASE WHEN id % 3 = 0 THEN 'BUILDING' WHEN id % 3 = 1 THEN 'NO BANK' END AS bank"
    )
    return match_accounts(imports, views.accounts(spark, sf_dir))


@query(""", r AS (SELECT description AS pattern, CASE WHEN id % 2 = 0 THEN auto_category ELSE 'custom:' || category_id END AS category_name, id * 100000000 + amount_cents AS seq FROM live)
SELECT pattern, max(seq) AS seq, arg_max(category_name, seq) FILTER (true) AS category_name FROM (SELECT pattern, seq, max(coalesce(category_name, '')) AS category_name FROM r GROUP BY 1, 2) GROUP BY 1""")
def override_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "amount_cents", "description", "auto_category", "category_id").selectExpr("description AS pattern", "CASE WHEN id % 2 = 0 THEN auto_category ELSE concat('custom:', category_id) END AS category_name", "id * 100000000 + amount_cents AS seq")
    # of a pattern's rows with one category the last; of equal ones the largest category, which is what the pair of both orders by
    rows = rows.groupBy("pattern", F.coalesce("category_name", F.lit("")).alias("category_name"), (F.col("seq") % 2 == 0).alias("even")).agg(F.max("seq").alias("seq"))
    rows = rows.select("pattern", "seq", "category_name", "even", F.struct("seq", "category_name").alias("by"))
    return upsert(rows.where("even"), rows.where("NOT even"), "pattern", "by").select("pattern", "seq", "category_name")


@query("""SELECT 'accounts' AS name, count(*) AS n FROM accounts WHERE id <> 7 UNION ALL SELECT 'statements', count(*) FROM statements WHERE account_id <> 7
UNION ALL SELECT 'transactions', count(*) FROM tx WHERE account_id <> 7""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = delete_account(views.accounts(spark, sf_dir), views.statements(spark, sf_dir), views.transactions(spark, sf_dir, "account_id", live=False), 7)
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in zip(("accounts", "statements", "transactions"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT id, booking_date, amount_cents, CASE WHEN category_id = 3 THEN 'OTHER' ELSE auto_category END AS auto_category, CASE WHEN category_id <> 3 THEN category_id END AS category_id FROM live""")
def category_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir, "id", "booking_date", "amount_cents", "auto_category", "category_id")
    return delete_category(rows, views.categories(spark, sf_dir), 3)[0]


@query("""SELECT a.id, coalesce(s.name, a.name) AS name, a.is_active FROM accounts a LEFT JOIN (SELECT id, 'renamed ' || id AS name FROM accounts WHERE id % 5 = 0) s USING (id)""")
def update_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.accounts(spark, sf_dir).select("id", "name", "is_active")
    return update_by_key(rows, rows.where("id % 5 = 0").select("id", F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("name")), "id")


@query("""SELECT id, name, is_active FROM accounts WHERE id % 4 <> 0 AND id % 5 <> 1 UNION ALL SELECT id, 'new ' || name, NULL FROM accounts WHERE id % 4 = 0""")
def accounts_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted, some with less columns, and others deleted."""
    rows = views.accounts(spark, sf_dir).select("id", "name", "is_active")
    kept = delete(rows.where("id % 4 <> 0"), rows.where("id % 5 = 1").select("id"), "id")
    return insert(kept, rows.where("id % 4 = 0").select("id", F.concat(F.lit("new "), "name").alias("name")))


@query("SELECT 'statements' AS name, 0 AS n UNION ALL SELECT 'accounts', count(*) FILTER (NOT is_active) FROM accounts")
def tables_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table cleared, and accounts that are set inactive."""
    cleared = truncate(views.statements(spark, sf_dir)).agg(F.lit("statements").alias("name"), F.count("*").alias("n"))
    off = update(views.accounts(spark, sf_dir), F.col("is_active"), {"is_active": F.col("is_active")}).where("NOT is_active")
    return cleared.unionByName(off.agg(F.lit("accounts").alias("name"), F.count("*").alias("n")))


def rules_of(description: Column, counterparty: Column, category: Column) -> Column:
    """The override rules that a user's correction writes: one for the counterparty, or the whole text without one, and one for the merchant's token."""
    from tallyforge.functions import text

    primary, full = F.nullif(text.normalize_light(counterparty), F.lit("")), F.nullif(text.normalize_light(F.concat_ws(" ", description, counterparty)), F.lit(""))
    token = text.merchant_token(F.coalesce(counterparty, description))
    patterns = F.array_distinct(F.array_compact(F.array(F.coalesce(primary, full), F.when(F.length(token) >= 4, token))))
    return F.transform(patterns, lambda p: F.struct(p.alias("pattern"), category.alias("category_name")))


@query(""", n AS (SELECT DISTINCT counterparty_name AS name FROM live WHERE counterparty_name IS NOT NULL), r AS (SELECT name AS pattern, 'C' || length(name) AS category_name FROM n UNION ALL
SELECT token, 'C' || length(name) FROM (SELECT name, list_filter(string_split(name, ' '), lambda w: length(w) > 1)[1] AS token FROM n) WHERE length(token) >= 4)
SELECT pattern, max(category_name) AS category_name FROM r GROUP BY 1""")
def overrides_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of all merchants as rules; of several for one pattern the last counts."""
    names = views.transactions(spark, sf_dir, "counterparty_name").where("counterparty_name IS NOT NULL").distinct()
    category = F.concat(F.lit("C"), F.length("counterparty_name").cast("string"))
    rules = names.select(F.explode(rules_of(F.lit(None).cast("string"), F.col("counterparty_name"), category)).alias("x")).select("x.*")
    return upsert(rules.limit(0), rules, "pattern", "category_name")


@query(""", n AS (SELECT DISTINCT counterparty_name AS name FROM live WHERE counterparty_name IS NOT NULL), r AS (SELECT name, name AS pattern FROM n UNION ALL
SELECT name, token FROM (SELECT name, list_filter(string_split(name, ' '), lambda w: length(w) > 1)[1] AS token FROM n) WHERE length(token) >= 4)
SELECT DISTINCT pattern FROM r WHERE pattern NOT IN (SELECT pattern FROM r WHERE length(name) % 2 = 0)""")
def overrides_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that are left when the corrections of all merchants of an even number of letters are taken back, each with the rules that it wrote."""
    names = views.transactions(spark, sf_dir, "counterparty_name").where("counterparty_name IS NOT NULL").distinct()
    rules = lambda rows: rows.select(F.explode(rules_of(F.lit(None).cast("string"), F.col("counterparty_name"), F.lit("C"))).alias("x")).select("x.pattern").distinct()
    return delete(rules(names), rules(names.where("length(counterparty_name) % 2 = 0")), "pattern")
