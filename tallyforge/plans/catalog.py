"""The catalogue: queries by name, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.views import TEXTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The views of ``views.py`` in SQL.
PRELUDE = """
WITH tx AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS account_id, l_orderkey AS statement_id, CAST(l_shipdate AS DATE) AS booking_date,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
    CASE WHEN p_size > 2 THEN p_name END AS counterparty_name, p_brand || ' ' || p_name AS description,
    CASE WHEN p_size < 50 THEN p_type END AS auto_category, CASE WHEN l_tax = 0 THEN l_linenumber % 6 + 1 END AS category_id,
    l_linenumber = 7 AS is_duplicate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
live AS (SELECT * FROM tx WHERE NOT is_duplicate),
accounts AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS bank_name, 'DE' || lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS iban, c_acctbal >= 0 AS is_active FROM customer),
statements AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, 'stmt_' || (o_orderkey % 1000) || '.csv' AS file_name, CAST(o_orderdate AS DATE) AS import_date FROM orders),
categories AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name FROM region),
merchants AS (SELECT s_suppkey AS id, s_name AS name, n_name AS country_code FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def _text(t: str | None) -> str:
    return "NULL" if t is None else "replace(replace('{0}', '{{n}}', name), '{{N}}', upper(name))".format(t.replace("'", "''"))


PRELUDE += ",\nbank_texts AS (SELECT name || '#' || i AS id, name, CASE i {} END AS description, CASE i {} END AS counterparty, CASE i {} END AS remittance FROM (SELECT DISTINCT p_name AS name FROM part), range({}) AS r(i))\n".format(
    *(" ".join(f"WHEN {i} THEN {_text(t[k])}" for i, t in enumerate(TEXTS)) for k in range(3)), len(TEXTS)
)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` continues the views' WITH clause."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = PRELUDE + sql
        return f

    return register
