"""All queries of the library by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from tallyforge.operators import bank_texts, categorize, display, learning, merchants, reads, spending, store, trends  # noqa: F401  they register their queries
from tallyforge.sources import banks, exports, pdf_text, spreadsheets, statements, strategies  # noqa: F401
from tallyforge.plans.catalog import ORACLE, QUERIES, Query
from tallyforge.streaming import imports, rollups  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
