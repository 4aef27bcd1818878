"""All queries of the library, and the SQL that checks them."""

from __future__ import annotations

from ledgerline.plans import checks, combined, decisions, extracts, loads, mart, publications, relations, series, statistics, texts  # noqa: F401  importing a module registers its queries
from ledgerline.plans.stand_in import ORACLE, QUERIES, Query

series.register_mart_counts()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
