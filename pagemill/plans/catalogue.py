"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import books, changes, contents, dashboard, locales, lookups, markup, packages, panels, sessions, strings, texts

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = [dashboard, sessions, texts, changes, strings, packages, panels, markup, contents, books, lookups, locales]


def queries() -> dict[str, Query]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
