"""Names of the registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

from cardloom.plans import benchmarks, catalog, imports, ledgers, likeness, market, portfolio, recognition, systems  # noqa: E402

MODULES: tuple = (market, portfolio, catalog, systems, imports, recognition, likeness, benchmarks, ledgers)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
