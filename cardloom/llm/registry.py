"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import conversation_repair, language_id, line_dedup, mixing, near_dedup, packing, periodic_runs, quality, sentencepieces, sharding, topk, toxicity, url_filter

MODULES = (packing, mixing, near_dedup, topk, line_dedup, url_filter, toxicity, quality, language_id, sharding, sentencepieces, conversation_repair, periodic_runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
