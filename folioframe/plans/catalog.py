"""Every query of the engine by name, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans import data_queries, ingest_queries, scalar_queries, store_queries, surface_queries, text_queries, tool_queries, tree_queries

MODULES = (text_queries, tree_queries, data_queries, store_queries, scalar_queries, surface_queries, ingest_queries, tool_queries)
flagship = text_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
