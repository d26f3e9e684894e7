"""Registry of the engine's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis_queries, operator_queries, panel_queries, portfolio_queries
from .sources import source_queries

_SETS = (operator_queries, analysis_queries, portfolio_queries, panel_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _SETS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _SETS for name, sql in part.ORACLES.items()}
