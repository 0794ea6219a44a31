"""All registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunking, flowing, oracles, reading, registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return registry.queries() | chunking.queries() | reading.queries() | flowing.queries()


def oracle_sql() -> dict[str, str]:
    """By name."""
    return oracles.oracle_sql() | chunking.oracle_sql() | reading.oracle_sql() | flowing.oracle_sql()
