"""Registry of named queries over the driver tables and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables. The oracle is standalone SQL over the same parquet views, prefixed
with the readings/commands adapter CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydrospark.sources.testdata import with_readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, raw_sql: bool = False):
    """Decorator: add a query (and its oracle SQL, if it has one)."""
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql if raw_sql else with_readings(sql)
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from hydrospark.plans import (registered_batch, registered_maintenance, registered_models,  # noqa: F401
                                  registered_rows, registered_sequences)
