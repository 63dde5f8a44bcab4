"""predicates. Written as plain filters so Catalyst pushes
them into the Parquet scan (``PushedFilters`` on ``ts`` and the guarded
columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trailing_window(df: DataFrame, as_of: Column, days: int | float, ts: str = "ts",
                    include_future: bool = False) -> DataFrame:
    """rows with ``ts > as_of - days`` (strict). Replays also cap at ``as_of``.
    A ``date`` column (the layout K1 writes) is bounded too, so that partitions
    outside the window are neither listed nor opened."""
    lower = as_of - F.expr(f"INTERVAL {int(days * 86400)} SECONDS")
    cond = F.col(ts) > lower
    if not include_future:
        cond = cond & (F.col(ts) <= as_of)
    if "date" in df.columns and dict(df.dtypes)["date"] == "date":
        cond = cond & (F.col("date") >= F.to_date(lower))
        if not include_future:
            cond = cond & (F.col("date") <= F.to_date(as_of))
    return df.filter(cond)


def complete_rows(df: DataFrame, cols=("temperature", "humidity", "soil1", "soil2")) -> DataFrame:
    """required measurement columns are all non-null."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def unresolved(df: DataFrame) -> DataFrame:
    """alerts not yet resolved."""
    return df.filter(F.col("resolved") == 0)


def nonnull_pumps(df: DataFrame) -> DataFrame:
    """rows with both pump states present (guard ahead of pump status)."""
    return df.filter(F.col("pump1").isNotNull() & F.col("pump2").isNotNull())


def nonnull_water(df: DataFrame) -> DataFrame:
    """rows with a water state (guard ahead of the latest-water lookup)."""
    return df.filter(F.col("water").isNotNull())
