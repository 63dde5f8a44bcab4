"""One row per plant instead of two column families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLANT_COLUMNS = ("soil", "pump", "pump_duration")


def unpivot_plants(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Wide dual-plant readings -> (keep..., plant, soil, pump, pump_duration).

    A narrow ``Generate`` (stack) inside the scan's codegen stage; no shuffle.
    """
    keep = keep if keep is not None else [c for c in df.columns if not (
        c.startswith("soil") or c.startswith("pump"))]
    stacked = F.inline(F.array(
        F.struct(F.lit(1).alias("plant"), F.col("soil1").alias("soil"), F.col("pump1").alias("pump"),
                 F.col("pump1_duration").alias("pump_duration")),
        F.struct(F.lit(2).alias("plant"), F.col("soil2").alias("soil"), F.col("pump2").alias("pump"),
                 F.col("pump2_duration").alias("pump_duration")),
    ))
    return df.select(*keep, stacked)
