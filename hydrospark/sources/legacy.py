"""Legacy single-plant rows and CSV snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.schemas import LEGACY_READINGS


def migrate_legacy(df: DataFrame) -> DataFrame:
    """S3: old single-plant rows -> dual-plant schema. ``soil`` fills soil1 and
    soil2 (as text, so numeric legacy soil later tests as not DRY), ``pump``
    fills both pumps, ``pump_duration`` goes to plant 1 and plant 2 gets 0.
    Rows already in the new schema pass through."""
    if "soil1" in df.columns or not {"soil", "pump"} <= set(df.columns):
        return df
    ts = "timestamp" if "timestamp" in df.columns else "ts"
    extra = [c for c in ("reading_id", "device_id") if c in df.columns]
    return df.select(
        *extra, F.col(ts).alias("ts"), "temperature", "humidity",
        F.col("soil").cast("string").alias("soil1"), F.col("soil").cast("string").alias("soil2"),
        "water", F.col("pump").alias("pump1"), F.col("pump").alias("pump2"),
        F.col("pump_duration").cast("int").alias("pump1_duration"), F.lit(0).cast("int").alias("pump2_duration"),
        F.col("manual_override").cast("int").alias("manual_override"))


def read_snapshots(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Read cumulative CSV snapshots with the fixed legacy schema.

    Each later snapshot repeats the earlier ones' lines, so a line is kept as
    often as the file that has it most often: equal rows are counted per file,
    and the largest count of any file stays. Different measurements at the same
    second are different rows. Both steps are partial aggregates.
    """
    df = spark.read.schema(LEGACY_READINGS).option("header", True) \
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(paths) \
        .withColumn("_file", F.col("_metadata.file_path"))
    cols = [f.name for f in LEGACY_READINGS.fields]
    per_file = df.groupBy("_file", *cols).agg(F.count(F.lit(1)).alias("_n"))
    most = per_file.groupBy(*cols).agg(F.max("_n").cast("int").alias("_n"))
    return most.select(*cols, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_i")).drop("_i")


def legacy_from_events(events: DataFrame) -> DataFrame:
    """Legacy-shaped rows derived from ``events`` (test input for S3, F8, F9):
    numeric soil = floor(value * 2), pump/water as the readings adapter."""
    from hydrospark.sources.testdata import readings_from_events
    r = readings_from_events(events, keep=("value",)) \
        .withColumn("soil", F.floor(F.col("value") * F.lit(2.0)).cast("int"))
    return r.select(
        "reading_id", "device_id", F.col("ts").alias("timestamp"), "temperature", "humidity", "soil", "water",
        F.col("pump1").alias("pump"), F.col("pump1_duration").alias("pump_duration"), "manual_override")


LEGACY_SQL = """
legacy AS (
  SELECT r.reading_id, r.device_id, r.ts AS timestamp, r.temperature, r.humidity,
         CAST(FLOOR(e.value * 2.0) AS INTEGER) AS soil, r.water, r.pump1 AS pump,
         r.pump1_duration AS pump_duration, r.manual_override
  FROM readings r JOIN events_k e ON e.event_id = r.reading_id
)"""
