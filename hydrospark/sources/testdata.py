"""Adapter from the driver's ``events`` table to the ``readings`` schema.

The mapping is fixed (same expressions in Spark and in the DuckDB oracle), see
FIXTURES.md §5. ``events.ts`` is TIMESTAMP_NTZ; it is kept as is so the
oracle comparison sees identical wall-clock values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# "Now" for every trailing-window operator over the driver tables.
AS_OF = "2024-01-31 00:00:00"


def as_of_lit() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Hour/weekday features and "as of" arithmetic are defined on UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project events onto the dual-plant readings schema (narrow, no shuffle).
    ``keep`` passes extra event columns through the same projection."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    soil1 = F.when(et.isin("click", "error"), "DRY").otherwise("WET")
    soil2 = F.when(et.isin("view", "error"), "DRY").otherwise("WET")
    water = F.when(k % 10 == 0, "NOT AVAILABLE").otherwise("AVAILABLE")
    water_ok = ~(k % 10 == 0)
    pump1 = F.when((soil1 == "DRY") & water_ok, "ON").otherwise("OFF")
    pump2 = F.when((soil2 == "DRY") & water_ok, "ON").otherwise("OFF")

    def duration(pump: Column) -> Column:
        return F.when(pump == "ON", (k % 5) * 30).otherwise(k * 4).cast("int")

    return events.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("device_id"),
        F.col("ts"),
        (F.col("value") % F.lit(45.0)).alias("temperature"),
        k.cast("double").alias("humidity"),
        soil1.alias("soil1"),
        soil2.alias("soil2"),
        water.alias("water"),
        pump1.alias("pump1"),
        pump2.alias("pump2"),
        duration(pump1).alias("pump1_duration"),
        duration(pump2).alias("pump2_duration"),
        F.when(k % 7 == 0, 1).otherwise(0).cast("int").alias("manual_override"),
        *keep,
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(load(spark, sf_dir, "events"))


def commands_from_events(events: DataFrame) -> DataFrame:
    """Manual pump commands derived from ``purchase`` events.

    One second after the event, pump1 when k is even else pump2; action
    ON / OFF / TOGGLE by k mod 3. Kept deterministic so DuckDB can build the
    same list.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    return events.filter(F.col("event_type") == "purchase").select(
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"),
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("command_id"),
        F.when(k % 2 == 0, "pump1").otherwise("pump2").alias("pump"),
        F.when(k % 3 == 0, "ON").when(k % 3 == 1, "OFF").otherwise("TOGGLE").alias("action"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_from_events(load(spark, sf_dir, "events"))


# DuckDB mirror of ``readings_from_events`` / ``commands_from_events``; prefixed
# to every oracle statement as CTEs.
READINGS_SQL = """
events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
readings AS (
  SELECT event_id AS reading_id, user_id AS device_id, ts,
         value % 45.0 AS temperature,
         CAST(k AS DOUBLE) AS humidity,
         CASE WHEN event_type IN ('click', 'error') THEN 'DRY' ELSE 'WET' END AS soil1,
         CASE WHEN event_type IN ('view', 'error') THEN 'DRY' ELSE 'WET' END AS soil2,
         CASE WHEN k % 10 = 0 THEN 'NOT AVAILABLE' ELSE 'AVAILABLE' END AS water,
         CASE WHEN event_type IN ('click', 'error') AND k % 10 <> 0 THEN 'ON' ELSE 'OFF' END AS pump1,
         CASE WHEN event_type IN ('view', 'error') AND k % 10 <> 0 THEN 'ON' ELSE 'OFF' END AS pump2,
         CAST(CASE WHEN event_type IN ('click', 'error') AND k % 10 <> 0 THEN (k % 5) * 30 ELSE k * 4 END AS INTEGER) AS pump1_duration,
         CAST(CASE WHEN event_type IN ('view', 'error') AND k % 10 <> 0 THEN (k % 5) * 30 ELSE k * 4 END AS INTEGER) AS pump2_duration,
         CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS manual_override
  FROM events_k
),
commands AS (
  SELECT ts + INTERVAL 1 SECOND AS ts, user_id AS device_id, event_id AS command_id,
         CASE WHEN k % 2 = 0 THEN 'pump1' ELSE 'pump2' END AS pump,
         CASE WHEN k % 3 = 0 THEN 'ON' WHEN k % 3 = 1 THEN 'OFF' ELSE 'TOGGLE' END AS action
  FROM events_k WHERE event_type = 'purchase'
)"""

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def with_readings(sql: str) -> str:
    """Prefix an oracle statement with the readings/commands CTEs.

    ``sql`` may start with its own ``WITH`` list; it is merged.
    """
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return "WITH RECURSIVE " + READINGS_SQL + ",\n" + rest[9:].lstrip()
        return "WITH " + READINGS_SQL + ",\n" + rest
    return "WITH " + READINGS_SQL + "\n" + body
