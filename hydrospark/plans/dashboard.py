"""A2: dashboard = A1 daily stats + latest reading (+ latest weather and
location when given), one row per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.latest import latest_location, latest_reading, latest_weather
from hydrospark.operators.stats import daily_stats
from hydrospark.sources.timestamps import display_ts

_STAT_DEFAULTS = {"avg_temperature": 0.0, "avg_humidity": 0.0, "soil1_dry_percent": 0.0, "soil2_dry_percent": 0.0,
                  "pump1_usage_percent": 0.0, "pump2_usage_percent": 0.0}
_COUNT_COLS = ["total_pump1_time", "total_pump2_time", "water_warnings"]


def dashboard(readings: DataFrame, as_of: Column, weather: DataFrame | None = None,
              location: DataFrame | None = None, model_available: bool | None = None) -> DataFrame:
    stats = daily_stats(readings, as_of)
    latest = latest_reading(readings).select(
        "device_id", display_ts(F.col("ts")).alias("latest_timestamp"),
        *[F.col(c).alias(f"latest_{c}") for c in ("temperature", "humidity", "soil1", "soil2", "water", "pump1",
                                                  "pump2")])
    j = latest.join(stats, "device_id", "left")
    out = j.select(
        "device_id",
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in _STAT_DEFAULTS.items()],
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in _COUNT_COLS],
        *[c for c in latest.columns if c != "device_id"])
    if weather is not None:
        w = latest_weather(weather).select(
            F.struct("temperature", "humidity", "precipitation", (F.col("rain_forecast") != 0).alias("rain_forecast"),
                     F.col("weather_description").alias("description"),
                     F.col("location_city").alias("location")).alias("weather"))
        out = out.crossJoin(F.broadcast(w))  # at most one row
    if location is not None:
        loc = latest_location(location).select(F.struct(*location.columns).alias("location"))
        out = out.crossJoin(F.broadcast(loc))  # at most one row
    if model_available is not None:
        out = out.withColumn("model_available", F.lit(model_available))
    return out
