"""H4: the plant-health report (F1 -> S9 -> W3 -> A11 -> H1-H3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.columns import round_d
from hydrospark.functions.health import health_recommendations, health_score, health_status
from hydrospark.operators.filters import trailing_window
from hydrospark.operators.sessions import plant_figures


def plant_health_scores(readings: DataFrame, as_of: Column, days: int = 7,
                        known: DataFrame | None = None) -> DataFrame:
    """Per (device, plant): metrics plus unrounded score and status. Devices of
    ``known`` without readings in the window have null figures."""
    m = plant_figures(trailing_window(readings, as_of, days), days, known)
    score = health_score(F.col("avg_soil"), F.col("frequency"), F.col("avg_duration"),
                         F.col("soil_stability"), F.col("latest_temperature"), F.col("latest_humidity"))
    scored = F.when(F.col("avg_soil").isNotNull(), score.cast("double"))
    return m.withColumn("score", scored).withColumn(
        "health", F.when(F.col("score").isNotNull(), health_status(F.col("score"))))


def plant_health_report(readings: DataFrame, as_of: Column, days: int = 7,
                        with_recommendations: bool = True, devices: DataFrame | None = None,
                        known_days: int | None = None) -> DataFrame:
    """H4: one row per (device, plant) with the rounded figures of the report.

    Every device of ``devices`` (column device_id) is listed; by default all
    that ever posted a reading, with ``known_days`` all that did in that many days,
    so that no scan reads all history. A device without readings in the window has health Unknown, score 0, null
    figures and no recommendations."""
    known = readings if devices is None else devices
    if devices is None and known_days is not None:
        known = trailing_window(readings, as_of, known_days)
    s = plant_health_scores(readings, as_of, days, known) \
        .withColumn("health", F.coalesce("health", F.lit("Unknown"))) \
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    seen = F.col("avg_soil").isNotNull()
    cols = [
        "device_id", "plant", "health",
        round_d(F.col("score"), 1).alias("score"),
        round_d(F.col("avg_soil"), 1).alias("avg_soil_moisture"),
        F.when(F.col("avg_soil") > 450, "DRY").when(seen, "WET").alias("soil_status"),
        round_d(F.col("frequency"), 2).alias("watering_frequency_per_day"),
        round_d(F.col("avg_duration"), 1).alias("avg_watering_duration_seconds"),
        F.col("total_water_time").alias("total_water_time_seconds"),
        round_d(F.col("soil_stability"), 1).alias("soil_stability"),
        F.col("watering_events").alias("watering_events_count"),
        F.col("latest_temperature").alias("current_temperature"),
        F.col("latest_humidity").alias("current_humidity"),
    ]
    if with_recommendations:
        recs = health_recommendations(F.col("avg_soil"), F.col("frequency"), F.col("avg_duration"),
                                      F.col("soil_stability"), F.col("plant"))
        cols.append(F.filter(recs, lambda _: seen).alias("recommendations"))
    return s.select(*cols)
