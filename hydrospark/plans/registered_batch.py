"""Registered queries: readings, stats, health (oracle-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.plans.plant_health import plant_health_report
from hydrospark.plans.registry import register
from hydrospark.operators.stats import daily_stats
from hydrospark.sources import testdata as td

A = td.AS_OF_SQL

# Reusable oracle fragments ---------------------------------------------------

PLANT_ROWS_SQL = """
  SELECT reading_id, device_id, ts, temperature, humidity, water, manual_override,
         1 AS plant, soil1 AS soil, pump1 AS pump, pump1_duration AS pump_duration FROM {src}
  UNION ALL
  SELECT reading_id, device_id, ts, temperature, humidity, water, manual_override,
         2 AS plant, soil2 AS soil, pump2 AS pump, pump2_duration AS pump_duration FROM {src}
"""

WINDOW_SQL = f"SELECT * FROM readings WHERE ts > {A} - INTERVAL {{days}} DAY AND ts <= {A}"

SESSIONS_SQL = """
  SELECT device_id, plant, start_ts, end_ts, CAST(duration AS INTEGER) AS duration, CAST(on_seconds AS BIGINT) AS on_seconds
  FROM (
    SELECT device_id, plant, g,
           MIN(CASE WHEN is_open THEN ts END) AS start_ts,
           MAX(CASE WHEN is_close THEN ts END) AS end_ts,
           MAX(CASE WHEN is_close THEN COALESCE(pump_duration, 0) END) AS duration,
           SUM(CASE WHEN is_open THEN COALESCE(pump_duration, 0) END) AS on_seconds
    FROM (
      SELECT *, COALESCE(SUM(CASE WHEN is_close THEN 1 ELSE 0 END) OVER (
                  PARTITION BY device_id, plant ORDER BY ts, reading_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
      FROM (SELECT *, pump = 'ON' AND COALESCE(pump_duration, 0) > 0 AS is_open,
                      pump = 'OFF' AS is_close FROM {src})
    ) GROUP BY device_id, plant, g
  ) WHERE start_ts IS NOT NULL AND end_ts IS NOT NULL
"""

HEALTH_SQL = f"""
w AS ({WINDOW_SQL.format(days=7)}),
p AS ({PLANT_ROWS_SQL.format(src='w')}),
s AS ({SESSIONS_SQL.format(src='p')}),
soil AS (
  SELECT device_id, plant,
         AVG(CASE WHEN soil = 'DRY' THEN 600 ELSE 300 END) AS avg_soil,
         SQRT(CAST(COUNT(*) * SUM(CASE WHEN soil = 'DRY' THEN 360000 ELSE 90000 END)
              - SUM(CASE WHEN soil = 'DRY' THEN 600 ELSE 300 END) * SUM(CASE WHEN soil = 'DRY' THEN 600 ELSE 300 END) AS DOUBLE))
           / COUNT(*) AS soil_stability,
         CAST(SUM(CASE WHEN pump = 'ON' AND COALESCE(pump_duration, 0) > 0 THEN COALESCE(pump_duration, 0) ELSE 0 END) AS BIGINT) AS total_water_time,
         ARG_MAX(temperature, (ts, reading_id)) AS latest_temperature,
         ARG_MAX(humidity, (ts, reading_id)) AS latest_humidity
  FROM p GROUP BY device_id, plant
),
ev AS (SELECT device_id, plant, COUNT(*) AS events, AVG(duration) AS avg_duration FROM s GROUP BY device_id, plant),
m AS (
  SELECT soil.*, CAST(COALESCE(ev.events, 0) AS BIGINT) AS watering_events,
         COALESCE(ev.events, 0) / 7.0 AS frequency, CAST(COALESCE(ev.avg_duration, 0.0) AS DOUBLE) AS avg_duration
  FROM soil LEFT JOIN ev USING (device_id, plant)
),
sc AS (
  SELECT *, CAST(GREATEST(0, LEAST(100, 100
     - CASE WHEN avg_soil > 550 THEN 40 WHEN avg_soil > 450 THEN 20 WHEN avg_soil < 250 THEN 30 ELSE 0 END
     - CASE WHEN frequency < 0.5 THEN 25 WHEN frequency > 3 THEN 20 ELSE 0 END
     - CASE WHEN avg_duration > 300 THEN 15 WHEN avg_duration < 30 THEN 10 ELSE 0 END
     - CASE WHEN soil_stability > 150 THEN 15 ELSE 0 END
     - CASE WHEN latest_temperature > 35 OR latest_temperature < 10 THEN 20
            WHEN latest_temperature > 30 OR latest_temperature < 15 THEN 10 ELSE 0 END
     - CASE WHEN latest_humidity < 30 OR latest_humidity > 80 THEN 15 ELSE 0 END)) AS DOUBLE) AS score
  FROM m
)"""


# A1 ---------------------------------------------------------------------------

@register("daily_stats", f"""
SELECT device_id,
  COALESCE(ROUND(AVG(temperature), 2), 0.0) AS avg_temperature,
  COALESCE(ROUND(AVG(humidity), 2), 0.0) AS avg_humidity,
  COALESCE(ROUND(SUM(CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2), 0.0) AS soil1_dry_percent,
  COALESCE(ROUND(SUM(CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2), 0.0) AS soil2_dry_percent,
  COALESCE(ROUND(COUNT(CASE WHEN pump1 = 'ON' THEN 1 END) * 100.0 / COUNT(*), 2), 0.0) AS pump1_usage_percent,
  COALESCE(ROUND(COUNT(CASE WHEN pump2 = 'ON' THEN 1 END) * 100.0 / COUNT(*), 2), 0.0) AS pump2_usage_percent,
  CAST(COALESCE(SUM(pump1_duration), 0) AS BIGINT) AS total_pump1_time,
  CAST(COALESCE(SUM(pump2_duration), 0) AS BIGINT) AS total_pump2_time,
  CAST(COUNT(CASE WHEN water = 'NOT AVAILABLE' THEN 1 END) AS BIGINT) AS water_warnings
FROM readings WHERE ts > {A} - INTERVAL 1 DAY AND ts <= {A}
GROUP BY device_id""")
def q_daily_stats(spark, sf):
    return daily_stats(td.readings(spark, sf), td.as_of_lit())


# H4 (flagship) ------------------------------------------------------------------

@register("plant_health_report", f"""
WITH {HEALTH_SQL}
SELECT device_id, plant,
  CASE WHEN score IS NULL THEN 'Unknown' WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair'
       WHEN score >= 30 THEN 'Poor' ELSE 'Critical' END AS health,
  ROUND(COALESCE(score, 0.0), 1) AS score,
  ROUND(avg_soil, 1) AS avg_soil_moisture,
  CASE WHEN avg_soil > 450 THEN 'DRY' WHEN avg_soil IS NOT NULL THEN 'WET' END AS soil_status,
  ROUND(frequency, 2) AS watering_frequency_per_day,
  ROUND(avg_duration, 1) AS avg_watering_duration_seconds,
  total_water_time AS total_water_time_seconds,
  ROUND(soil_stability, 1) AS soil_stability,
  watering_events AS watering_events_count,
  latest_temperature AS current_temperature,
  latest_humidity AS current_humidity
FROM (SELECT DISTINCT device_id FROM readings WHERE ts > {A} - INTERVAL 30 DAY AND ts <= {A}) CROSS JOIN (SELECT unnest([1, 2])::INTEGER AS plant)
LEFT JOIN sc USING (device_id, plant)""")
def q_plant_health_report(spark, sf):
    # Devices heard of in the last 30 days: no scan of all history for the list.
    return plant_health_report(td.readings(spark, sf), td.as_of_lit(), with_recommendations=False, known_days=30)


@register("health_recommendations", f"""
WITH {HEALTH_SQL},
recs AS (
  SELECT device_id, plant, 'high' AS priority, 0 AS rk, 0 AS pos,
         'Plant ' || plant || ' soil is consistently dry. Increase watering frequency or duration.' AS message,
         'Increase watering by 30 seconds per session' AS action FROM sc WHERE avg_soil > 550
  UNION ALL
  SELECT device_id, plant, 'high', 0, 0, 'Plant ' || plant || ' soil is too wet. Reduce watering to prevent root rot.',
         'Reduce watering frequency by 50%' FROM sc WHERE NOT (avg_soil > 550) AND avg_soil < 250
  UNION ALL
  SELECT device_id, plant, 'medium', 1, 1, 'Infrequent watering detected for plant ' || plant || '.',
         'Water at least once daily' FROM sc WHERE frequency < 0.5
  UNION ALL
  SELECT device_id, plant, 'medium', 1, 1, 'Overwatering detected for plant ' || plant || '.',
         'Reduce watering to twice daily maximum' FROM sc WHERE NOT (frequency < 0.5) AND frequency > 2.5
  UNION ALL
  SELECT device_id, plant, 'low', 2, 2, 'Watering sessions for plant ' || plant || ' are too long.',
         'Reduce watering duration to 2-3 minutes max' FROM sc WHERE avg_duration > 300
  UNION ALL
  SELECT device_id, plant, 'medium', 1, 3, 'Plant ' || plant || ' soil moisture fluctuates too much.',
         'Maintain more consistent watering schedule' FROM sc WHERE soil_stability > 150
),
allrecs AS (
  SELECT * FROM recs
  UNION ALL
  SELECT device_id, plant, 'low', 2, 0, 'All parameters are within optimal ranges for plant ' || plant || '.',
         'Continue current watering schedule'
  FROM sc WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.device_id = sc.device_id AND r.plant = sc.plant)
)
SELECT device_id, plant, CAST(ROW_NUMBER() OVER (PARTITION BY device_id, plant ORDER BY rk, pos) AS INTEGER) AS position,
       priority, message, action
FROM allrecs""")
def q_health_recommendations(spark, sf):
    rep = plant_health_report(td.readings(spark, sf), td.as_of_lit(), known_days=30)
    return rep.select("device_id", "plant", F.posexplode("recommendations").alias("pos", "r")).select(
        "device_id", "plant", (F.col("pos") + 1).cast("int").alias("position"),
        "r.priority", "r.message", "r.action")


# A11 / H1 / H2 as their own keys --------------------------------------------------

@register("plant_health_metrics", f"""
WITH {HEALTH_SQL}
SELECT device_id, plant, ROUND(avg_soil, 6) AS avg_soil, ROUND(soil_stability, 6) AS soil_stability,
       watering_events, ROUND(frequency, 6) AS frequency, ROUND(avg_duration, 6) AS avg_duration,
       total_water_time, latest_temperature, latest_humidity
FROM m""")
def q_plant_health_metrics(spark, sf):
    from hydrospark.functions.columns import round_d
    from hydrospark.operators.filters import trailing_window
    from hydrospark.operators.sequences import watering_sessions
    from hydrospark.operators.stats import plant_health_metrics
    w = trailing_window(td.readings(spark, sf), td.as_of_lit(), 7)
    m = plant_health_metrics(w, watering_sessions(w), td.as_of_lit(), 7)
    return m.select("device_id", "plant", *[round_d(F.col(c), 6).alias(c) for c in
                                            ("avg_soil", "soil_stability")],
                    "watering_events", *[round_d(F.col(c), 6).alias(c) for c in ("frequency", "avg_duration")],
                    "total_water_time", "latest_temperature", "latest_humidity")


@register("health_score", f"WITH {HEALTH_SQL} SELECT device_id, plant, score FROM sc")
def q_health_score(spark, sf):
    from hydrospark.plans.plant_health import plant_health_scores
    return plant_health_scores(td.readings(spark, sf), td.as_of_lit()).select("device_id", "plant", "score")


@register("health_status", f"""
WITH {HEALTH_SQL}
SELECT device_id, plant, CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair'
       WHEN score >= 30 THEN 'Poor' ELSE 'Critical' END AS health FROM sc""")
def q_health_status(spark, sf):
    from hydrospark.plans.plant_health import plant_health_scores
    return plant_health_scores(td.readings(spark, sf), td.as_of_lit()).select("device_id", "plant", "health")
