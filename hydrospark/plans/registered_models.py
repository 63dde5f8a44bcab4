"""Registered queries: stats (A2-A12), features (M1-M6), models (M7-M13,
M20), forecast (J3, M14-M19) and sink projections (K3-K6, K13-K15)."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from hydrospark.functions import columns as C
from hydrospark.operators import features as FE
from hydrospark.operators import stats as ST
from hydrospark.operators.maintenance import cooldown_upsert, retain_days
from hydrospark.operators.regression import linear_regression
from hydrospark.plans import forecast as FC
from hydrospark.plans import training as TR
from hydrospark.plans.dashboard import dashboard
from hydrospark.plans.registered_rows import _WEATHER_PARSED_SQL
from hydrospark.plans.registry import ORACLE, register
from hydrospark.session import scratch_path
from hydrospark.sinks.writers import append_readings, retain_table
from hydrospark.sources import legacy, testdata as td, weather

A = td.AS_OF_SQL
R = td.readings
W = "PARTITION BY device_id ORDER BY ts, reading_id"
PI2 = "(2 * pi())"


WEATHER_CTES = _WEATHER_PARSED_SQL.strip().removeprefix("WITH").strip()

# A2-A6 -------------------------------------------------------------------------------

@register("dashboard", f"""
WITH {WEATHER_CTES},
wl AS (SELECT * FROM wparsed ORDER BY ts DESC, id DESC LIMIT 1),
s AS (
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
  FROM readings WHERE ts > {A} - INTERVAL 1 DAY AND ts <= {A} GROUP BY device_id),
l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS rn
                     FROM readings) WHERE rn = 1)
SELECT l.device_id, COALESCE(s.avg_temperature, 0.0) AS avg_temperature, COALESCE(s.avg_humidity, 0.0) AS avg_humidity,
       COALESCE(s.soil1_dry_percent, 0.0) AS soil1_dry_percent, COALESCE(s.soil2_dry_percent, 0.0) AS soil2_dry_percent,
       COALESCE(s.pump1_usage_percent, 0.0) AS pump1_usage_percent,
       COALESCE(s.pump2_usage_percent, 0.0) AS pump2_usage_percent,
       COALESCE(s.total_pump1_time, 0) AS total_pump1_time, COALESCE(s.total_pump2_time, 0) AS total_pump2_time,
       COALESCE(s.water_warnings, 0) AS water_warnings,
       strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS latest_timestamp, l.temperature AS latest_temperature,
       l.humidity AS latest_humidity, l.soil1 AS latest_soil1, l.soil2 AS latest_soil2, l.water AS latest_water,
       l.pump1 AS latest_pump1, l.pump2 AS latest_pump2, wl.temperature AS weather_temperature,
       wl.precipitation AS weather_precipitation, wl.rain_forecast <> 0 AS weather_rain_forecast,
       wl.weather_description AS weather_description, wl.city AS location_city, true AS model_available
FROM l LEFT JOIN s USING (device_id) LEFT JOIN wl ON true""")
def q_dashboard(spark, sf):
    payloads = weather.weather_payloads_from_events(td.load(spark, sf, "events"))
    w = weather.newest_weather_row(payloads)
    loc = payloads.select("id", "ts", "city")  # a stored location per weather fetch
    d = dashboard(R(spark, sf), td.as_of_lit(), weather=w, location=loc, model_available=True)
    return d.select("*", *[F.col(f"weather.{c}").alias(f"weather_{c}") for c in (
        "temperature", "precipitation", "rain_forecast", "description")],
        F.col("location.city").alias("location_city")).drop("weather", "location")


RECENT_SQL = f"""
recent AS (
  SELECT device_id,
    COALESCE(NULLIF(AVG(temperature), 0), 25.0) AS avg_temperature,
    COALESCE(NULLIF(AVG(humidity), 0), 60.0) AS avg_humidity,
    COALESCE(NULLIF(SUM(CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) * 1.0 / COUNT(*), 0), 0.5) AS soil1_dry_ratio,
    COALESCE(NULLIF(SUM(CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END) * 1.0 / COUNT(*), 0), 0.5) AS soil2_dry_ratio
  FROM readings
  WHERE ts > {A} - INTERVAL 3 DAY AND ts <= {A}
    AND temperature IS NOT NULL AND humidity IS NOT NULL AND soil1 IS NOT NULL AND soil2 IS NOT NULL
  GROUP BY device_id
)"""


@register("recent_averages", f"""
WITH {RECENT_SQL.strip()}
SELECT device_id, ROUND(avg_temperature, 6) AS avg_temperature, ROUND(avg_humidity, 6) AS avg_humidity,
       ROUND(soil1_dry_ratio, 6) AS soil1_dry_ratio, ROUND(soil2_dry_ratio, 6) AS soil2_dry_ratio,
       ROUND((soil1_dry_ratio + soil2_dry_ratio) / 2.0, 6) AS avg_soil_dry FROM recent""")
def q_recent_averages(spark, sf):
    r = ST.recent_averages(R(spark, sf), td.as_of_lit())
    return r.select("device_id", *[C.round_d(F.col(c), 6).alias(c) for c in
                                   ("avg_temperature", "avg_humidity", "soil1_dry_ratio", "soil2_dry_ratio",
                                    "avg_soil_dry")])


@register("table_counts", """
SELECT 'readings' AS table_name, COUNT(*) AS row_count FROM readings
UNION ALL SELECT 'commands', COUNT(*) FROM commands""")
def q_table_counts(spark, sf):
    return ST.table_counts({"readings": R(spark, sf), "commands": td.commands(spark, sf)})


@register("stored_table_counts", """
SELECT 'readings' AS table_name, COUNT(*) AS row_count FROM readings
UNION ALL SELECT 'training_log', COUNT(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'predictions', COUNT(*) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'email_cooldown', COUNT(DISTINCT (user_id, k % 2)) FROM events_k WHERE event_type = 'signup'""")
def q_stored_table_counts(spark, sf):
    # The four stored tables; attempts, runs and mails taken from events.
    e = td.load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    mails = e.filter("event_type = 'signup'").select(
        F.col("user_id").alias("device_id"), (k % 2).cast("string").alias("alert_type"), F.col("ts").alias("last_sent"))
    return ST.table_counts({"readings": R(spark, sf), "training_log": e.filter("event_type = 'error'"),
                            "predictions": e.filter("event_type = 'purchase'"),
                            "email_cooldown": cooldown_upsert(mails.limit(0), mails, keys=("device_id", "alert_type"))})


def _training_log(spark):
    # Training attempts recorded by the scheduler: the newest success is the
    # reference point for A5 / M13 / M20.
    rows = [(1, "2024-01-20 06:00:00", "Random Forest Classifier", 0.91, 0.52, 0.09, 4200, "success", "ok"),
            (2, "2024-01-25 06:00:00", "none", 0.0, 0.0, 0.0, 0, "failed", "Insufficient training data"),
            (3, "2024-01-28 06:00:00", "Random Forest Classifier", 0.93, 0.55, 0.07, 5100, "success", "ok")]
    df = spark.createDataFrame(rows, "id long, ts string, model_name string, accuracy double, r2_score double, "
                                     "mse double, samples_used int, status string, message string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_LOG_SQL = """training_log AS (SELECT * FROM (VALUES
  (1, TIMESTAMP '2024-01-20 06:00:00', 'success'), (2, TIMESTAMP '2024-01-25 06:00:00', 'failed'),
  (3, TIMESTAMP '2024-01-28 06:00:00', 'success')) AS t(id, ts, status))"""


@register("samples_since_training", f"""
WITH {_LOG_SQL},
last AS (SELECT COALESCE(MAX(ts) FILTER (WHERE status = 'success'), TIMESTAMP '2000-01-01 00:00:00') AS last_success
         FROM training_log)
SELECT last_success, (SELECT COUNT(*) FROM readings, last l2 WHERE readings.ts > l2.last_success) AS new_samples
FROM last""")
def q_samples_since_training(spark, sf):
    return ST.samples_since_training(R(spark, sf), _training_log(spark))


@register("should_retrain", f"""
WITH {_LOG_SQL},
last AS (SELECT COALESCE(MAX(ts) FILTER (WHERE status = 'success'), TIMESTAMP '2000-01-01 00:00:00') AS last_success
         FROM training_log),
c AS (SELECT last_success, (SELECT COUNT(*) FROM readings, last l2 WHERE readings.ts > l2.last_success) AS new_samples
      FROM last)
SELECT *, new_samples >= 10 AS retrain FROM c""")
def q_should_retrain(spark, sf):
    return ST.should_retrain(ST.samples_since_training(R(spark, sf), _training_log(spark)), model_exists=True)


@register("dataset_summary", """
SELECT device_id, COUNT(*) AS rows, MIN(ts) AS first_ts, MAX(ts) AS last_ts,
       CAST(SUM(CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END) AS BIGINT) AS pump_on_rows,
       ROUND(AVG(CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END) * 100.0, 6) AS pump_on_percent
FROM readings GROUP BY device_id""")
def q_dataset_summary(spark, sf):
    return ST.dataset_summary(R(spark, sf))


# A rule-based pump predictor scored against the recorded state --

SCORED_SQL = """
scored AS (SELECT device_id, CASE WHEN pump1 = 'ON' THEN 1 ELSE 0 END AS actual,
                  CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END AS predicted FROM readings)"""


def _scored(spark, sf):
    return R(spark, sf).select("device_id", C.is_on("pump1").alias("actual"), C.is_dry("soil1").alias("predicted"))


@register("confusion_matrix", f"""
WITH {SCORED_SQL.strip()},
cnt AS (SELECT COUNT(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp,
               COUNT(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
               COUNT(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn,
               COUNT(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn FROM scored)
SELECT 1 AS actual, 1 AS predicted, tp AS n FROM cnt UNION ALL SELECT 0, 1, fp FROM cnt
UNION ALL SELECT 1, 0, fn FROM cnt UNION ALL SELECT 0, 0, tn FROM cnt""")
def q_confusion_matrix(spark, sf):
    return ST.confusion_matrix(_scored(spark, sf))


METRICS_SQL = f"""
WITH {SCORED_SQL.strip()},
cnt AS (SELECT CAST(COUNT(*) FILTER (WHERE actual = 1 AND predicted = 1) AS DOUBLE) AS tp,
               CAST(COUNT(*) FILTER (WHERE actual = 0 AND predicted = 1) AS DOUBLE) AS fp,
               CAST(COUNT(*) FILTER (WHERE actual = 1 AND predicted = 0) AS DOUBLE) AS fn,
               CAST(COUNT(*) FILTER (WHERE actual = 0 AND predicted = 0) AS DOUBLE) AS tn FROM scored)
SELECT COALESCE((tp + tn) / NULLIF(tp + tn + fp + fn, 0), 0) * 100.0 AS accuracy_pct,
       COALESCE(tp / NULLIF(tp + fp, 0), 0) * 100.0 AS precision_pct,
       COALESCE(tp / NULLIF(tp + fn, 0), 0) * 100.0 AS recall_pct,
       COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) * 100.0 AS f1_pct
FROM cnt"""


@register("binary_metrics", METRICS_SQL)
def q_binary_metrics(spark, sf):
    return ST.binary_metrics(_scored(spark, sf))


@register("metrics_csv", "SELECT accuracy_pct AS \"Accuracy (%)\", precision_pct AS \"Precision (%)\", "
          "recall_pct AS \"Recall (%)\", f1_pct AS \"F1-Score (%)\" FROM (" + METRICS_SQL + ")")
def q_metrics_csv(spark, sf):
    from hydrospark.sinks.writers import metrics_csv_frame
    return metrics_csv_frame(ST.binary_metrics(_scored(spark, sf)))


@register("regression_metrics", f"""
WITH s AS (SELECT CAST(CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS DOUBLE) AS y,
                  GREATEST(0.0, LEAST(1.0, {"((CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END)) / 2.0"})) AS p
           FROM readings)
SELECT ROUND(AVG((y - p) * (y - p)), 9) AS mse,
       ROUND(CASE WHEN VAR_POP(y) > 0 THEN 1.0 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*))
                  WHEN SUM((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END, 9) AS r2
FROM s""")
def q_regression_metrics(spark, sf):
    s = R(spark, sf).select(C.any_pump_on().cast("double").alias("label"), C.combined_dryness().alias("prediction"))
    m = ST.regression_metrics(s, "label", "prediction")
    return m.select(C.round_d(F.col("mse"), 9).alias("mse"), C.round_d(F.col("r2"), 9).alias("r2"))


@register("regression_metrics_by_hour", f"""
WITH s AS (SELECT device_id, date_trunc('hour', ts) AS hour,
                  CAST(CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS DOUBLE) AS y,
                  {"((CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END)) / 2.0"} AS p
           FROM readings)
SELECT device_id, hour, ROUND(AVG((y - p) * (y - p)), 9) AS mse,
       ROUND(CASE WHEN VAR_POP(y) > 0 THEN 1.0 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*))
                  WHEN SUM((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END, 9) AS r2
FROM s GROUP BY device_id, hour""")
def q_regression_metrics_by_hour(spark, sf):
    # A10 per device and hour: constant labels, right and wrong ones, occur here.
    s = R(spark, sf).select("device_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                            C.any_pump_on().cast("double").alias("label"), C.combined_dryness().alias("prediction"))
    m = ST.regression_metrics(s, "label", "prediction", keys=("device_id", "hour"))
    return m.select("device_id", "hour", C.round_d(F.col("mse"), 9).alias("mse"), C.round_d(F.col("r2"), 9).alias("r2"))


@register("class_balance", """
WITH c AS (SELECT CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS label, COUNT(*) AS n_class
           FROM readings GROUP BY 1)
SELECT label, n_class, (SELECT SUM(n_class) FROM c) / ((SELECT COUNT(*) FROM c) * n_class) AS weight FROM c""")
def q_class_balance(spark, sf):
    return ST.class_balance(R(spark, sf).select(C.any_pump_on().alias("label")), "label")


# M1-M6 ---------------------------------------------------------------------------------

def _sincos(expr: str, period: int, name: str) -> str:
    return f"sin({PI2} * {expr} / {period}.0) AS {name}_sin, cos({PI2} * {expr} / {period}.0) AS {name}_cos"


def _seq_sql(stems: list[tuple[str, str]], lags, windows) -> str:
    out = []
    for s, c in stems:
        out += [f"LAG({c}, {n}) OVER ({W}) AS {s}_lag_{n}" for n in lags]
        out += [f"CASE WHEN COUNT({c}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} "
                f"THEN AVG({c}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {s}_ma_{n}"
                for n in windows]
    return ",\n  ".join(out)


def _round_cols(cols: list[str], keep=("reading_id", "device_id", "ts", "target", "actual", "water_available")) -> str:
    return ", ".join(c if c in keep else f"ROUND({c}, 6) AS {c}" for c in cols)


def _round_df(df, keep=("reading_id", "device_id", "ts", "target", "actual", "water_available")):
    return df.select(*[F.col(c) if c in keep else C.round_d(F.col(c), 6).alias(c) for c in df.columns])


_SCHED_COLS = ["reading_id", "device_id", "ts", *FE.SCHEDULE_FEATURES, "target"]


@register("features_schedule", f"""
WITH w AS (SELECT * FROM readings WHERE ts > {A} - INTERVAL 30 DAY AND ts <= {A}
             AND temperature IS NOT NULL AND humidity IS NOT NULL AND soil1 IS NOT NULL AND soil2 IS NOT NULL),
b AS (SELECT reading_id, device_id, ts, temperature, humidity,
             ((CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END)) / 2.0 AS soil_dry,
             hour(ts) AS hour, dayofweek(ts) AS dow, month(ts) AS month,
             CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS target,
             CASE WHEN water = 'AVAILABLE' THEN 1 ELSE 0 END AS water_available
      FROM w WHERE (SELECT COUNT(*) FROM w) >= 10),
f AS (SELECT *, {_sincos('hour', 24, 'hour')}, {_sincos('dow', 7, 'day')}, {_sincos('month', 12, 'month')},
             temperature * humidity / 100.0 AS temp_humidity_interaction,
  {_seq_sql([('temp', 'temperature'), ('humidity', 'humidity'), ('soil_dry', 'soil_dry')], (1, 2, 3), (3, 6))}
      FROM b),
g AS (SELECT * FROM f WHERE {' AND '.join(f'{s}_{k} IS NOT NULL' for s in ('temp', 'humidity', 'soil_dry')
                                          for k in ('lag_1', 'lag_2', 'lag_3', 'ma_3', 'ma_6'))})
SELECT {_round_cols(_SCHED_COLS)} FROM g WHERE (SELECT COUNT(*) FROM g) >= 10""")
def q_features_schedule(spark, sf):
    return _round_df(FE.features_schedule(R(spark, sf), td.as_of_lit()))


_OFF_COLS = ["reading_id", "device_id", "ts", *FE.OFFLINE_FEATURES, "target"]


@register("features_offline", f"""
WITH {legacy.LEGACY_SQL.strip()},
w AS (SELECT * FROM legacy WHERE timestamp > {A} - INTERVAL 90 DAY AND timestamp <= {A}
        AND temperature IS NOT NULL AND humidity IS NOT NULL AND soil IS NOT NULL),
b AS (SELECT reading_id, device_id, timestamp AS ts, temperature, humidity, CAST(soil AS DOUBLE) AS soil,
             hour(timestamp) AS hour, dayofweek(timestamp) AS dow,
             CASE WHEN pump = 'ON' THEN 1 ELSE 0 END AS target
      FROM w WHERE (SELECT COUNT(*) FROM w) >= 50),
f AS (SELECT *, {_sincos('hour', 24, 'hour')}, {_sincos('dow', 7, 'day')},
             temperature * humidity AS temp_humidity_interaction, humidity * soil AS humidity_soil_interaction,
  {_seq_sql([('temp', 'temperature'), ('humidity', 'humidity'), ('soil', 'soil')], (1, 2, 3, 24), (3, 6, 12, 24))}
      FROM b)
SELECT {_round_cols(_OFF_COLS)} FROM f
WHERE {' AND '.join(f'{s}_{k} IS NOT NULL' for s in ('temp', 'humidity', 'soil')
                    for k in ('lag_1', 'lag_2', 'lag_3', 'lag_24', 'ma_3', 'ma_6', 'ma_12', 'ma_24'))}""")
def q_features_offline(spark, sf):
    lg = legacy.legacy_from_events(td.load(spark, sf, "events"))
    return _round_df(FE.features_offline(lg, td.as_of_lit()))


_EVAL_COLS = ["reading_id", "device_id", "ts", *FE.EVAL_FEATURES, "actual"]


@register("features_eval", f"""
WITH {legacy.LEGACY_SQL.strip()},
w AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY timestamp, reading_id) AS pos
                     FROM legacy WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND soil IS NOT NULL)
      WHERE pos <= 500),
b AS (SELECT reading_id, device_id, timestamp AS ts, temperature, humidity, CAST(soil AS DOUBLE) AS soil,
             CASE WHEN water = 'AVAILABLE' THEN 1 ELSE 0 END AS water_available,
             CASE WHEN pump = 'ON' THEN 1 ELSE 0 END AS actual,
             hour(timestamp) AS hour, isodow(timestamp) - 1 AS dow, month(timestamp) AS month FROM w),
f AS (SELECT *, {_sincos('hour', 24, 'hour')}, {_sincos('dow', 7, 'day')}, {_sincos('month', 12, 'month')},
             temperature * humidity / 100.0 AS temp_humidity_interaction,
             humidity * soil / 1000.0 AS humidity_soil_interaction,
  {_seq_sql([('temp', 'temperature'), ('humidity', 'humidity'), ('soil', 'soil')], (1,), (3,))}
      FROM b)
SELECT {_round_cols(_EVAL_COLS)} FROM f
WHERE temp_lag_1 IS NOT NULL AND humidity_lag_1 IS NOT NULL AND soil_lag_1 IS NOT NULL
  AND temp_ma_3 IS NOT NULL AND humidity_ma_3 IS NOT NULL AND soil_ma_3 IS NOT NULL""")
def q_features_eval(spark, sf):
    lg = legacy.legacy_from_events(td.load(spark, sf, "events"))
    return _round_df(FE.features_eval(lg))


@register("standardize", f"""
WITH b AS (SELECT reading_id, temperature, humidity FROM readings),
s AS (SELECT AVG(temperature) AS mt, STDDEV_POP(temperature) AS st, AVG(humidity) AS mh, STDDEV_POP(humidity) AS sh FROM b)
SELECT reading_id, ROUND((temperature - mt) / CASE WHEN st > 0 THEN st ELSE 1.0 END, 6) AS temperature,
       ROUND((humidity - mh) / CASE WHEN sh > 0 THEN sh ELSE 1.0 END, 6) AS humidity
FROM b, s""")
def q_standardize(spark, sf):
    b = R(spark, sf).select("reading_id", "temperature", "humidity")
    z = FE.standardize(b, FE.scaler_stats(b, ["temperature", "humidity"]), ["temperature", "humidity"])
    return z.select("reading_id", C.round_d(F.col("temperature"), 6).alias("temperature"),
                    C.round_d(F.col("humidity"), 6).alias("humidity"))


@register("split_stratified", """
WITH f AS (SELECT reading_id, CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS target,
                  ('0x' || substr(md5(CAST(reading_id AS VARCHAR) || ':42'), 1, 15))::BIGINT AS h FROM readings),
c AS (SELECT target, COUNT(*) AS m, SUM(COUNT(*)) OVER () AS n FROM f GROUP BY target),
t AS (SELECT *, n - CEIL(0.2::DOUBLE * n)::BIGINT AS n_train FROM c),
s AS (SELECT *, m * n_train // n AS base,
             ROW_NUMBER() OVER (ORDER BY m * n_train % n DESC, target) AS place FROM t),
k AS (SELECT target, m - base - CASE WHEN place <= n_train - (SELECT SUM(base) FROM s) THEN 1 ELSE 0 END AS test_rows FROM s)
SELECT reading_id, target, ROW_NUMBER() OVER (PARTITION BY target ORDER BY h) <= test_rows AS is_test
FROM f JOIN k USING (target)""")
def q_split_stratified(spark, sf):
    f = R(spark, sf).select("reading_id", C.any_pump_on().alias("target"))
    return FE.split_stratified(f, "target").select("reading_id", "target", "is_test")


@register("split_chronological", """
SELECT device_id, reading_id,
  ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts, reading_id)
    > COUNT(*) OVER (PARTITION BY device_id) - CEIL(COUNT(*) OVER (PARTITION BY device_id) * 0.2) AS is_test
FROM readings""")
def q_split_chronological(spark, sf):
    return FE.split_chronological(R(spark, sf).select("device_id", "reading_id", "ts")).select(
        "device_id", "reading_id", "is_test")


_N = len(FE.OFFLINE_FEATURES)


@register("linear_regression", f"""
WITH RECURSIVE fs AS ({ORACLE['features_offline']}),
t AS (SELECT *, ROW_NUMBER() OVER d > COUNT(*) OVER (PARTITION BY device_id)
                  - CEIL(COUNT(*) OVER (PARTITION BY device_id) * 0.2::DOUBLE) AS is_test
      FROM fs WINDOW d AS (PARTITION BY device_id ORDER BY ts, reading_id)),
st AS (SELECT {", ".join(f"AVG({c}) AS a_{c}, STDDEV_POP({c}) AS s_{c}" for c in FE.OFFLINE_FEATURES)}
       FROM t WHERE NOT is_test),
z AS (SELECT is_test, target::DOUBLE AS y,
             [{", ".join(f"({c} - a_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END" for c in FE.OFFLINE_FEATURES)}] AS x
      FROM t, st),
ym AS (SELECT AVG(y) AS b FROM z WHERE NOT is_test),
mo AS (SELECT i, j, SUM(x[i] * (CASE WHEN j <= {_N} THEN x[j] ELSE y - b END)) AS v
       FROM z, ym, range(1, {_N + 1}) r(i), range(1, {_N + 2}) q(j) WHERE NOT is_test GROUP BY i, j),
gj AS (SELECT 0 AS k, (SELECT list(l ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS l FROM mo GROUP BY i)) AS m
       UNION ALL
       SELECT k + 1, list_transform(range(1, {_N + 1}), lambda i: CASE WHEN i = k + 1 THEN p
                       ELSE list_transform(range(1, {_N + 2}), lambda j: m[i][j] - m[i][k + 1] * p[j]) END)
       FROM (SELECT k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) AS p FROM gj WHERE k < {_N})),
co AS (SELECT list_transform(m, lambda l: l[{_N + 1}]) AS w FROM gj WHERE k = {_N}),
pr AS (SELECT y, GREATEST(0.0, LEAST(1.0, b + list_dot_product(x, w))) AS p FROM z, ym, co WHERE is_test)
SELECT name, ROUND(w[i], 6) AS value
FROM co, (SELECT unnest([{", ".join(f"'{c}'" for c in FE.OFFLINE_FEATURES)}]) AS name, unnest(range(1, {_N + 1})) AS i)
UNION ALL SELECT 'intercept', ROUND(b, 6) FROM ym
UNION ALL SELECT 'mse', ROUND(AVG((y - p) * (y - p)), 6) FROM pr
UNION ALL SELECT 'r2', ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 6) FROM pr""", raw_sql=True)
def q_linear_regression(spark, sf):
    # M8's linear model and its test metrics, on features rounded as in the SQL.
    f = FE.split_chronological(q_features_offline(spark, sf))
    train, test = f.filter("not is_test"), f.filter("is_test")
    stats = FE.scaler_stats(train, FE.OFFLINE_FEATURES)
    fit = linear_regression(FE.standardize(train, stats, FE.OFFLINE_FEATURES), FE.OFFLINE_FEATURES, "target")
    scored = FE.standardize(test, stats, FE.OFFLINE_FEATURES).select(
        F.col("target").cast("double").alias("label"), fit.predict().alias("prediction"))
    m = ST.regression_metrics(scored, "label", "prediction")
    told = [*zip(fit.features, fit.coefficients), ("intercept", fit.intercept)]
    rows = spark.createDataFrame(told, "name string, value double").unionByName(
        m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("mse", "r2")]))))
    return rows.select("name", C.round_d(F.col("value"), 6).alias("value"))


# T11, K13, K14, M20 over models that SQL can score: three fixed rules for "any pump on".

_RULES = (("soil1", "CASE WHEN soil1 = 'DRY' THEN 1.0 ELSE 0.0 END"), ("soil2", "CASE WHEN soil2 = 'DRY' THEN 1.0 ELSE 0.0 END"),
          ("both", "((CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END)) / 2.0"),
          ("mean", "((CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END)) * 0.5"))
_RULES_SQL = "y AS (SELECT CAST(CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS DOUBLE) AS y, * FROM readings),\nrules AS (" \
    + " UNION ALL ".join(
        f"SELECT {i} AS pos, '{name}' AS name, ROUND(AVG((y - ({p})) * (y - ({p}))), 9) AS mse, "
        f"ROUND(1.0 - SUM((y - ({p})) * (y - ({p}))) / (VAR_POP(y) * COUNT(*)), 9) AS r2 FROM y"
        for i, (name, p) in enumerate(_RULES)) + "),\nbest AS (SELECT * FROM rules ORDER BY r2 DESC, pos LIMIT 1)"


def _rule_metrics(spark, sf):
    r = R(spark, sf)
    soil = {"soil1": C.is_dry("soil1").cast("double"), "soil2": C.is_dry("soil2").cast("double"),
            "both": C.combined_dryness(), "mean": C.combined_dryness()}
    out = None
    for pos, (name, _) in enumerate(_RULES):
        m = ST.regression_metrics(r.select(C.any_pump_on().cast("double").alias("label"), soil[name].alias("prediction")))
        m = m.select(F.lit(pos).alias("pos"), F.lit(name).alias("name"), C.round_d(F.col("mse"), 9).alias("mse"),
                     C.round_d(F.col("r2"), 9).alias("r2"))
        out = m if out is None else out.unionByName(m)
    return out


@register("best_rule", f"WITH {_RULES_SQL} SELECT pos, name, mse, r2 FROM best")
def q_best_rule(spark, sf):
    # The largest r2; the last two rules tie and the first of them is listed first.
    from hydrospark.operators.latest import best_model
    return best_model(_rule_metrics(spark, sf), "r2", "name", "pos").select("pos", "name", "mse", "r2")


@register("rules_report", f"""
WITH {_RULES_SQL}
SELECT '{td.AS_OF}' AS training_date, (SELECT COUNT(*) FROM rules) AS models_trained, name, r2 AS r2_score, mse,
       0 AS n_metrics, true AS no_importance FROM best""")
def q_rules_report(spark, sf):
    # K13, written as JSON and read back.
    from hydrospark.sinks.writers import training_report_json
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    training_report_json(TR.training_report(_rule_metrics(spark, sf), None, td.AS_OF), path)
    back = spark.read.schema("training_date string, models_trained long, best_model struct<name:string,r2_score:double,mse:double>, "
                             "performance_metrics map<string,double>, feature_importance map<string,double>").json(path)
    return back.select("training_date", "models_trained", "best_model.*",
                       F.coalesce(F.size("performance_metrics"), F.lit(0)).alias("n_metrics"),
                       F.col("feature_importance").isNull().alias("no_importance"))


_LOG_STATUS = "CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'success' END"


@register("training_log_rows", f"""
SELECT user_id AS device_id, COUNT(*) AS attempts, COUNT(*) FILTER ({_LOG_STATUS} = 'success') AS successes,
       SUM(k) AS samples, ROUND(MAX(value / 500.0), 9) AS best_accuracy
FROM events_k WHERE event_type = 'error' GROUP BY 1""")
def q_training_log_rows(spark, sf):
    # Attempts taken from ``error`` events, appended to the log in two batches and read back.
    from hydrospark.sinks.writers import append_training_log
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    for part in (0, 1):
        tried = _attempts(spark, sf).where(F.col("k") % 2 == part)
        append_training_log(TR.training_log_row(tried, F.col("ts"), ("device_id",)), path)
    return spark.read.parquet(path).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "success").alias("successes"),
        F.sum("samples_used").alias("samples"), C.round_d(F.max("accuracy"), 9).alias("best_accuracy"))


def _attempts(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = td.load(spark, sf, "events").filter("event_type = 'error'").withColumn("k", k)
    return e.select(
        F.col("user_id").alias("device_id"), "event_id", "k", "ts", F.lit("rule").alias("model_name"),
        (F.col("value") / 500.0).alias("accuracy"), (F.col("value") / 1000.0).alias("r2_score"), F.lit(0.5).alias("mse"),
        F.col("k").alias("samples_used"), F.when(F.col("k") % 3 == 0, "failed").otherwise("success").alias("status"),
        F.lit("").alias("message"))


@register("model_status_log", f"""
WITH last AS (SELECT * FROM events_k WHERE event_type = 'error' AND {_LOG_STATUS} = 'success'
              ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT true AS model_exists, value / 500.0 AS accuracy, value / 1000.0 AS r2_score, CAST(k AS INTEGER) AS samples_used,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_trained, {len(FE.SCHEDULE_FEATURES)} AS feature_count FROM last""")
def q_model_status_log(spark, sf):
    # M20 over the log of ``error`` events.
    log = TR.training_log_row(_attempts(spark, sf), F.col("ts"), ("event_id",)).withColumn("id", F.col("event_id"))
    return TR.model_status(log, len(FE.SCHEDULE_FEATURES))


# M7-M12, M20, K13, K14 (model-based: rows-only checks) ------------------------------

_TRAINED: dict = {}


def _version(spark, sf):
    # Changed files are a new version, so a model never outlives its data.
    files = td.load(spark, sf, "events").select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    seen = files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()[0]  # one row
    return spark.sparkContext.applicationId, sf, seen


def _trained(spark, sf):
    # Several registered queries score with the same model; train it once per
    # session and data folder (the fitted model lives on the driver anyway).
    key = _version(spark, sf)
    if key not in _TRAINED:
        f = FE.features_schedule(R(spark, sf), td.as_of_lit())
        _TRAINED[key] = TR.train_pump_classifier(f, FE.SCHEDULE_FEATURES)
    return _TRAINED[key]


@register("train_pump_classifier")
def q_train_pump_classifier(spark, sf):
    return _trained(spark, sf).metrics


@register("score_readings")
def q_score_readings(spark, sf):
    t = _trained(spark, sf)
    f = FE.features_schedule(R(spark, sf), td.as_of_lit())
    s = TR.score(t.model, FE.standardize(f, t.stats, FE.SCHEDULE_FEATURES))
    return s.select("reading_id", "device_id", "target", "p_on", "predicted")


_ENSEMBLES: dict = {}


def _ensemble(spark, sf):
    key = _version(spark, sf)
    if key not in _ENSEMBLES:
        lg = legacy.legacy_from_events(td.load(spark, sf, "events"))
        f = FE.features_offline(lg, td.as_of_lit())
        _ENSEMBLES[key] = (f, TR.train_regressor_ensemble(f, FE.OFFLINE_FEATURES))
    return _ENSEMBLES[key]


@register("train_regressor_ensemble")
def q_train_regressor_ensemble(spark, sf):
    return _ensemble(spark, sf)[1][0]


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, (metrics, models) = _ensemble(spark, sf)
    return TR.feature_importance(models["random_forest"], FE.OFFLINE_FEATURES)


@register("training_report")
def q_training_report(spark, sf):
    _, (metrics, models) = _ensemble(spark, sf)
    from hydrospark.operators.latest import best_model
    best = best_model(metrics, "r2", "name", "pos").first()["name"]  # one row
    imp = TR.feature_importance(models[best], FE.OFFLINE_FEATURES)
    return TR.training_report(metrics, imp, td.AS_OF)


@register("train_health_classifier")
def q_train_health_classifier(spark, sf):
    lg = legacy.legacy_from_events(td.load(spark, sf, "events")).withColumn("pump01", C.pump_map("pump"))
    rows = lg.select("soil", "temperature", "humidity", "pump01",
                     C.plant_health_label("soil", "pump01").alias("health"))
    model = TR.train_health_classifier(rows)
    return model.transform(rows).groupBy("health", "prediction").count()


@register("save_load_model")
def q_save_load_model(spark, sf):
    t = _trained(spark, sf)
    path = scratch_path(spark, f"models/pump_classifier-{uuid.uuid4().hex}")
    TR.save_model(t, path, td.AS_OF)
    model, stats, info = TR.load_model(spark, path)
    f = FE.features_schedule(R(spark, sf), td.as_of_lit())
    scored = TR.score(model, FE.standardize(f, stats, FE.SCHEDULE_FEATURES))
    return scored.agg(F.count(F.lit(1)).alias("scored_rows"), F.avg("p_on").alias("mean_p_on")).crossJoin(
        info.select("trained_at", "feature_count"))


@register("append_training_log")
def q_append_training_log(spark, sf):
    return TR.training_log_row(_trained(spark, sf).metrics, td.as_of_lit())


@register("model_status")
def q_model_status(spark, sf):
    return TR.model_status(_training_log(spark).unionByName(
        TR.training_log_row(_trained(spark, sf).metrics, td.as_of_lit()).withColumn("id", F.lit(4).cast("long"))),
        len(FE.SCHEDULE_FEATURES))


@register("forecast")
def q_forecast(spark, sf):
    t = _trained(spark, sf)
    scorer = FC.model_scorer(t.model, t.stats, FE.SCHEDULE_FEATURES)
    fc = FC.forecast(R(spark, sf), td.as_of_lit(), scorer, FE.SCHEDULE_FEATURES)
    return FC.save_forecast(fc, td.as_of_lit())


# Forecast with the hourly-frequency estimate (SQL) ----------

_HOURS = [(i, h) for i, h in enumerate([6, 9, 12, 15, 18, 21])]

_GRID_SQL = f"""
{RECENT_SQL.strip()},
devices AS (SELECT DISTINCT device_id FROM readings),
lw AS (SELECT device_id, CASE WHEN water = 'AVAILABLE' THEN 1 ELSE 0 END AS water_available
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS rn
             FROM readings WHERE water IS NOT NULL) WHERE rn = 1),
inputs AS (SELECT d.device_id, COALESCE(r.avg_temperature, 25.0) AS avg_temperature,
                  COALESCE(r.avg_humidity, 60.0) AS avg_humidity,
                  COALESCE((r.soil1_dry_ratio + r.soil2_dry_ratio) / 2.0, 0.5) AS avg_soil_dry,
                  COALESCE(lw.water_available, 0) AS water_available
           FROM devices d LEFT JOIN recent r USING (device_id) LEFT JOIN lw USING (device_id)),
grid AS (SELECT device_id, CAST(d.day_offset AS INTEGER) AS day_offset,
                CAST({A} AS DATE) + CAST(d.day_offset AS INTEGER) AS date, h.hour_pos, h.hour
         FROM devices, range(0, 7) AS d(day_offset),
              (VALUES {", ".join(f"({i}, {h})" for i, h in _HOURS)}) AS h(hour_pos, hour))"""


def _feature_sql(name: str) -> str:
    fixed = {
        "temperature": "avg_temperature", "humidity": "avg_humidity", "soil_dry": "avg_soil_dry",
        "hour_sin": f"sin({PI2} * hour / 24.0)", "hour_cos": f"cos({PI2} * hour / 24.0)",
        "day_sin": f"sin({PI2} * (isodow(date) - 1) / 7.0)", "day_cos": f"cos({PI2} * (isodow(date) - 1) / 7.0)",
        "month_sin": f"sin({PI2} * month(date) / 12.0)", "month_cos": f"cos({PI2} * month(date) / 12.0)",
        "water_available": "CAST(water_available AS DOUBLE)",
    }
    if name in fixed:
        return fixed[name]
    if "lag" in name or "ma" in name:
        for key, col in (("temp", "avg_temperature"), ("humidity", "avg_humidity"), ("soil", "avg_soil_dry")):
            if key in name:
                return col
        return "0.0"
    if "interaction" in name and "temp_humidity" in name:
        return "avg_temperature * avg_humidity / 100.0"
    return "0.0"


@register("forecast_grid", f"""
WITH {_GRID_SQL.strip()}
SELECT device_id, day_offset, date, CAST(hour_pos AS INTEGER) AS hour_pos, CAST(hour AS INTEGER) AS hour FROM grid""")
def q_forecast_grid(spark, sf):
    devices = R(spark, sf).select("device_id").distinct()
    return FC.forecast_grid(devices, td.as_of_lit())


@register("forecast_features", f"""
WITH {_GRID_SQL.strip()}
SELECT device_id, day_offset, CAST(hour AS INTEGER) AS hour,
  {", ".join(f"ROUND(CAST({_feature_sql(n)} AS DOUBLE), 6) AS {n}" for n in FE.SCHEDULE_FEATURES)}
FROM grid JOIN inputs USING (device_id)""")
def q_forecast_features(spark, sf):
    r = R(spark, sf)
    inputs = FC.forecast_inputs(r, td.as_of_lit())
    grid = FC.forecast_grid(inputs.select("device_id"), td.as_of_lit())
    f = FC.forecast_features(grid, inputs, FE.SCHEDULE_FEATURES)
    return f.select("device_id", "day_offset", "hour",
                    *[C.round_d(F.col(n), 6).alias(n) for n in FE.SCHEDULE_FEATURES])


_HOURLY_SQL = _GRID_SQL + """,
rr AS (SELECT device_id, hour(ts) AS hour, CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS on_ FROM readings),
ph AS (SELECT device_id, hour, AVG(on_) AS p_hour FROM rr GROUP BY ALL),
pd AS (SELECT device_id, AVG(on_) AS p_dev FROM rr GROUP BY ALL),
sc AS (SELECT g.*, COALESCE(ph.p_hour, pd.p_dev, 0.5) AS p_on,
              GREATEST(0.6::DOUBLE, 1.0::DOUBLE - g.day_offset * 0.03::DOUBLE) AS factor
       FROM grid g LEFT JOIN ph USING (device_id, hour) LEFT JOIN pd USING (device_id)),
hrs AS (SELECT *, GREATEST(0.0::DOUBLE, LEAST(100.0::DOUBLE, p_on * 100.0::DOUBLE * factor)) AS prob_raw FROM sc),
hrs2 AS (SELECT *, ROUND(prob_raw, 1) AS probability, prob_raw > 60 AS recommended,
                CASE WHEN prob_raw > 80 THEN 'high' WHEN prob_raw > 60 THEN 'medium' ELSE 'low' END AS confidence,
                ROUND(factor, 2) AS weather_factor FROM hrs),
days AS (
  SELECT device_id, day_offset, date,
         CAST(SUM(CAST(ROUND(probability * 10.0::DOUBLE) AS BIGINT)) AS DOUBLE) / (10.0::DOUBLE * COUNT(probability)) AS avg_raw,
         FIRST(weather_factor) AS weather_factor,
         FIRST(hour ORDER BY probability DESC, hour_pos) AS best,
         '[' || string_agg('{"hour": ' || CAST(hour AS VARCHAR) || ', "probability": ' || CAST(probability AS VARCHAR)
               || ', "recommended": ' || CASE WHEN recommended THEN 'true' ELSE 'false' END
               || ', "confidence": "' || confidence || '"}', ', ' ORDER BY hour_pos) || ']' AS predictions_json
  FROM hrs2 GROUP BY device_id, day_offset, date),
fc AS (
  SELECT *, strftime(date, '%Y-%m-%d') AS date_s, strftime(date, '%A') AS day_name, ROUND(avg_raw, 1) AS avg_probability,
    CASE WHEN avg_raw > 75 THEN 'High watering probability (' || printf('%.0f', avg_raw) || '%) | Best time: '
                                || CAST(best AS VARCHAR) || ':00 | Consider watering today'
         WHEN avg_raw > 50 THEN 'Moderate watering probability (' || printf('%.0f', avg_raw)
                                || '%) | Check soil moisture before watering | Water in early morning or evening'
         ELSE 'Low watering probability (' || printf('%.0f', avg_raw) || '%) | No watering needed today' END AS recs
  FROM days)"""


def _freq_forecast(spark, sf):
    r = R(spark, sf)
    return FC.forecast(r, td.as_of_lit(), FC.hourly_frequency_scorer(r), FE.SCHEDULE_FEATURES)


@register("forecast_scores", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, day_offset, CAST(hour AS INTEGER) AS hour, probability, recommended, confidence, weather_factor
FROM hrs2""")
def q_forecast_scores(spark, sf):
    r = R(spark, sf)
    inputs = FC.forecast_inputs(r, td.as_of_lit())
    grid = FC.forecast_grid(inputs.select("device_id"), td.as_of_lit())
    h = FC.score_hours(FC.hourly_frequency_scorer(r)(FC.forecast_features(grid, inputs, FE.SCHEDULE_FEATURES)))
    return h.select("device_id", "day_offset", "hour", "probability", "recommended", "confidence", "weather_factor")


@register("day_average_hours", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, day_offset, avg_probability FROM fc""")
def q_day_average_hours(spark, sf):
    # A7 on scored hours.
    return ST.day_average(q_forecast_scores(spark, sf), keys=("device_id", "day_offset")).drop("avg_raw")


@register("save_forecast", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, {A} AS ts, date_s AS prediction_date, day_name, avg_probability, predictions_json,
       recs AS recommendations
FROM fc""")
def q_save_forecast(spark, sf):
    return FC.save_forecast(_freq_forecast(spark, sf), td.as_of_lit())


@register("day_average", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, date_s AS date, avg_probability, CAST(best AS INTEGER) AS best_hour FROM fc""")
def q_day_average(spark, sf):
    from hydrospark.operators.latest import best_hour
    fc = _freq_forecast(spark, sf)
    return fc.select("device_id", "date", "avg_probability", best_hour(F.col("predictions")).alias("best_hour"))


@register("export_forecast_csv", f"""
WITH {_HOURLY_SQL.strip()}
SELECT h.device_id, fc.date_s AS "Date", fc.day_name AS "Day", CAST(h.hour AS VARCHAR) || ':00' AS "Hour",
       h.probability AS "Probability (%)", CASE WHEN h.recommended THEN 'Yes' ELSE 'No' END AS "Recommended",
       h.confidence AS "Confidence", fc.avg_probability AS "Day Average (%)", fc.recs AS "Recommendations",
       strftime({A}, '%Y-%m-%d %H:%M:%S') AS "Generated At"
FROM hrs2 h JOIN fc USING (device_id, day_offset)""")
def q_export_forecast_csv(spark, sf):
    return FC.export_forecast_csv(_freq_forecast(spark, sf), td.as_of_lit())


@register("forecast_csv_plain", f"""
WITH {_HOURLY_SQL.strip()}
SELECT h.device_id, fc.date_s AS "Date", fc.day_name AS "Day", CAST(h.hour AS INTEGER) AS "Hour",
       h.probability AS "Hour_Probability", CASE WHEN h.recommended THEN 'Yes' ELSE 'No' END AS "Recommended",
       h.confidence AS "Confidence", fc.avg_probability AS "Day_Avg_Probability", fc.recs AS "Recommendations"
FROM hrs2 h JOIN fc USING (device_id, day_offset)""")
def q_forecast_csv_plain(spark, sf):
    return FC.forecast_csv_plain(_freq_forecast(spark, sf))


@register("forecast_summary", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, COUNT(*) AS prediction_count, string_agg(date_s, ',' ORDER BY date_s) AS prediction_days,
       arg_min(avg_probability, day_offset) AS first_day_avg
FROM fc GROUP BY device_id""")
def q_forecast_summary(spark, sf):
    return FC.forecast_summary(_freq_forecast(spark, sf)).select(
        "device_id", "prediction_count", F.array_join("prediction_days", ",").alias("prediction_days"), "first_day_avg")


@register("retain_7_days", f"""
SELECT event_id AS id, user_id AS device_id, ts FROM events
WHERE event_type = 'purchase' AND ts >= {A} - INTERVAL 7 DAY""")
def q_retain_7_days(spark, sf):
    # Stored prediction rows, one per forecast run (runs taken from purchase events).
    runs = td.load(spark, sf, "events").filter(F.col("event_type") == "purchase") \
        .select(F.col("event_id").alias("id"), F.col("user_id").alias("device_id"), "ts")
    return retain_days(runs, td.as_of_lit(), 7)


@register("retain_table", f"""
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS row_count, MIN(ts) AS first_ts FROM events
WHERE event_type = 'purchase' AND ts >= {A} - INTERVAL 7 DAY GROUP BY 1""")
def q_retain_table(spark, sf):
    # K6 on the stored table: partitions behind the cut are dropped, its day is rewritten.
    runs = td.load(spark, sf, "events").filter(F.col("event_type") == "purchase") \
        .select(F.col("event_id").alias("id"), F.col("user_id").alias("device_id"), "ts")
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    append_readings(runs, path)
    retain_table(spark, path, datetime.datetime.fromisoformat(td.AS_OF), 7)
    return spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_ts"))


@register("export_readings_csv", """
SELECT device_id, reading_id AS "ID", COALESCE(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') AS "Timestamp",
       temperature AS "Temperature (°C)", humidity AS "Humidity (%)", soil1 AS "Soil1 Status", soil2 AS "Soil2 Status",
       water AS "Water Level", pump1 AS "Pump1 Status", pump2 AS "Pump2 Status",
       pump1_duration AS "Pump1 Duration (s)", pump2_duration AS "Pump2 Duration (s)",
       manual_override AS "Manual Override"
FROM readings""")
def q_export_readings_csv(spark, sf):
    from hydrospark.sinks.writers import export_readings_frame
    return export_readings_frame(R(spark, sf))


# M16 / M17 / T10 / T11 as their own keys -----------------------------------------------

@register("confidence_bucket", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, day_offset, CAST(hour AS INTEGER) AS hour, confidence, recommended FROM hrs2""")
def q_confidence_bucket(spark, sf):
    return q_forecast_scores(spark, sf).select("device_id", "day_offset", "hour", "confidence", "recommended")


@register("day_recommendations", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, date_s AS date, recs AS recommendations FROM fc""")
def q_day_recommendations(spark, sf):
    fc = _freq_forecast(spark, sf)
    return fc.select("device_id", "date", F.array_join("recommendations", " | ").alias("recommendations"))


@register("best_hour", f"""
WITH {_HOURLY_SQL.strip()}
SELECT device_id, date_s AS date, CAST(best AS INTEGER) AS best_hour FROM fc""")
def q_best_hour(spark, sf):
    from hydrospark.operators.latest import best_hour
    return _freq_forecast(spark, sf).select("device_id", "date", best_hour(F.col("predictions")).alias("best_hour"))


@register("best_model")
def q_best_model(spark, sf):
    from hydrospark.operators.latest import best_model
    return best_model(_ensemble(spark, sf)[1][0], "r2", "name", "pos")
