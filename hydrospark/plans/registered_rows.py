"""Registered queries: sources, projections, filters, latest/top-k."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydrospark.functions import columns as C
from hydrospark.operators import filters, latest
from hydrospark.operators.reshape import unpivot_plants
from hydrospark.plans.registry import register
from hydrospark.session import scratch_path
from hydrospark.sources import ingest, legacy, testdata as td, timestamps, weather

A = td.AS_OF_SQL
R = td.readings


# S1 / S2 ----------------------------------------------------------------------

_INGEST_SQL = f"""
WITH {ingest.PAYLOADS_SQL.strip()},
parsed AS (
  SELECT reading_id, device_id, ts, payload, json_keys(payload) AS keys,
         TRY_CAST(json_extract_string(payload, '$.temperature') AS DOUBLE) AS temperature,
         TRY_CAST(json_extract_string(payload, '$.humidity') AS DOUBLE) AS humidity,
         upper(json_extract_string(payload, '$.soil1')) AS s1, upper(json_extract_string(payload, '$.soil2')) AS s2,
         upper(json_extract_string(payload, '$.water')) AS w,
         upper(json_extract_string(payload, '$.pump1')) AS p1, upper(json_extract_string(payload, '$.pump2')) AS p2,
         TRY_CAST(json_extract_string(payload, '$.pump1_duration') AS INTEGER) AS d1,
         TRY_CAST(json_extract_string(payload, '$.pump2_duration') AS INTEGER) AS d2
  FROM payloads
),
norm AS (
  SELECT *, CASE WHEN p1 IN ('ON', 'OFF') THEN p1 ELSE 'OFF' END AS pump1,
            CASE WHEN p2 IN ('ON', 'OFF') THEN p2 ELSE 'OFF' END AS pump2,
            list_filter(['temperature', 'humidity', 'soil1', 'soil2', 'water', 'pump1', 'pump2'],
                        lambda x: NOT list_contains(keys, x)) AS missing
  FROM parsed
),
final AS (
  SELECT reading_id, device_id, ts, payload, temperature, humidity,
    CASE WHEN s1 IN ('DRY', 'WET') THEN s1 ELSE 'DRY' END AS soil1,
    CASE WHEN s2 IN ('DRY', 'WET') THEN s2 ELSE 'DRY' END AS soil2,
    CASE WHEN w IN ('AVAILABLE', 'NOT AVAILABLE') THEN w ELSE 'AVAILABLE' END AS water,
    pump1, pump2,
    CAST(CASE WHEN list_contains(keys, 'pump1_duration') THEN d1 WHEN pump1 = 'ON' THEN 60 ELSE 0 END AS INTEGER) AS pump1_duration,
    CAST(CASE WHEN list_contains(keys, 'pump2_duration') THEN d2 WHEN pump2 = 'ON' THEN 60 ELSE 0 END AS INTEGER) AS pump2_duration,
    CAST(0 AS INTEGER) AS manual_override,
    CASE WHEN len(missing) > 0 THEN 'Missing fields: ' || array_to_string(missing, ', ')
         WHEN temperature IS NULL THEN 'invalid temperature'
         WHEN humidity IS NULL THEN 'invalid humidity'
         WHEN list_contains(keys, 'pump1_duration') AND d1 IS NULL THEN 'invalid pump1_duration'
         WHEN list_contains(keys, 'pump2_duration') AND d2 IS NULL THEN 'invalid pump2_duration' END AS reject_reason
  FROM norm
)"""


@register("ingest_readings", _INGEST_SQL + """
SELECT device_id, reading_id, ts, temperature, humidity, soil1, soil2, water, pump1, pump2,
       pump1_duration, pump2_duration, manual_override
FROM final WHERE reject_reason IS NULL""")
def q_ingest_readings(spark, sf):
    ok, _ = ingest.ingest(ingest.payloads_from_events(td.load(spark, sf, "events")))
    return ok


@register("ingest_rejects", _INGEST_SQL + """
SELECT device_id, reading_id, ts, payload, reject_reason FROM final WHERE reject_reason IS NOT NULL""")
def q_ingest_rejects(spark, sf):
    _, bad = ingest.ingest(ingest.payloads_from_events(td.load(spark, sf, "events")))
    return bad


@register("default_durations", _INGEST_SQL + """
SELECT reading_id, pump1, pump2, pump1_duration, pump2_duration FROM final WHERE reject_reason IS NULL""")
def q_default_durations(spark, sf):
    ok, _ = ingest.ingest(ingest.payloads_from_events(td.load(spark, sf, "events")))
    return ok.select("reading_id", "pump1", "pump2", "pump1_duration", "pump2_duration")


# S3 / S5 / S9 / S10 -------------------------------------------------------------

@register("migrate_legacy", f"""
WITH {legacy.LEGACY_SQL.strip()}
SELECT reading_id, device_id, timestamp AS ts, temperature, humidity, CAST(soil AS VARCHAR) AS soil1,
       CAST(soil AS VARCHAR) AS soil2, water, pump AS pump1, pump AS pump2,
       CAST(pump_duration AS INTEGER) AS pump1_duration, CAST(0 AS INTEGER) AS pump2_duration,
       CAST(manual_override AS INTEGER) AS manual_override
FROM legacy""")
def q_migrate_legacy(spark, sf):
    return legacy.migrate_legacy(legacy.legacy_from_events(td.load(spark, sf, "events")))


@register("scan_readings", "SELECT * FROM readings")
def q_scan_readings(spark, sf):
    return R(spark, sf).orderBy("ts", "reading_id")


@register("unpivot_plants", """
SELECT reading_id, device_id, ts, 1 AS plant, soil1 AS soil, pump1 AS pump, pump1_duration AS pump_duration FROM readings
UNION ALL
SELECT reading_id, device_id, ts, 2 AS plant, soil2 AS soil, pump2 AS pump, pump2_duration AS pump_duration FROM readings""")
def q_unpivot_plants(spark, sf):
    return unpivot_plants(R(spark, sf), keep=["reading_id", "device_id", "ts"])


_TS_TEXT_SQL = """
ts_text AS (
  SELECT event_id, ts,
    CASE event_type
      WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
      WHEN 'error' THEN 'not-a-date-' || CAST(k AS VARCHAR)
      WHEN 'signup' THEN ''
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS ts_text
  FROM events_k
)"""


@register("normalize_timestamp", f"""
WITH {_TS_TEXT_SQL.strip()}
SELECT event_id, ts_text,
  CASE WHEN ts_text IS NULL OR ts_text = '' THEN strftime({A}, '%Y-%m-%d %H:%M:%S')
       ELSE COALESCE(strftime(TRY_STRPTIME(regexp_replace(ts_text, 'Z$', '+00:00'),
              ['%Y-%m-%dT%H:%M:%S%z', '%Y-%m-%d %H:%M:%S.%f']), '%Y-%m-%d %H:%M:%S'), ts_text) END AS display_ts
FROM ts_text""")
def q_normalize_timestamp(spark, sf):
    e = td.load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_type") == "click", F.concat(iso, F.lit("Z")))
            .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            .when(F.col("event_type") == "error", F.concat(F.lit("not-a-date-"), k.cast("string")))
            .when(F.col("event_type") == "signup", F.lit(""))
            .otherwise(F.concat(iso, F.lit("+00:00"))))
    t = e.select("event_id", text.alias("ts_text"))
    return t.select("event_id", "ts_text", timestamps.normalize_timestamp(
        F.col("ts_text"), empty=timestamps.display_ts(td.as_of_lit())).alias("display_ts"))


@register("normalize_offsets", """
SELECT event_id, ts_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS display_ts
FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S')
               || ['+05:30', '-08:00', 'Z', '+0530', '.250000+14:00', ''][k % 6 + 1] AS ts_text FROM events_k)""")
def q_normalize_offsets(spark, sf):
    # Offsets are dropped, not applied.
    e = td.load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ends = F.array(*[F.lit(x) for x in ("+05:30", "-08:00", "Z", "+0530", ".250000+14:00", "")])
    t = e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(ends, k % 6 + 1))
                 .alias("ts_text"))
    return t.select("event_id", "ts_text", timestamps.normalize_timestamp(F.col("ts_text")).alias("display_ts"))


_ODD = [('"45"', "45"), ("61.7", "61"), ("true", "1"), ("false", "0"), ("null", None), ('"12.5"', None), ('"x"', None),
        ("-3", "-3")]


@register("ingest_odd_durations", f"""
WITH p AS (SELECT event_id AS reading_id, user_id AS device_id, ts, k FROM events_k),
v AS (SELECT *, [{", ".join("NULL" if w is None else w for _, w in _ODD)}][k % {len(_ODD)} + 1] AS d FROM p)
SELECT reading_id, CASE WHEN k % 3 = 0 THEN 'ON' ELSE 'OFF' END AS pump1, CAST(d AS INTEGER) AS pump1_duration,
       CASE WHEN d IS NULL THEN 'invalid pump1_duration' END AS reject_reason FROM v""")
def q_ingest_odd_durations(spark, sf):
    # Durations as text, float, boolean, null; the pump's key is repeated and its last value counts.
    e = td.load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    given = F.element_at(F.array(*[F.lit(x) for x, _ in _ODD]), k % len(_ODD) + 1)
    pump = F.when(k % 3 == 0, "ON").otherwise("OFF")
    payload = F.concat(F.lit('{"temperature":20,"humidity":50,"soil1":"DRY","soil2":"WET","water":"AVAILABLE","pump1":"?",'
                             '"pump2":"OFF","pump1":"'), pump, F.lit('","pump1_duration":'), given, F.lit("}"))
    raw = e.select(F.col("event_id").alias("reading_id"), F.col("user_id").alias("device_id"), "ts", payload.alias("payload"))
    return ingest.parse_readings(raw).select("reading_id", "pump1", "pump1_duration", "reject_reason")


@register("read_snapshots", f"""
WITH {legacy.LEGACY_SQL.strip()}
SELECT date_trunc('second', timestamp) AS timestamp, temperature, humidity, soil, water, pump,
       CAST(pump_duration AS INTEGER) AS pump_duration, CAST(manual_override AS INTEGER) AS manual_override
FROM legacy""")
def q_read_snapshots(spark, sf):
    # Three cumulative CSV snapshots; equal lines of a snapshot stand in one file.
    rows = legacy.legacy_from_events(td.load(spark, sf, "events")).drop("reading_id", "device_id")
    folder = scratch_path(spark, f"snapshots-{uuid.uuid4().hex}")
    lines = rows.withColumn("timestamp", F.date_trunc("second", "timestamp")).select(
        "timestamp", "temperature", "humidity", "soil", "water", "pump", "pump_duration", "manual_override")
    ends = ["2024-01-10", "2024-01-20", "2024-03-01"]
    for i, end in enumerate(ends):
        lines.where(F.col("timestamp") < F.lit(end).cast("timestamp")).repartition(*lines.columns).write.option(
            "header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{i}")
    got = legacy.read_snapshots(spark, [f"{folder}/{i}" for i in range(len(ends))])
    return got.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# S6 / S7 / S8 -----------------------------------------------------------------

_WEATHER_PARSED_SQL = f"""
WITH {weather.WEATHER_PAYLOADS_SQL.strip()},
wparsed AS (
  SELECT id, ts, city, lat, lon,
    CAST(json_extract(current_json, '$.main.temp') AS DOUBLE) AS temperature,
    CAST(json_extract(current_json, '$.main.humidity') AS DOUBLE) AS humidity,
    COALESCE(NULLIF(CAST(json_extract(current_json, '$.rain."1h"') AS DOUBLE), 0.0),
             CAST(json_extract(current_json, '$.snow."1h"') AS DOUBLE), 0.0) AS precipitation,
    json_extract_string(current_json, '$.weather[0].description') AS weather_description,
    CASE WHEN len(list_filter(json_extract(forecast_json, '$.list[*]')[1:3],
              lambda e: json_extract(e, '$.rain') IS NOT NULL
                   OR COALESCE(contains(json_extract_string(e, '$.weather[0].main'), 'Rain'), false))) > 0
         THEN 1 ELSE 0 END AS rain_forecast
  FROM wpay
)"""


@register("weather_feeds", _WEATHER_PARSED_SQL + """,
cur AS (SELECT * FROM wparsed WHERE id % 5 > 0),
fc AS (SELECT id AS forecast_id, ts + to_minutes(CASE WHEN id % 7 = 1 THEN 30 ELSE id % 7 END) AS forecast_ts, city, lat, lon,
              rain_forecast FROM wparsed WHERE id % 3 > 0)
SELECT cur.id, cur.ts, cur.temperature, cur.precipitation, cur.weather_description,
       CASE WHEN cur.id IS NOT NULL THEN CAST(COALESCE(fc.rain_forecast, 0) AS INTEGER) END AS rain_forecast,
       COALESCE(cur.city, fc.city) AS location_city, fc.forecast_id, fc.forecast_ts,
       CASE WHEN fc.forecast_id IS NULL THEN 'current' WHEN cur.id IS NOT NULL THEN 'both' ELSE 'forecast' END AS feeds
FROM cur FULL OUTER JOIN fc ON cur.city = fc.city AND cur.lat = fc.lat AND cur.lon = fc.lon
  AND fc.forecast_ts BETWEEN cur.ts - INTERVAL 5 MINUTE AND cur.ts + INTERVAL 5 MINUTE""")
def q_weather_feeds(spark, sf):
    # Two landed feeds, forecasts some minutes after, each with gaps.
    pay = weather.weather_payloads_from_events(td.load(spark, sf, "events"))
    near = F.col("id") % 7
    later = (F.col("ts") + F.make_dt_interval(mins=F.when(near == 1, 30).otherwise(near.cast("int")))).alias("ts")
    out = weather.join_feeds(pay.where("id % 5 > 0"), pay.where("id % 3 > 0").select(
        "id", later, "city", "lat", "lon", "forecast_json"))
    return out.select("id", "ts", "temperature", "precipitation", "weather_description", "rain_forecast", "location_city",
                      "forecast_id", "forecast_ts", "feeds")


@register("parse_current_weather", _WEATHER_PARSED_SQL + """
SELECT id, temperature, humidity, precipitation, weather_description FROM wparsed""")
def q_parse_current_weather(spark, sf):
    w = weather.parse_current_weather(weather.weather_payloads_from_events(td.load(spark, sf, "events")))
    return w.select("id", "temperature", "humidity", "precipitation", "weather_description")


@register("parse_rain_forecast", _WEATHER_PARSED_SQL + """
SELECT id, CAST(rain_forecast AS INTEGER) AS rain_forecast FROM wparsed""")
def q_parse_rain_forecast(spark, sf):
    w = weather.weather_payloads_from_events(td.load(spark, sf, "events"))
    return w.select("id", weather.rain_forecast(F.col("forecast_json")).alias("rain_forecast"))


@register("weather_rows", _WEATHER_PARSED_SQL + """
SELECT id, ts, temperature, humidity, precipitation, CAST(rain_forecast AS INTEGER) AS rain_forecast,
       weather_description, city AS location_city, lat AS location_lat, lon AS location_lon
FROM wparsed""")
def q_weather_rows(spark, sf):
    return weather.weather_rows(weather.weather_payloads_from_events(td.load(spark, sf, "events")))


@register("latest_weather", _WEATHER_PARSED_SQL + """
SELECT location_city, id, ts, temperature, humidity, precipitation, rain_forecast, weather_description,
       location_lat, location_lon
FROM (SELECT id, ts, temperature, humidity, precipitation, CAST(rain_forecast AS INTEGER) AS rain_forecast,
             weather_description, city AS location_city, lat AS location_lat, lon AS location_lon,
             ROW_NUMBER() OVER (PARTITION BY city ORDER BY ts DESC, id DESC) AS rn FROM wparsed)
WHERE rn = 1""")
def q_latest_weather(spark, sf):
    w = weather.weather_rows(weather.weather_payloads_from_events(td.load(spark, sf, "events")))
    return latest.latest_weather(w, keys=("location_city",))


# F1-F9 ---------------------------------------------------------------------------

@register("trailing_window", f"SELECT * FROM readings WHERE ts > {A} - INTERVAL 7 DAY AND ts <= {A}")
def q_trailing_window(spark, sf):
    return filters.trailing_window(R(spark, sf), td.as_of_lit(), 7)


# Readings with gaps: every filtered column is null in some rows.
_GAPS = {"temperature": 11, "humidity": 13, "soil1": 17, "soil2": 19, "pump1": 23, "pump2": 29, "water": 31}
_GAPS_SQL = "gaps AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN reading_id % {n} <> 0 THEN {c} END AS {c}" for c, n in _GAPS.items()) + ") FROM readings)"


def _gaps(spark, sf):
    return R(spark, sf).withColumns({c: F.when(F.col("reading_id") % n != 0, F.col(c)) for c, n in _GAPS.items()})


@register("complete_rows", f"""
WITH {_GAPS_SQL}
SELECT * FROM gaps WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND soil1 IS NOT NULL AND soil2 IS NOT NULL""")
def q_complete_rows(spark, sf):
    return filters.complete_rows(_gaps(spark, sf))


@register("indicators", """
SELECT reading_id, device_id,
  CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END AS soil1_dry, CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END AS soil2_dry,
  CASE WHEN pump1 = 'ON' THEN 1 ELSE 0 END AS pump1_on, CASE WHEN pump2 = 'ON' THEN 1 ELSE 0 END AS pump2_on,
  CASE WHEN pump1 = 'ON' OR pump2 = 'ON' THEN 1 ELSE 0 END AS pump_status,
  CASE WHEN water = 'AVAILABLE' THEN 1 ELSE 0 END AS water_available
FROM readings""")
def q_indicators(spark, sf):
    return R(spark, sf).select(
        "reading_id", "device_id", C.is_dry("soil1").alias("soil1_dry"), C.is_dry("soil2").alias("soil2_dry"),
        C.is_on("pump1").alias("pump1_on"), C.is_on("pump2").alias("pump2_on"),
        C.any_pump_on().alias("pump_status"), C.water_available().alias("water_available"))


@register("soil_to_numeric", """
SELECT reading_id, CASE WHEN soil1 = 'DRY' THEN 600 ELSE 300 END AS soil1_value,
       CASE WHEN soil2 = 'DRY' THEN 600 ELSE 300 END AS soil2_value FROM readings""")
def q_soil_to_numeric(spark, sf):
    return R(spark, sf).select("reading_id", C.soil_value("soil1").alias("soil1_value"),
                               C.soil_value("soil2").alias("soil2_value"))


@register("combined_dryness", """
SELECT reading_id, ((CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END)) / 2.0 AS soil_dry
FROM readings""")
def q_combined_dryness(spark, sf):
    return R(spark, sf).select("reading_id", C.combined_dryness().alias("soil_dry"))


@register("pump_map", f"""
WITH {legacy.LEGACY_SQL.strip()}
SELECT reading_id, CASE WHEN pump = 'ON' THEN 1 WHEN pump = 'OFF' THEN 0 END AS pump01 FROM legacy""")
def q_pump_map(spark, sf):
    lg = legacy.legacy_from_events(td.load(spark, sf, "events"))
    return lg.select("reading_id", C.pump_map("pump").alias("pump01"))


@register("plant_health_label", f"""
WITH {legacy.LEGACY_SQL.strip()}
SELECT reading_id, soil, CASE WHEN pump = 'ON' THEN 1 WHEN pump = 'OFF' THEN 0 END AS pump01,
  CASE WHEN soil > 800 THEN 'Poor' WHEN soil < 300 THEN 'Overwatered'
       WHEN pump = 'ON' THEN 'Good' ELSE 'Moderate' END AS health
FROM legacy""")
def q_plant_health_label(spark, sf):
    lg = legacy.legacy_from_events(td.load(spark, sf, "events")).withColumn("pump01", C.pump_map("pump"))
    return lg.select("reading_id", "soil", "pump01", C.plant_health_label("soil", "pump01").alias("health"))


# T1-T3, T6, T13 ----------------------------------------------------------------------

@register("latest_reading", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS rn FROM readings)
WHERE rn = 1""")
def q_latest_reading(spark, sf):
    return latest.latest_reading(R(spark, sf))


@register("pump_status", """
SELECT device_id, pump1 AS pump1_state, pump2 AS pump2_state, manual_override <> 0 AS manual_override,
       manual_override = 0 AS auto_mode, ts AS last_update
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS rn
      FROM readings WHERE pump1 IS NOT NULL AND pump2 IS NOT NULL)
WHERE rn = 1""")
def q_pump_status(spark, sf):
    return latest.pump_status(R(spark, sf))


@register("latest_water", """
SELECT device_id, CASE WHEN water = 'AVAILABLE' THEN 1 ELSE 0 END AS water_available
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS rn
      FROM readings WHERE water IS NOT NULL)
WHERE rn = 1""")
def q_latest_water(spark, sf):
    return latest.latest_water(R(spark, sf))


@register("history", f"""
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS INTEGER) AS rank
  FROM readings WHERE ts > {A} - INTERVAL 7 DAY AND ts <= {A})
WHERE rank <= 100""")
def q_history(spark, sf):
    return latest.history(R(spark, sf), limit=100, days=7, as_of=td.as_of_lit())


@register("first_n_chronological", """
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts, reading_id) AS INTEGER) AS rank FROM readings)
WHERE rank <= 500""")
def q_first_n_chronological(spark, sf):
    return latest.first_n_chronological(R(spark, sf), n=500)


# F7 ---------------------------------------------------------------------------------

@register("nonnull_pump_filter", f"WITH {_GAPS_SQL} SELECT * FROM gaps WHERE pump1 IS NOT NULL AND pump2 IS NOT NULL")
def q_nonnull_pump_filter(spark, sf):
    return filters.nonnull_pumps(_gaps(spark, sf))


@register("nonnull_water_filter", f"WITH {_GAPS_SQL} SELECT * FROM gaps WHERE water IS NOT NULL")
def q_nonnull_water_filter(spark, sf):
    return filters.nonnull_water(_gaps(spark, sf))


# T6 / T13 with limits that bind, T8 ---------------------------------------------------

@register("history_newest_5", """
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, reading_id DESC) AS INTEGER) AS rank
  FROM readings)
WHERE rank <= 5""")
def q_history_newest_5(spark, sf):
    return latest.history(R(spark, sf), limit=5)


@register("first_10_chronological", """
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts, reading_id) AS INTEGER) AS rank FROM readings)
WHERE rank <= 10""")
def q_first_10_chronological(spark, sf):
    return latest.first_n_chronological(R(spark, sf), n=10)


@register("training_log_recent", """
SELECT event_id AS id, ts, CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'success' END AS status, k AS samples_used
FROM events_k WHERE event_type = 'signup' ORDER BY ts DESC, id DESC LIMIT 20""")
def q_training_log_recent(spark, sf):
    # A training attempt per ``signup`` event.
    k = F.get_json_object("props", "$.k").cast("int")
    log = td.load(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), "ts", F.when(k % 4 == 0, "failed").otherwise("success").alias("status"),
        k.alias("samples_used"))
    return latest.training_log_recent(log, 20)
