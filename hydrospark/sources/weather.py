"""Weather payloads (landed JSON) -> ``weather_data`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURRENT = T.StructType([
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()),
                                        T.StructField("humidity", T.DoubleType())])),
    T.StructField("rain", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("snow", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("weather", T.ArrayType(T.StructType([T.StructField("description", T.StringType()),
                                                       T.StructField("main", T.StringType())]))),
])

# Entries as maps of JSON texts: a key with a null value is still a key.
FORECAST = T.StructType([T.StructField("list", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
ENTRY_WEATHER = T.ArrayType(T.StructType([T.StructField("main", T.StringType())]))


def parse_current_weather(df: DataFrame, col: str = "current_json") -> DataFrame:
    """Temperature, humidity, precipitation = rain.1h when present and
    non-zero, else snow.1h, else 0; description of the first weather entry. A
    payload without a weather entry gives no row."""
    j = F.from_json(F.col(col), CURRENT)
    rain = j["rain"]["1h"]
    snow = j["snow"]["1h"]
    precip = F.coalesce(F.nullif(rain, F.lit(0.0)), snow, F.lit(0.0))
    df = df.where(F.size(j["weather"]) > 0)
    return df.select("*", j["main"]["temp"].alias("temperature"), j["main"]["humidity"].alias("humidity"),
                     precip.alias("precipitation"), F.get(j["weather"], 0)["description"].alias("weather_description"))


def rain_forecast(forecast_json: Column) -> Column:
    """1 iff one of the first three forecast entries has a ``rain`` key or
    its first weather ``main`` contains "Rain" (case-sensitive)."""
    entries = F.slice(F.from_json(forecast_json, FORECAST)["list"], 1, 3)
    hit = F.exists(entries, lambda e: F.coalesce(F.map_contains_key(e, "rain"), F.lit(False)) | F.coalesce(
        F.contains(F.get(F.from_json(e["weather"], ENTRY_WEATHER), 0)["main"], F.lit("Rain")), F.lit(False)))
    return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)


def weather_rows(df: DataFrame) -> DataFrame:
    """Current + forecast + location -> ``weather_data`` rows."""
    cur = parse_current_weather(df)
    return cur.select("id", "ts", "temperature", "humidity", "precipitation",
                      rain_forecast(F.col("forecast_json")).alias("rain_forecast"), "weather_description",
                      F.col("city").alias("location_city"), F.col("lat").alias("location_lat"),
                      F.col("lon").alias("location_lon"))


def newest_weather_row(df: DataFrame) -> DataFrame:
    """S8 + T4: the newest weather row. Payloads without a weather entry are
    passed over (the array alone is read of each); of what is left the newest
    payload is taken by one aggregate and only that one is parsed."""
    has = F.size(F.from_json(F.col("current_json"), "weather array<string>")["weather"]) > 0
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    newest = df.where(has).agg(F.max_by(row, F.struct("ts", "id")).alias("_row")).where("_row is not null").select("_row.*")
    return weather_rows(newest)


def join_feeds(current: DataFrame, forecast: DataFrame, bound_minutes: int = 5) -> DataFrame:
    """S8 from two landed feeds: current payloads (id, ts, city, lat, lon,
    current_json) and forecast payloads (id, ts, city, lat, lon, forecast_json)
    of the same place at most ``bound_minutes`` apart. ``feeds`` tells which side
    a row has: ``both``, ``current`` (no forecast: ``rain_forecast`` is 0, as when
    its request fails) or ``forecast`` (reported, no weather). A payload that
    fits several of the other feed gives a row with each. Works on batches and,
    with watermarks on both, on streams (an equi-join on the place, the bound
    limits the state)."""
    cur = parse_current_weather(current).select(
        F.col("id").alias("id"), F.col("ts"), "city", "lat", "lon", "temperature", "humidity", "precipitation",
        "weather_description", F.lit(True).alias("_cur"))
    fc = forecast.select(F.col("id").alias("forecast_id"), F.col("ts").alias("forecast_ts"), F.col("city").alias("f_city"),
                         F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"),
                         rain_forecast(F.col("forecast_json")).alias("_rain"), F.lit(True).alias("_fc"))
    bound = F.expr(f"INTERVAL {int(bound_minutes)} MINUTES")
    same = ((F.col("city") == F.col("f_city")) & (F.col("lat") == F.col("f_lat")) & (F.col("lon") == F.col("f_lon"))
            & (F.col("forecast_ts") >= F.col("ts") - bound) & (F.col("forecast_ts") <= F.col("ts") + bound))
    j = cur.join(fc, same, "full_outer")
    return j.select(
        "id", "ts", "temperature", "humidity", "precipitation",
        F.when(F.col("_cur"), F.coalesce("_rain", F.lit(0))).alias("rain_forecast"), "weather_description",
        F.coalesce("city", "f_city").alias("location_city"), F.coalesce("lat", "f_lat").alias("location_lat"),
        F.coalesce("lon", "f_lon").alias("location_lon"), "forecast_id", "forecast_ts",
        F.when(F.col("_fc").isNull(), "current").when(F.col("_cur"), "both").otherwise("forecast").alias("feeds"))


def weather_payloads_from_events(events: DataFrame) -> DataFrame:
    """Weather documents derived from ``view`` events (test input for S6-S8)."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("id"), "ts", "user_id", k.alias("k"))
    kk = F.col("k")
    s = lambda c: c.cast("string")
    current = F.concat(
        F.lit('{"main":{"temp":'), s(kk % 40), F.lit(".5,\"humidity\":"), s(F.lit(100) - kk), F.lit("}"),
        F.when(kk % 3 == 0, F.concat(F.lit(',"rain":{"1h":'), s(kk % 4), F.lit("}"))).otherwise(F.lit("")),
        F.when(kk % 5 == 0, F.concat(F.lit(',"snow":{"1h":'), s(kk % 2 + 1), F.lit("}"))).otherwise(F.lit("")),
        F.lit(',"weather":[{"description":"'),
        F.when(kk % 2 == 0, F.lit("clear sky")).otherwise(F.lit("light rain")), F.lit('"}]}'))

    def entry(i: int) -> Column:
        m = (kk + F.lit(i)) % 6
        main = F.when(m == 0, "Rain").when(m == 1, "light rain").when(m == 2, "Clouds").otherwise("Clear")
        rain = F.when((kk + F.lit(i)) % 9 == 0, F.lit('"rain":{"3h":1.0},')).otherwise(F.lit(""))
        return F.concat(F.lit("{"), rain, F.lit('"weather":[{"main":"'), main, F.lit('"}]}'))

    forecast = F.concat(F.lit('{"list":['), F.concat_ws(",", *[entry(i) for i in range(5)]), F.lit("]}"))
    return e.select("id", "ts", current.alias("current_json"), forecast.alias("forecast_json"),
                    F.concat(F.lit("city-"), s(F.col("user_id") % 7)).alias("city"),
                    (F.col("user_id") % 90).cast("double").alias("lat"),
                    (F.col("user_id") % 180).cast("double").alias("lon"))


WEATHER_PAYLOADS_SQL = """
wsrc AS (SELECT event_id AS id, ts, user_id, k FROM events_k WHERE event_type = 'view'),
wpay AS (
  SELECT id, ts,
    '{"main":{"temp":' || CAST(k % 40 AS VARCHAR) || '.5,"humidity":' || CAST(100 - k AS VARCHAR) || '}'
    || CASE WHEN k % 3 = 0 THEN ',"rain":{"1h":' || CAST(k % 4 AS VARCHAR) || '}' ELSE '' END
    || CASE WHEN k % 5 = 0 THEN ',"snow":{"1h":' || CAST(k % 2 + 1 AS VARCHAR) || '}' ELSE '' END
    || ',"weather":[{"description":"' || CASE WHEN k % 2 = 0 THEN 'clear sky' ELSE 'light rain' END || '"}]}' AS current_json,
    '{"list":[' || concat_ws(',', {entries}) || ']}' AS forecast_json,
    'city-' || CAST(user_id % 7 AS VARCHAR) AS city,
    CAST(user_id % 90 AS DOUBLE) AS lat, CAST(user_id % 180 AS DOUBLE) AS lon
  FROM wsrc
)"""


def _entry_sql(i: int) -> str:
    m = f"((k + {i}) % 6)"
    main = f"CASE WHEN {m} = 0 THEN 'Rain' WHEN {m} = 1 THEN 'light rain' WHEN {m} = 2 THEN 'Clouds' ELSE 'Clear' END"
    rain = f"CASE WHEN (k + {i}) % 9 = 0 THEN '\"rain\":{{\"3h\":1.0}},' ELSE '' END"
    return f"'{{' || {rain} || '\"weather\":[{{\"main\":\"' || {main} || '\"}}]}}'"


WEATHER_PAYLOADS_SQL = WEATHER_PAYLOADS_SQL.replace("{entries}", ", ".join(_entry_sql(i) for i in range(5)))
