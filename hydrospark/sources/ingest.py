"""Parse and validate posted readings (batch or streaming).

Input: a DataFrame with a ``payload`` JSON string (plus any pass-through
columns such as ``ts``, ``device_id``, ``reading_id``). Output: the accepted
readings and the rejects with a reason, split by one ``filter`` each so the
same function works on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.columns import normalize_enum
from hydrospark.schemas import REQUIRED_READING_KEYS


_DOC, _NUM, _KEYS = "_doc", "_numbers", "_keys"
_DURATIONS = ("pump1_duration", "pump2_duration")


def _field(name: str) -> Column:
    # Values of the parsed document as text (numbers keep their JSON text).
    return F.col(_DOC)[name]


def _has(keys: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, F.lit(name)), F.lit(False))


def parse_readings(raw: DataFrame, keep: tuple[str, ...] = ("device_id", "reading_id", "ts")) -> DataFrame:
    """All posted rows with parsed fields plus ``reject_reason`` (null = accepted).

    * a missing required key rejects the row and names the missing keys;
    * temperature/humidity must parse as numbers (``try_cast``);
    * soil1/soil2: upper-cased, DRY/WET else DRY; pumps ON/OFF else OFF;
      water AVAILABLE/NOT AVAILABLE else AVAILABLE (no trimming);
    * durations: given value, else 60 when that pump is ON, else 0; numbers
      are truncated, true and false are 1 and 0, texts must be integers, and
      anything else rejects the row;
    * of a repeated key the last value counts;
    * without a ``ts`` column the arrival time is used.
    """
    if "ts" in keep and "ts" not in raw.columns:
        raw = raw.withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
    # One parse per row. The parsed map is the output of a Generate, so
    # Catalyst cannot inline ``from_json`` into every later reference (a
    # plain projection would be pushed into the reject filter, once per use).
    names = (*REQUIRED_READING_KEYS, *_DURATIONS)
    doc = F.from_json(F.col("payload"), ", ".join(f"`{n}` string" for n in names))
    numbers = F.from_json(F.col("payload"), ", ".join(f"`{n}` double" for n in _DURATIONS))
    raw = raw.select("*", F.inline(F.array(F.struct(
        doc.alias(_DOC), numbers.alias(_NUM), F.json_object_keys("payload").alias(_KEYS)))))
    keys = F.col(_KEYS)
    missing = F.filter(F.array(*[F.when(~_has(keys, k), F.lit(k)) for k in REQUIRED_READING_KEYS]),
                       lambda x: x.isNotNull())
    temp = _field("temperature").try_cast("double")
    hum = _field("humidity").try_cast("double")
    pump1 = normalize_enum(_field("pump1"), ["ON", "OFF"], "OFF")
    pump2 = normalize_enum(_field("pump2"), ["ON", "OFF"], "OFF")

    def duration(name: str, pump: Column) -> tuple[Column, Column]:
        given = _has(keys, name)
        text = _field(name)
        # A JSON number reads as double too; a text does not.
        parsed = (F.when(F.col(_NUM)[name].isNotNull(), F.col(_NUM)[name].try_cast("int"))
                  .when(text == "true", 1).when(text == "false", 0).otherwise(text.try_cast("int")))
        value = F.when(given, parsed).otherwise(F.when(pump == "ON", 60).otherwise(0)).cast("int")
        return value, given & parsed.isNull()

    d1, bad1 = duration("pump1_duration", pump1)
    d2, bad2 = duration("pump2_duration", pump2)
    reason = (F.when(F.size(missing) > 0, F.concat(F.lit("Missing fields: "), F.array_join(missing, ", ")))
              .when(temp.isNull(), F.lit("invalid temperature"))
              .when(hum.isNull(), F.lit("invalid humidity"))
              .when(bad1, F.lit("invalid pump1_duration"))
              .when(bad2, F.lit("invalid pump2_duration")))
    return raw.select(
        *[c for c in keep if c in raw.columns],
        temp.alias("temperature"), hum.alias("humidity"),
        normalize_enum(_field("soil1"), ["DRY", "WET"], "DRY").alias("soil1"),
        normalize_enum(_field("soil2"), ["DRY", "WET"], "DRY").alias("soil2"),
        normalize_enum(_field("water"), ["AVAILABLE", "NOT AVAILABLE"], "AVAILABLE").alias("water"),
        pump1.alias("pump1"), pump2.alias("pump2"),
        d1.alias("pump1_duration"), d2.alias("pump2_duration"),
        F.lit(0).cast("int").alias("manual_override"),
        reason.alias("reject_reason"),
        F.col("payload"))


def ingest(raw: DataFrame, keep: tuple[str, ...] = ("device_id", "reading_id", "ts")) -> tuple[DataFrame, DataFrame]:
    """(accepted readings, rejects). Device posts get ``manual_override = 0``."""
    parsed = parse_readings(raw, keep)
    ok = parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason", "payload")
    bad = parsed.filter(F.col("reject_reason").isNotNull()).select(
        *[c for c in keep if c in parsed.columns], "payload", "reject_reason")
    return ok, bad


def payloads_from_events(events: DataFrame) -> DataFrame:
    """Posted JSON documents derived from ``events`` (test input for S1/S2).

    The readings adapter values, with a deterministic share of malformed
    posts: k % 11 == 0 drops ``water``, k % 13 == 0 sends temperature "hot",
    lower-case soil for ``view``, pump "maybe" for ``signup``, explicit
    durations when k % 4 == 0 and a bad duration when k % 17 == 0.
    """
    from hydrospark.sources.testdata import readings_from_events
    r = readings_from_events(events, keep=("event_type", "props")) \
        .withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    temp = F.when(F.col("_k") % 13 == 0, q(F.lit("hot"))).otherwise(F.col("temperature").cast("string"))
    soil1 = F.when(F.col("event_type") == "view", F.lower("soil1")).otherwise(F.col("soil1"))
    pump1 = F.when(F.col("event_type") == "signup", F.lit("maybe")).otherwise(F.col("pump1"))
    parts = F.concat_ws(
        ",",
        F.concat(F.lit('"temperature":'), temp),
        F.concat(F.lit('"humidity":'), F.col("humidity").cast("string")),
        F.concat(F.lit('"soil1":'), q(soil1)),
        F.concat(F.lit('"soil2":'), q(F.col("soil2"))),
        F.when(F.col("_k") % 11 != 0, F.concat(F.lit('"water":'), q(F.col("water")))),
        F.concat(F.lit('"pump1":'), q(pump1)),
        F.concat(F.lit('"pump2":'), q(F.col("pump2"))),
        F.when(F.col("_k") % 17 == 0, F.lit('"pump1_duration":"abc"'))
         .when(F.col("_k") % 4 == 0, F.concat(F.lit('"pump1_duration":'), F.col("pump1_duration").cast("string"))),
    )
    return r.select("reading_id", "device_id", "ts", F.concat(F.lit("{"), parts, F.lit("}")).alias("payload"))


PAYLOADS_SQL = """
payload_src AS (
  SELECT r.reading_id, r.device_id, r.ts, e.event_type, e.k, r.temperature, r.humidity, r.soil1, r.soil2,
         r.water, r.pump1, r.pump2, r.pump1_duration
  FROM readings r JOIN events_k e ON e.event_id = r.reading_id
),
payloads AS (
  SELECT reading_id, device_id, ts, '{' || concat_ws(',',
    '"temperature":' || CASE WHEN k % 13 = 0 THEN '"hot"' ELSE CAST(temperature AS VARCHAR) END,
    '"humidity":' || CAST(humidity AS VARCHAR),
    '"soil1":"' || CASE WHEN event_type = 'view' THEN lower(soil1) ELSE soil1 END || '"',
    '"soil2":"' || soil2 || '"',
    CASE WHEN k % 11 <> 0 THEN '"water":"' || water || '"' END,
    '"pump1":"' || CASE WHEN event_type = 'signup' THEN 'maybe' ELSE pump1 END || '"',
    '"pump2":"' || pump2 || '"',
    CASE WHEN k % 17 = 0 THEN '"pump1_duration":"abc"'
         WHEN k % 4 = 0 THEN '"pump1_duration":' || CAST(pump1_duration AS VARCHAR) END
  ) || '}' AS payload
  FROM payload_src
)"""
