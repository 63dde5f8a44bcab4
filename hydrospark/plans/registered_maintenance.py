"""Registered queries: settings, schedule, cooldown and history maintenance
(K1, K7-K10, K12), location and schedule listings (T5, T9). Inputs are
derived from ``events`` so every query grows with the data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydrospark.operators import maintenance as MT
from hydrospark.operators.alerts import alerts_all, notifications, settings_table
from hydrospark.operators.filters import trailing_window
from hydrospark.operators.latest import latest_location, schedule_ordered
from hydrospark.operators.stats import table_counts
from hydrospark.plans.registered_sequences import ALERTS_SQL, _MAIL
from hydrospark.plans.registry import register
from hydrospark.schemas import DEFAULT_SETTINGS
from hydrospark.session import scratch_path
from hydrospark.sinks.writers import append_readings, replace_schedules, write_schedules
from hydrospark.sources import testdata as td

A = td.AS_OF_SQL
_KEYS = [k for k, _ in DEFAULT_SETTINGS]
_KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "]"
_DEFAULTS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DEFAULT_SETTINGS) + ") AS d(key, value)"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _key_for(idx):
    return F.element_at(F.array(*[F.lit(k) for k in _KEYS]), idx + 1)


def _device_settings(spark, sf):
    """Per-device settings written from ``signup`` events (key chosen by k)."""
    e = td.load(spark, sf, "events").filter(F.col("event_type") == "signup")
    rows = e.select(F.col("user_id").alias("device_id"), _key_for(_k() % len(_KEYS)).alias("key"),
                    _k().cast("string").alias("value"), "ts", "event_id")
    return rows.groupBy("device_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_DEVICE_SETTINGS_SQL = f"""
ds AS (
  SELECT device_id, key, arg_max(value, (ts, event_id)) AS value FROM (
    SELECT user_id AS device_id, {_KEYS_SQL}[(k % {len(_KEYS)}) + 1] AS key, CAST(k AS VARCHAR) AS value, ts, event_id
    FROM events_k WHERE event_type = 'signup') GROUP BY device_id, key
)"""


@register("settings_defaults", f"""
WITH {_DEVICE_SETTINGS_SQL.strip()},
devs AS (SELECT DISTINCT user_id AS device_id FROM events),
defs AS (SELECT devs.device_id, d.key, d.value FROM devs, {_DEFAULTS_SQL})
SELECT device_id, key, value FROM ds
UNION ALL
SELECT device_id, key, value FROM defs WHERE NOT EXISTS (
  SELECT 1 FROM ds WHERE ds.device_id = defs.device_id AND ds.key = defs.key)""")
def q_settings_defaults(spark, sf):
    devices = td.load(spark, sf, "events").select(F.col("user_id").alias("device_id")).distinct()
    defaults = devices.crossJoin(F.broadcast(settings_table(spark)))  # 39 fixed rows
    return MT.settings_defaults(_device_settings(spark, sf), defaults, keys=("device_id",))


@register("settings_upsert", f"""
WITH {_DEVICE_SETTINGS_SQL.strip()},
upd AS (SELECT user_id AS device_id, {_KEYS_SQL}[(k % {len(_KEYS)}) + 1] AS key, CAST(k * 2 AS VARCHAR) AS value,
               epoch_us(ts) AS version
        FROM events_k WHERE event_type = 'purchase'),
allv AS (SELECT device_id, key, value, -4611686018427387904 AS v FROM ds
         UNION ALL SELECT device_id, key, value, version FROM upd)
SELECT device_id, key, arg_max(value, v) AS value FROM allv GROUP BY device_id, key""")
def q_settings_upsert(spark, sf):
    e = td.load(spark, sf, "events").filter(F.col("event_type") == "purchase")
    upd = e.select(F.col("user_id").alias("device_id"), _key_for(_k() % len(_KEYS)).alias("key"),
                   (_k() * 2).alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("version"))
    return MT.settings_upsert(_device_settings(spark, sf), upd, keys=("device_id",))


_SCHEDULE_SQL = """
sched AS (
  SELECT user_id AS device_id, event_id AS pos, hour(ts) AS hour, minute(ts) AS minute, k * 3 AS duration,
         CASE k % 3 WHEN 0 THEN 'plant1' WHEN 1 THEN 'plant2' END AS plant, k % 4 <> 0 AS enabled
  FROM events_k WHERE event_type = 'view'
),
replaced AS (
  SELECT device_id, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY pos) AS id, hour, minute, duration,
         COALESCE(plant, 'both') AS plant, CAST(CASE WHEN COALESCE(enabled, true) THEN 1 ELSE 0 END AS INTEGER) AS enabled
  FROM sched
)"""


def _schedule_submissions(spark, sf):
    e = td.load(spark, sf, "events").filter(F.col("event_type") == "view")
    return e.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("pos"),
                    F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), (_k() * 3).alias("duration"),
                    F.when(_k() % 3 == 0, "plant1").when(_k() % 3 == 1, "plant2").alias("plant"),
                    (_k() % 4 != 0).alias("enabled"))


@register("replace_schedule", f"""
WITH {_SCHEDULE_SQL.strip()}
SELECT device_id, CAST(id AS BIGINT) AS id, CAST(hour AS INTEGER) AS hour, CAST(minute AS INTEGER) AS minute,
       duration, plant, enabled FROM replaced""")
def q_replace_schedule(spark, sf):
    return MT.replace_schedule(_schedule_submissions(spark, sf))


@register("schedule_ordered", f"""
WITH {_SCHEDULE_SQL.strip()}
SELECT device_id, CAST(id AS BIGINT) AS id, CAST(hour AS INTEGER) AS hour, CAST(minute AS INTEGER) AS minute,
       duration, plant, enabled <> 0 AS enabled,
       CAST(ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY hour, minute, id) AS INTEGER) AS position
FROM replaced""")
def q_schedule_ordered(spark, sf):
    return schedule_ordered(MT.replace_schedule(_schedule_submissions(spark, sf)))


@register("replace_schedules", f"""
WITH {_SCHEDULE_SQL.strip()},
fresh AS (SELECT user_id AS device_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS id, hour(ts) AS hour,
                 minute(ts) AS minute, k AS duration FROM events_k WHERE event_type = 'purchase' AND user_id % 3 = 0)
SELECT device_id, id, CAST(hour AS INTEGER) AS hour, CAST(minute AS INTEGER) AS minute, duration, plant, enabled FROM replaced
WHERE device_id NOT IN (SELECT device_id FROM fresh)
UNION ALL SELECT device_id, id, CAST(hour AS INTEGER), CAST(minute AS INTEGER), duration, 'both', 1 FROM fresh""")
def q_replace_schedules(spark, sf):
    # K10 on the stored table: only the folders of the submitting devices are rewritten.
    path = scratch_path(spark, f"schedules-{uuid.uuid4().hex}")
    write_schedules(MT.replace_schedule(_schedule_submissions(spark, sf)), path)
    e = td.load(spark, sf, "events").filter("event_type = 'purchase' and user_id % 3 = 0")
    fresh = e.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("pos"), F.hour("ts").alias("hour"),
                     F.minute("ts").alias("minute"), _k().alias("duration"), F.lit(None).cast("string").alias("plant"),
                     F.lit(None).cast("boolean").alias("enabled"))
    replace_schedules(spark, path, fresh)
    return spark.read.parquet(path).drop("bucket")


@register("cooldown_upsert", f"""
WITH RECURSIVE {ALERTS_SQL.strip()},
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY device_id, severity ORDER BY ts, reading_id, rule_pos) AS seq
      FROM alerts_all),
nx AS (SELECT device_id, severity, seq,
              MIN(seq) OVER (PARTITION BY device_id, severity ORDER BY ts
                             RANGE BETWEEN INTERVAL 10 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING) AS nseq
       FROM a),
kept AS (
  SELECT device_id, severity, seq FROM a WHERE seq = 1
  UNION ALL
  SELECT nx.device_id, nx.severity, nx.nseq FROM kept
  JOIN nx ON nx.device_id = kept.device_id AND nx.severity = kept.severity AND nx.seq = kept.seq
  WHERE nx.nseq IS NOT NULL
)
SELECT device_id, alert_type, MAX(last_sent) AS last_sent FROM (
  SELECT a.device_id, a.severity AS alert_type, a.ts AS last_sent FROM a JOIN kept USING (device_id, severity, seq)
  UNION ALL
  SELECT user_id, CASE WHEN k % 2 = 0 THEN 'danger' ELSE 'system' END, ts FROM events_k WHERE event_type = 'signup')
GROUP BY device_id, alert_type""")
def q_cooldown_upsert(spark, sf):
    s = settings_table(spark, _MAIL)
    # Without the texts, which no column of the result needs and every shuffle would carry.
    alerts = alerts_all(td.readings(spark, sf), s).drop("type", "message")
    sent = notifications(alerts, s).select(
        "device_id", F.col("severity").alias("alert_type"), F.col("ts").alias("last_sent"))
    # The stored side: earlier mails (``signup`` events), some of a kind that no rule sends.
    stored = td.load(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("device_id"), F.when(_k() % 2 == 0, "danger").otherwise("system").alias("alert_type"),
        F.col("ts").alias("last_sent"))
    return MT.cooldown_upsert(stored, sent, keys=("device_id", "alert_type"))


@register("latest_location", """
SELECT event_id AS id, ts, 'city-' || CAST(user_id % 7 AS VARCHAR) AS city, CAST(user_id % 90 AS DOUBLE) AS lat,
       CAST(user_id % 180 AS DOUBLE) AS lon, 'ip' AS method
FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 1""")
def q_latest_location(spark, sf):
    # Stored locations: one per weather fetch (``view`` events).
    e = td.load(spark, sf, "events").filter(F.col("event_type") == "view")
    loc = e.select(F.col("event_id").alias("id"), "ts",
                   F.concat(F.lit("city-"), (F.col("user_id") % 7).cast("string")).alias("city"),
                   (F.col("user_id") % 90).cast("double").alias("lat"),
                   (F.col("user_id") % 180).cast("double").alias("lon"), F.lit("ip").alias("method"))
    return latest_location(loc)


@register("clear_history", f"""
SELECT 'readings' AS table_name, COUNT(*) AS rows_before, CAST(0 AS BIGINT) AS row_count FROM readings
UNION ALL SELECT 'commands', COUNT(*), CAST(0 AS BIGINT) FROM commands
UNION ALL SELECT 'settings', CAST({len(DEFAULT_SETTINGS)} AS BIGINT), CAST({len(DEFAULT_SETTINGS)} AS BIGINT)""")
def q_clear_history(spark, sf):
    tables = {"readings": td.readings(spark, sf), "commands": td.commands(spark, sf),
              "settings": settings_table(spark)}
    before = table_counts(tables).withColumnRenamed("row_count", "rows_before")
    return before.join(table_counts(MT.clear_history(tables)), "table_name")


@register("append_readings", f"""
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS row_count,
       COUNT(*) FILTER (ts > {A} - INTERVAL 7 DAY AND ts <= {A}) AS last_week FROM readings GROUP BY 1""")
def q_append_readings(spark, sf):
    # K1: append into a fresh date-partitioned table and read every date back;
    # the last week comes through the pruned trailing window.
    path = scratch_path(spark, f"readings-{uuid.uuid4().hex}")
    append_readings(td.readings(spark, sf), path)
    back = spark.read.parquet(path)
    week = trailing_window(back, td.as_of_lit(), 7).groupBy("date").agg(F.count(F.lit(1)).alias("last_week"))
    return (back.groupBy("date").agg(F.count(F.lit(1)).alias("row_count")).join(week, "date", "left")
            .withColumn("last_week", F.coalesce("last_week", F.lit(0).cast("long"))))
