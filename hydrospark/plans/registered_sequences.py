"""Registered queries: sequences (W), as-of joins (J), alert rules (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrospark.functions import columns as C
from hydrospark.operators import alerts as AL
from hydrospark.operators import latest, sequences as SQ
from hydrospark.operators.maintenance import resolve_alerts, stored_alerts
from hydrospark.operators.throttle import throttle
from hydrospark.plans.registered_batch import PLANT_ROWS_SQL, SESSIONS_SQL
from hydrospark.plans.registry import ORACLE, register
from hydrospark.schemas import ALERT_ENABLE_KEYS
from hydrospark.sources import testdata as td

R = td.readings
W = "PARTITION BY device_id ORDER BY ts, reading_id"

# W1 / W2 ----------------------------------------------------------------------

def _feature_cols():
    return {"temp": "temperature", "humidity": "humidity", "soil_dry": C.combined_dryness()}
_SOIL_DRY_SQL = "((CASE WHEN soil1 = 'DRY' THEN 1 ELSE 0 END) + (CASE WHEN soil2 = 'DRY' THEN 1 ELSE 0 END)) / 2.0"


@register("lag_features", f"""
SELECT reading_id, device_id,
  {", ".join(f"LAG({c}, {n}) OVER ({W}) AS {s}_lag_{n}" for s, c in
             [("temp", "temperature"), ("humidity", "humidity"), ("soil_dry", _SOIL_DRY_SQL)] for n in (1, 2, 3))}
FROM readings""")
def q_lag_features(spark, sf):
    df = SQ.lag_features(R(spark, sf), _feature_cols(), lags=(1, 2, 3))
    return df.select("reading_id", "device_id", *[f"{s}_lag_{n}" for s in _feature_cols() for n in (1, 2, 3)])


@register("rolling_means", f"""
SELECT reading_id, device_id,
  {", ".join(f"ROUND(CASE WHEN COUNT({c}) OVER w{n} = {n} THEN AVG({c}) OVER w{n} END, 6) AS {s}_ma_{n}" for s, c in
             [("temp", "temperature"), ("humidity", "humidity"), ("soil_dry", _SOIL_DRY_SQL)] for n in (3, 6))}
FROM readings
WINDOW w3 AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w6 AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def q_rolling_means(spark, sf):
    df = SQ.rolling_means(R(spark, sf), _feature_cols(), windows=(3, 6))
    return df.select("reading_id", "device_id", *[C.round_d(F.col(f"{s}_ma_{n}"), 6).alias(f"{s}_ma_{n}")
                                                  for s in _feature_cols() for n in (3, 6)])


# W3 -----------------------------------------------------------------------------

@register("watering_sessions", f"""
WITH p AS ({PLANT_ROWS_SQL.format(src='readings')})
{SESSIONS_SQL.format(src='p')}""")
def q_watering_sessions(spark, sf):
    return SQ.watering_sessions(R(spark, sf))


# W4 / W5 / R5 (shared oracle fragments) -------------------------------------------

RUNS_SQL = f"""
dev AS (SELECT * FROM readings WHERE manual_override = 0),
pr AS ({PLANT_ROWS_SQL.format(src='dev')}),
pl AS (SELECT *, LAST_VALUE(pump IGNORE NULLS) OVER (PARTITION BY device_id, plant ORDER BY ts, reading_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM pr),
pg AS (SELECT *, pump = 'ON' AND (prev IS NULL OR prev <> 'ON') AS run_start,
              SUM(CASE WHEN pump = 'OFF' THEN 1 ELSE 0 END) OVER (
                PARTITION BY device_id, plant ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS run_id FROM pl),
pe AS (SELECT *, MIN(CASE WHEN pump = 'ON' THEN ts END) OVER (PARTITION BY device_id, plant, run_id) AS run_start_ts,
              (epoch_us(ts) - epoch_us(MIN(CASE WHEN pump = 'ON' THEN ts END) OVER (PARTITION BY device_id, plant, run_id)))
                / 60000000.0 AS elapsed_min
       FROM pg)"""

ALERTS_SQL = RUNS_SQL + """,
ra AS (
  SELECT device_id, reading_id, ts, 1 AS rule_pos, 'soil_dry_plant1' AS type, 'danger' AS severity,
         'Plant 1 soil is too dry! Current: ' || soil1 || ' (Threshold: 500)' AS message
  FROM dev WHERE (CASE WHEN soil1 = 'DRY' THEN 600 ELSE 300 END) > 500
  UNION ALL
  SELECT device_id, reading_id, ts, 2, 'soil_dry_plant2', 'danger',
         'Plant 2 soil is too dry! Current: ' || soil2 || ' (Threshold: 500)'
  FROM dev WHERE (CASE WHEN soil2 = 'DRY' THEN 600 ELSE 300 END) > 500
  UNION ALL
  SELECT device_id, reading_id, ts, 3, 'high_temp', 'warning',
         'Temperature is high! ' || CAST(temperature AS VARCHAR) || '°C (Max: 35.0°C)'
  FROM dev WHERE temperature > 35.0
  UNION ALL
  SELECT device_id, reading_id, ts, 4, 'low_humidity', 'warning',
         'Humidity is low! ' || CAST(humidity AS VARCHAR) || '% (Min: 30.0%)'
  FROM dev WHERE humidity < 30.0
  UNION ALL
  SELECT device_id, reading_id, ts, 5, 'no_water', 'danger', 'Water tank is empty! Refill immediately.'
  FROM dev WHERE water = 'NOT AVAILABLE'
),
pa AS (
  SELECT device_id, reading_id, ts, 5 + plant AS rule_pos, 'pump' || plant || '_start' AS type, 'info' AS severity,
         'Plant ' || plant || ' pump started automatically at ' || strftime(ts, '%H:%M:%S') AS message
  FROM pe WHERE run_start
  UNION ALL
  SELECT device_id, reading_id, ts, 7 + plant, 'pump' || plant || '_still_dry', 'warning',
         'Plant ' || plant || ' pump has been running for ' || printf('%.1f', ROUND(elapsed_min, 1))
         || ' minutes but soil is still DRY! Check for issues.'
  FROM pe WHERE pump = 'ON' AND soil = 'DRY' AND elapsed_min >= 5
),
alerts_all AS (SELECT * FROM ra UNION ALL SELECT * FROM pa)"""


@register("pump_starts", f"""
WITH {RUNS_SQL.strip()}
SELECT device_id, plant, reading_id, ts FROM pe WHERE run_start""")
def q_pump_starts(spark, sf):
    return SQ.pump_starts(R(spark, sf))


@register("pump_still_dry", f"""
WITH {RUNS_SQL.strip()}
SELECT device_id, plant, reading_id, ts, run_start_ts, ROUND(elapsed_min, 6) AS elapsed_min
FROM pe WHERE pump = 'ON' AND soil = 'DRY' AND elapsed_min >= 5""")
def q_pump_still_dry(spark, sf):
    out = SQ.pump_still_dry(R(spark, sf), 5.0)
    return out.withColumn("elapsed_min", C.round_d(F.col("elapsed_min"), 6))


# R1-R5 ---------------------------------------------------------------------------

def _settings(spark, **overrides):
    return AL.settings_table(spark, overrides)


@register("alerts_all", f"WITH {ALERTS_SQL.strip()} SELECT * FROM alerts_all")
def q_alerts_all(spark, sf):
    return AL.alerts_all(R(spark, sf), _settings(spark))


for _pos, _key, _type in [(1, "alert_soil_dry", ("soil_dry_plant1", "soil_dry_plant2")),
                          (3, "alert_high_temp", ("high_temp",)),
                          (4, "alert_low_humidity", ("low_humidity",)),
                          (5, "alert_no_water", ("no_water",))]:
    def _make(types):
        def q(spark, sf):
            device_rows = R(spark, sf).filter(F.col("manual_override") == 0)
            return AL.reading_alerts(device_rows, _settings(spark)).filter(F.col("type").isin(*types))
        return q
    register(_key, f"WITH {ALERTS_SQL.strip()} SELECT * FROM ra WHERE type IN ({', '.join(repr(t) for t in _type)})")(
        _make(_type))


# J1 ------------------------------------------------------------------------------

@register("with_settings", """
SELECT reading_id, device_id, CAST(500 AS INTEGER) AS soil_dry_threshold1, CAST(450 AS INTEGER) AS soil_dry_threshold2,
       CAST(40.0 AS DOUBLE) AS max_temperature, CAST(30.0 AS DOUBLE) AS min_humidity, CAST(5 AS INTEGER) AS alert_dry_duration,
       CAST(10 AS INTEGER) AS email_cooldown_minutes
FROM readings""")
def q_with_settings(spark, sf):
    s = _settings(spark, soil_dry_threshold2="450", max_temperature="40", min_humidity="not-a-number")
    return AL.with_settings(R(spark, sf), s).select(
        "reading_id", "device_id", "soil_dry_threshold1", "soil_dry_threshold2", "max_temperature",
        "min_humidity", "alert_dry_duration", "email_cooldown_minutes")


_AS_OF_KEYS = ("soil_dry_threshold1", "max_temperature", "min_humidity")


def _asof_sql(i: int, key: str, kind: str, default: str) -> str:
    return f"""
o{i} AS (SELECT q.reading_id, e.value AS own FROM readings q
         ASOF LEFT JOIN (SELECT * FROM edits WHERE key = '{key}' AND device_id IS NOT NULL) e
         ON q.device_id = e.device_id AND q.ts >= e.ts),
g{i} AS (SELECT q.reading_id, e.value AS general FROM readings q
         ASOF LEFT JOIN (SELECT * FROM edits WHERE key = '{key}' AND device_id IS NULL) e ON q.ts >= e.ts),
s{i} AS (SELECT reading_id, COALESCE(TRY_CAST(own AS {kind}), TRY_CAST(general AS {kind}), {default}) AS {key}
         FROM o{i} JOIN g{i} USING (reading_id))"""


@register("settings_as_of", f"""
WITH edits AS (
  SELECT user_id AS device_id, ts, ['{"', '".join(_AS_OF_KEYS)}'][k % 3 + 1] AS key,
         CASE WHEN k % 10 = 0 THEN 'none' ELSE CAST(k AS VARCHAR) END AS value FROM events_k WHERE event_type = 'signup'
  UNION ALL
  SELECT NULL, ts, ['{"', '".join(_AS_OF_KEYS)}'][k % 3 + 1], CAST(k * 2 AS VARCHAR)
  FROM events_k WHERE event_type = 'purchase' AND k < 20),
{_asof_sql(1, 'soil_dry_threshold1', 'INTEGER', '500').strip()},
{_asof_sql(2, 'max_temperature', 'DOUBLE', '35.0').strip()},
{_asof_sql(3, 'min_humidity', 'DOUBLE', '30.0').strip()}
SELECT reading_id, device_id, soil_dry_threshold1, max_temperature, min_humidity
FROM readings JOIN s1 USING (reading_id) JOIN s2 USING (reading_id) JOIN s3 USING (reading_id)""")
def q_settings_as_of(spark, sf):
    # Settings written over time: by devices (``signup`` events) and for all (some ``purchase`` events).
    e = td.load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    key = F.element_at(F.array(*[F.lit(k) for k in _AS_OF_KEYS]), F.col("k") % 3 + 1).alias("key")
    own = e.filter("event_type = 'signup'").select(
        F.col("user_id").alias("device_id"), "ts", key,
        F.when(F.col("k") % 10 == 0, "none").otherwise(F.col("k").cast("string")).alias("value"))
    general = e.filter("event_type = 'purchase' and k < 20").select(
        F.lit(None).cast("long").alias("device_id"), "ts", key, (F.col("k") * 2).cast("string").alias("value"))
    return AL.with_settings(R(spark, sf), own.unionByName(general)).select("reading_id", "device_id", *_AS_OF_KEYS)


# J4 ------------------------------------------------------------------------------

_MAP_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALERT_ENABLE_KEYS) + ") AS m(alert_key, setting_key)"


@register("alert_enabled", f"""
WITH {ALERTS_SQL.strip()},
st AS (SELECT * FROM (VALUES ('alert_high_temp', '0'), ('alert_no_water', '0'), ('alert_low_humidity', '1'),
                              ('alert_soil_dry_plant1', '1'), ('alert_soil_dry_plant2', '1'),
                              ('alert_pump_start', '0'), ('alert_pump_still_dry', '0')) AS s(key, value)),
sw AS (SELECT m.alert_key, COALESCE(st.value = '1', false) AS on_ FROM {_MAP_SQL} LEFT JOIN st ON st.key = m.setting_key)
SELECT a.* FROM alerts_all a LEFT JOIN sw ON sw.alert_key = a.type WHERE COALESCE(sw.on_, true)""")
def q_alert_enabled(spark, sf):
    s = _settings(spark, alert_high_temp="0", alert_no_water="0")
    return AL.alert_enabled(AL.alerts_all(R(spark, sf), s), s, key="type")


# W6 / R6 -------------------------------------------------------------------------

@register("alert_throttle", """
WITH RECURSIVE a AS (
  SELECT user_id, event_id, ts, event_type,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events WHERE event_type IN ('click', 'error')
),
nx AS (
  SELECT user_id, seq, MIN(seq) OVER (PARTITION BY user_id ORDER BY ts
                                      RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS nseq
  FROM a
),
kept AS (
  SELECT user_id, seq FROM a WHERE seq = 1
  UNION ALL
  SELECT nx.user_id, nx.nseq FROM kept JOIN nx ON nx.user_id = kept.user_id AND nx.seq = kept.seq
  WHERE nx.nseq IS NOT NULL
)
SELECT a.user_id, a.event_id, a.ts, a.event_type FROM a JOIN kept USING (user_id, seq)""")
def q_alert_throttle(spark, sf):
    e = td.load(spark, sf, "events").filter(F.col("event_type").isin("click", "error")) \
        .select("user_id", "event_id", "ts", "event_type")
    return throttle(e, ["user_id"], 86400, order_cols=("ts", "event_id"))


@register("throttle_all_events", ORACLE["alert_throttle"].replace("  FROM events WHERE event_type IN ('click', 'error')\n",
                                                                  "  FROM events\n"), raw_sql=True)
def q_throttle_all_events(spark, sf):
    e = td.load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return throttle(e, ["user_id"], 86400, order_cols=("ts", "event_id"))


_MAIL = {"email_enabled": "1", "email_recipient": "alerts@example.invalid"}


@register("notifications", f"""
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
SELECT a.* EXCLUDE (seq) FROM a JOIN kept USING (device_id, severity, seq)""")
def q_notifications(spark, sf):
    s = _settings(spark, **_MAIL)
    return AL.notifications(AL.alerts_all(R(spark, sf), s), s, key="severity")


# K11 / F6 / T7 --------------------------------------------------------------------

STORED_ALERTS_SQL = ALERTS_SQL + """,
acks AS (SELECT user_id AS device_id, MAX(ts) AS ack_ts FROM events WHERE event_type = 'signup' GROUP BY user_id),
stored AS (
  SELECT reading_id * 10 + rule_pos AS id, a.device_id, a.ts, a.type, a.message,
         CAST(CASE WHEN acks.ack_ts >= a.ts THEN 1 ELSE 0 END AS INTEGER) AS resolved
  FROM alerts_all a LEFT JOIN acks ON acks.device_id = a.device_id
)"""


def _stored(spark, sf):
    e = td.load(spark, sf, "events")
    acks = e.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("device_id"), "ts", F.lit(None).cast("long").alias("alert_id"))
    return resolve_alerts(stored_alerts(AL.alerts_all(R(spark, sf), _settings(spark))), acks)


@register("resolve_alerts", f"WITH {STORED_ALERTS_SQL.strip()} SELECT * FROM stored")
def q_resolve_alerts(spark, sf):
    return _stored(spark, sf)


@register("resolve_alerts_by_id", f"""
WITH {ALERTS_SQL.strip()},
acks AS (SELECT reading_id * 10 + rule_pos AS id, MAX(ts + INTERVAL 1 MINUTE) AS ack_ts FROM alerts_all
         WHERE reading_id % 3 = 0 AND rule_pos <> 4 GROUP BY 1)
SELECT reading_id * 10 + rule_pos AS id, a.device_id, a.ts, a.type, a.message,
       CAST(CASE WHEN acks.ack_ts >= a.ts THEN 1 ELSE 0 END AS INTEGER) AS resolved
FROM alerts_all a LEFT JOIN acks ON acks.id = a.reading_id * 10 + a.rule_pos""")
def q_resolve_alerts_by_id(spark, sf):
    # Single acknowledgements: some alerts of every third reading, a minute later.
    stored = stored_alerts(AL.alerts_all(R(spark, sf), _settings(spark)))
    acks = stored.filter("floor(id / 10) % 3 = 0 and id % 10 <> 4").select(
        "device_id", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"), F.col("id").alias("alert_id"))
    return resolve_alerts(stored, acks)


@register("unresolved_filter", f"WITH {STORED_ALERTS_SQL.strip()} SELECT * FROM stored WHERE resolved = 0")
def q_unresolved_filter(spark, sf):
    return _stored(spark, sf).filter(F.col("resolved") == 0)


@register("list_alerts", f"""
WITH {STORED_ALERTS_SQL.strip()}
SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY ts DESC, id DESC) AS INTEGER) AS rank
               FROM stored) WHERE rank <= 50""")
def q_list_alerts(spark, sf):
    return latest.list_alerts(_stored(spark, sf), unresolved_only=False, limit=50)


# W7 / J2 / J5 ----------------------------------------------------------------------

EVENT_STREAM_SQL = """
stream AS (
  SELECT device_id, ts, 0 AS src, reading_id AS event_id, pump1 AS e1, pump2 AS e2, 0 AS t1, 0 AS t2,
         NULL AS pump, NULL AS action FROM {readings}
  UNION ALL
  SELECT device_id, ts, 1, command_id,
         CASE WHEN pump = 'pump1' AND action IN ('ON', 'OFF') THEN action END,
         CASE WHEN pump = 'pump2' AND action IN ('ON', 'OFF') THEN action END,
         CASE WHEN pump = 'pump1' AND action = 'TOGGLE' THEN 1 ELSE 0 END,
         CASE WHEN pump = 'pump2' AND action = 'TOGGLE' THEN 1 ELSE 0 END, pump, action
  FROM commands WHERE pump IN ('pump1', 'pump2') AND action IN ('ON', 'OFF', 'TOGGLE')
)"""

TIMELINE_SQL = """
tc AS (SELECT *, SUM(t1) OVER (PARTITION BY device_id ORDER BY ts, src, event_id ROWS UNBOUNDED PRECEDING) % 2 = 1 AS o1,
                 SUM(t2) OVER (PARTITION BY device_id ORDER BY ts, src, event_id ROWS UNBOUNDED PRECEDING) % 2 = 1 AS o2
       FROM {stream}),
tn AS (SELECT *,
  LAST_VALUE(CASE WHEN o1 THEN CASE WHEN e1 = 'ON' THEN 'OFF' WHEN e1 IS NOT NULL THEN 'ON' END ELSE e1 END IGNORE NULLS)
    OVER (PARTITION BY device_id ORDER BY ts, src, event_id ROWS UNBOUNDED PRECEDING) AS n1,
  LAST_VALUE(CASE WHEN o2 THEN CASE WHEN e2 = 'ON' THEN 'OFF' WHEN e2 IS NOT NULL THEN 'ON' END ELSE e2 END IGNORE NULLS)
    OVER (PARTITION BY device_id ORDER BY ts, src, event_id ROWS UNBOUNDED PRECEDING) AS n2
  FROM tc),
timeline AS (SELECT *,
  CASE WHEN o1 THEN CASE WHEN COALESCE(n1, 'OFF') = 'ON' THEN 'OFF' ELSE 'ON' END ELSE COALESCE(n1, 'OFF') END AS pump1_state,
  CASE WHEN o2 THEN CASE WHEN COALESCE(n2, 'OFF') = 'ON' THEN 'OFF' ELSE 'ON' END ELSE COALESCE(n2, 'OFF') END AS pump2_state
  FROM tn)"""


@register("pump_state_timeline", f"""
WITH {EVENT_STREAM_SQL.format(readings='readings').strip()},
{TIMELINE_SQL.format(stream='stream').strip()}
SELECT device_id, ts, CASE WHEN src = 0 THEN 'telemetry' ELSE 'command' END AS source, event_id,
       CAST(pump AS VARCHAR) AS pump, CAST(action AS VARCHAR) AS action, pump1_state, pump2_state
FROM timeline""")
def q_pump_state_timeline(spark, sf):
    return SQ.pump_state_timeline(R(spark, sf), td.commands(spark, sf))


_CONTEXT_SQL = """
SELECT c.device_id, c.ts, c.command_id, c.pump, c.action,
       CASE WHEN r.reading_id IS NULL THEN 25.0 ELSE r.temperature END AS temperature,
       CASE WHEN r.reading_id IS NULL THEN 60.0 ELSE r.humidity END AS humidity,
       CASE WHEN r.reading_id IS NULL THEN 'DRY' ELSE r.soil1 END AS soil1,
       CASE WHEN r.reading_id IS NULL THEN 'DRY' ELSE r.soil2 END AS soil2,
       CASE WHEN r.reading_id IS NULL THEN 'AVAILABLE' ELSE r.water END AS water
FROM commands c ASOF LEFT JOIN {src} r ON c.device_id = r.device_id AND c.ts >= r.ts"""


@register("command_context", _CONTEXT_SQL.format(src="readings"))
def q_command_context(spark, sf):
    return SQ.command_context(R(spark, sf), td.commands(spark, sf))


@register("command_context_gaps", """
WITH gaps AS (SELECT * REPLACE (CASE WHEN humidity % 3 = 0 THEN NULL ELSE temperature END AS temperature,
                                CASE WHEN humidity % 4 = 0 THEN NULL ELSE soil1 END AS soil1,
                                CASE WHEN humidity % 5 = 0 THEN NULL ELSE water END AS water) FROM readings)
""" + _CONTEXT_SQL.format(src="gaps"))
def q_command_context_gaps(spark, sf):
    # Newest readings with null values: they are taken as they are.
    def gap(c, every):
        return F.when(F.col("humidity") % every != 0, F.col(c)).alias(c)
    r = R(spark, sf)
    holes = {"temperature": 3, "soil1": 4, "water": 5}
    gaps = r.select(*[gap(c, holes[c]) if c in holes else c for c in r.columns])
    return SQ.command_context(gaps, td.commands(spark, sf))


def device_samples(spark, sf):
    """Raw device samples derived from events (J5 input): water level k*5,
    NaN temperature when k % 19 == 0."""
    e = td.load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("reading_id"), F.col("user_id").alias("device_id"), "ts",
        F.when(k % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value") % F.lit(45.0)).alias("temperature"),
        k.cast("double").alias("humidity"),
        F.col("event_type").isin("click", "error").alias("soil1_dry"),
        F.col("event_type").isin("view", "error").alias("soil2_dry"),
        (k * 5).alias("water_raw"))


@register("auto_pump_decision", f"""
WITH samples AS (
  SELECT event_id AS reading_id, user_id AS device_id, ts,
         CASE WHEN k % 19 = 0 THEN 'NaN'::DOUBLE ELSE value % 45.0 END AS temperature, CAST(k AS DOUBLE) AS humidity,
         event_type IN ('click', 'error') AS soil1_dry, event_type IN ('view', 'error') AS soil2_dry, k * 5 AS water_raw
  FROM events_k
),
ok AS (SELECT * FROM samples WHERE NOT isnan(temperature) AND NOT isnan(humidity)),
dec AS (SELECT reading_id, device_id, ts,
               CASE WHEN soil1_dry AND water_raw >= 250 THEN 'ON' ELSE 'OFF' END AS pump1,
               CASE WHEN soil2_dry AND water_raw >= 250 THEN 'ON' ELSE 'OFF' END AS pump2 FROM ok),
{EVENT_STREAM_SQL.format(readings='dec').strip()},
ov AS (SELECT * EXCLUDE (e1, e2),
         src = 0 AND COALESCE(LAG(src) OVER (PARTITION BY device_id ORDER BY ts, src, event_id) = 1, false) AS manual_override,
         e1 AS e1_raw, e2 AS e2_raw FROM stream),
ov2 AS (SELECT * EXCLUDE (e1_raw, e2_raw), CASE WHEN manual_override THEN NULL ELSE e1_raw END AS e1,
               CASE WHEN manual_override THEN NULL ELSE e2_raw END AS e2 FROM ov),
{TIMELINE_SQL.format(stream='ov2').strip()}
SELECT device_id, ts, event_id AS reading_id, manual_override, pump1_state AS pump1, pump2_state AS pump2
FROM timeline WHERE src = 0""")
def q_auto_pump_decision(spark, sf):
    return SQ.auto_pump_decision(device_samples(spark, sf), td.commands(spark, sf))
