"""Unit tests on hand-made frames: each rule branch and boundary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hydrospark.functions import columns as C
from hydrospark.functions.health import health_recommendations, health_score, health_status
from hydrospark.operators import alerts as AL
from hydrospark.operators import latest, sequences as SQ, stats as ST
from hydrospark.operators.maintenance import resolve_alerts, settings_defaults, settings_upsert
from hydrospark.operators.throttle import throttle
from hydrospark.schemas import READINGS
from hydrospark.sources import ingest, legacy, weather

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def reading(i, minutes, soil1="WET", soil2="WET", pump1="OFF", pump2="OFF", d1=0, d2=0, temp=25.0, hum=50.0,
            water="AVAILABLE", manual=0, device=1):
    return (i, device, T0 + dt.timedelta(minutes=minutes), temp, hum, soil1, soil2, water, pump1, pump2, d1, d2,
            manual)


def frame(spark, data):
    return spark.createDataFrame(data, READINGS)


# H1-H3 ------------------------------------------------------------------------------

@pytest.mark.parametrize("soil,freq,dur,stab,temp,hum,expected", [
    (600, 1.0, 60, 0, 25, 50, 60),     # soil > 550
    (500, 1.0, 60, 0, 25, 50, 80),     # soil > 450
    (200, 1.0, 60, 0, 25, 50, 70),     # soil < 250
    (400, 0.2, 60, 0, 25, 50, 75),     # infrequent
    (400, 3.5, 60, 0, 25, 50, 80),     # too frequent
    (400, 1.0, 400, 0, 25, 50, 85),    # long sessions
    (400, 1.0, 0, 0, 25, 50, 90),      # short sessions
    (400, 1.0, 60, 151, 25, 50, 85),   # unstable soil
    (400, 1.0, 60, 0, 36, 50, 80),     # hot
    (400, 1.0, 60, 0, 31, 50, 90),     # warm
    (400, 1.0, 60, 0, 25, 20, 85),     # dry air
    (600, 0.2, 400, 151, 40, 90, 0),   # clamp at 0
    (450, 0.5, 30, 150, 30, 80, 100),  # all boundaries are strict
])
def test_health_score(spark, soil, freq, dur, stab, temp, hum, expected):
    df = spark.createDataFrame([(float(soil), float(freq), float(dur), float(stab), float(temp), float(hum))],
                               "s double, f double, d double, st double, t double, h double")
    got = df.select(health_score(*[F.col(c) for c in ("s", "f", "d", "st", "t", "h")]).alias("x")).first()["x"]
    assert got == expected


def test_health_status_boundaries(spark):
    df = spark.createDataFrame([(s,) for s in (100, 85, 84, 70, 69, 50, 49, 30, 29, 0)], "s int")
    got = [r["h"] for r in df.select(health_status(F.col("s")).alias("h")).collect()]
    assert got == ["Excellent", "Excellent", "Good", "Good", "Fair", "Fair", "Poor", "Poor", "Critical", "Critical"]


def test_health_recommendations_order_and_fallback(spark):
    df = spark.createDataFrame([(600.0, 3.0, 400.0, 160.0, 1), (400.0, 1.0, 60.0, 0.0, 2)],
                               "s double, f double, d double, st double, p int")
    out = df.select(health_recommendations(F.col("s"), F.col("f"), F.col("d"), F.col("st"), F.col("p")).alias("r"))
    r1, r2 = [r["r"] for r in out.collect()]
    assert [x["priority"] for x in r1] == ["high", "medium", "medium", "low"]
    assert r1[1]["message"] == "Overwatering detected for plant 1."          # stable: frequency before stability
    assert r1[2]["message"] == "Plant 1 soil moisture fluctuates too much."
    assert [x["message"] for x in r2] == ["All parameters are within optimal ranges for plant 2."]


# F9 / F8 -----------------------------------------------------------------------------

def test_plant_health_label_order(spark):
    df = spark.createDataFrame([(900, "ON"), (250, "ON"), (600, "ON"), (600, "OFF"), (600, "maybe")],
                               "soil int, pump string")
    out = df.select(C.plant_health_label("soil", C.pump_map("pump")).alias("h"), C.pump_map("pump").alias("p"))
    got = [(r["h"], r["p"]) for r in out.collect()]
    assert got == [("Poor", 1), ("Overwatered", 1), ("Good", 1), ("Moderate", 0), ("Moderate", None)]


# S1 / S2 ----------------------------------------------------------------------------

def test_ingest_cases(spark):
    base = '"temperature": 25.5, "humidity": 60, "soil2": "DRY", "water": "AVAILABLE", "pump2": "OFF"'
    cases = [
        (1, '{' + base + ', "soil1": "DRY", "pump1": "ON"}'),
        (2, '{' + base + ', "soil1": "wet", "pump1": "OFF"}'),
        (3, '{' + base + ', "soil1": " dry", "pump1": "OFF"}'),
        (4, '{' + base + ', "soil1": null, "pump1": "maybe"}'),
        (5, '{"temperature": 25, "humidity": 60, "soil1": "DRY", "soil2": "DRY", "water": "?", "pump1": "ON", "pump2": "ON", "pump1_duration": 12}'),
        (6, '{"humidity": 60, "soil1": "DRY", "soil2": "DRY", "pump1": "ON", "pump2": "ON"}'),
        (7, '{' + base.replace('25.5', '"hot"') + ', "soil1": "DRY", "pump1": "ON"}'),
        (8, '{' + base.replace('25.5', 'null') + ', "soil1": "DRY", "pump1": "ON"}'),
    ]
    raw = spark.createDataFrame(cases, "reading_id long, payload string")
    ok, bad = ingest.ingest(raw, keep=("reading_id",))
    got = {r["reading_id"]: r for r in ok.collect()}
    assert (got[1]["pump1_duration"], got[1]["pump2_duration"]) == (60, 0)
    assert got[2]["soil1"] == "WET"
    assert got[3]["soil1"] == "DRY" and got[4]["soil1"] == "DRY"
    assert got[4]["pump1"] == "OFF" and got[4]["pump1_duration"] == 0
    assert got[5]["water"] == "AVAILABLE" and got[5]["pump1_duration"] == 12 and got[5]["pump2_duration"] == 60
    rej = {r["reading_id"]: r["reject_reason"] for r in bad.collect()}
    assert rej[6] == "Missing fields: temperature, water"
    assert rej[7] == "invalid temperature" and rej[8] == "invalid temperature"


# S6 / S7 -----------------------------------------------------------------------------

def test_weather_parsing(spark):
    cur = [(1, '{"main":{"temp":20.5,"humidity":40},"rain":{"1h":0},"snow":{"1h":2},"weather":[{"description":"snow"}]}'),
           (2, '{"main":{"temp":20.5,"humidity":40},"weather":[{"description":"clear"}]}'),
           (3, '{"main":{"temp":20.5,"humidity":40},"rain":{"1h":0.7},"weather":[{"description":"rain"}]}')]
    df = weather.parse_current_weather(spark.createDataFrame(cur, "id int, current_json string"))
    assert [r["precipitation"] for r in df.orderBy("id").collect()] == [2.0, 0.0, 0.7]

    def fc(mains, rain_at=None):
        items = []
        for i, m in enumerate(mains):
            r = '"rain":{"3h":1},' if rain_at == i else ""
            items.append('{' + r + '"weather":[{"main":"' + m + '"}]}')
        return '{"list":[' + ",".join(items) + ']}'
    data = [(1, fc(["Clear", "Clear", "Rain"])), (2, fc(["Clear", "Clear", "Clear", "Rain"])),
            (3, fc(["light rain", "Clouds", "Clear"])), (4, fc(["Clear", "Clear", "Clear"], rain_at=1))]
    out = spark.createDataFrame(data, "id int, f string").select("id", weather.rain_forecast(F.col("f")).alias("r"))
    assert [r["r"] for r in out.orderBy("id").collect()] == [1, 0, 0, 1]


# S3 ------------------------------------------------------------------------------------

def test_migrate_legacy(spark):
    df = spark.createDataFrame([(T0, 27.5, 54.4, 600, "NOT AVAILABLE", "ON", 120, 0)],
                               "timestamp timestamp, temperature double, humidity double, soil int, water string, "
                               "pump string, pump_duration int, manual_override int")
    r = legacy.migrate_legacy(df).first()
    assert (r["soil1"], r["soil2"], r["pump1"], r["pump2"], r["pump1_duration"], r["pump2_duration"]) == \
        ("600", "600", "ON", "ON", 120, 0)


# W3 ------------------------------------------------------------------------------------

def test_watering_sessions_state_machine(spark):
    data = [
        reading(1, 0, pump1="ON", d1=60),
        reading(2, 1, pump1="ON", d1=60),      # still the same session
        reading(3, 2, pump1="OFF", d1=0),      # closes: duration of the OFF row (0)
        reading(4, 3, pump1="ON", d1=0),       # ON with 0 duration: ignored
        reading(5, 4, pump1="OFF", d1=7),      # no open session: nothing
        reading(6, 5, pump1="ON", d1=30),
        reading(7, 6, pump1="OFF", d1=7),      # closes with 7
        reading(8, 7, pump1="ON", d1=30),      # open at the end: not reported
    ]
    s = SQ.watering_sessions(frame(spark, data)).filter("plant = 1")
    got = rows(s, "start_ts")
    assert [(g["start_ts"].minute, g["end_ts"].minute, g["duration"]) for g in got] == [(0, 2, 0), (5, 6, 7)]


# W4 / W5 / R5 ----------------------------------------------------------------------------

def test_pump_alerts_and_manual_rows(spark):
    data = [
        reading(1, 0, soil1="DRY", pump1="ON", d1=60),
        reading(2, 3, soil1="DRY", pump1="ON", d1=60),
        reading(3, 5, soil1="DRY", pump1="ON", d1=60),   # 5 minutes: still dry fires (>=)
        reading(4, 6, soil1="DRY", pump1="ON", d1=60, manual=1),  # manual rows bypass the rules
        reading(5, 7, soil1="WET", pump1="ON", d1=60),
        reading(6, 8, pump1="OFF"),
        reading(7, 9, soil1="DRY", pump1="ON", d1=60),   # new run
    ]
    settings = AL.settings_table(spark)
    a = AL.alerts_all(frame(spark, data), settings)
    got = [(r["reading_id"], r["type"]) for r in rows(a, "reading_id", "rule_pos")]
    assert ("1", "pump1_start") not in got
    assert (1, "pump1_start") in got and (7, "pump1_start") in got
    assert (3, "pump1_still_dry") in got and (2, "pump1_still_dry") not in got
    assert all(r != 4 for r, _ in got)
    assert (1, "soil_dry_plant1") in got
    msg = [r["message"] for r in a.collect() if r["type"] == "pump1_still_dry"][0]
    assert msg == "Plant 1 pump has been running for 5.0 minutes but soil is still DRY! Check for issues."


def test_dry_duration_by_device(spark):
    data = [reading(i, m, soil1="DRY", pump1="ON", d1=60, device=d)
            for i, (d, m) in enumerate([(1, 0), (1, 3), (1, 8), (2, 0), (2, 3), (2, 8)])]
    base = AL.settings_table(spark).select(F.lit(None).cast("long").alias("device_id"), "key", "value")
    own = spark.createDataFrame([(1, "alert_dry_duration", "2")], "device_id long, key string, value string")
    a = AL.pump_alerts(frame(spark, data), base.unionByName(own)).where("type = 'pump1_still_dry'")
    assert sorted((r["device_id"], r["reading_id"]) for r in a.collect()) == [(1, 1), (1, 2), (2, 5)]


def test_rule_thresholds_are_strict(spark):
    data = [reading(1, 0, temp=35.0, hum=30.0), reading(2, 1, temp=35.5, hum=29.5, water="NOT AVAILABLE")]
    a = AL.reading_alerts(frame(spark, data), AL.settings_table(spark))
    got = [(r["reading_id"], r["type"], r["message"]) for r in rows(a, "reading_id", "rule_pos")]
    assert got == [(2, "high_temp", "Temperature is high! 35.5°C (Max: 35.0°C)"),
                   (2, "low_humidity", "Humidity is low! 29.5% (Min: 30.0%)"),
                   (2, "no_water", "Water tank is empty! Refill immediately.")]


def test_alert_enable_switches(spark):
    al = spark.createDataFrame([("high_temp",), ("pump1_start",), ("danger",)], "type string")
    s = AL.settings_table(spark, {"alert_high_temp": "0"})
    got = sorted(r["type"] for r in AL.alert_enabled(al, s, key="type").collect())
    assert got == ["danger", "pump1_start"]  # unmapped values are enabled


# W6 --------------------------------------------------------------------------------------

def _greedy(times, cooldown):
    kept, last = [], None
    for i, t in times:
        if last is None or t - last >= cooldown:
            kept.append(i)
            last = t
    return kept


def test_throttle_matches_sequential_fold(spark):
    import random
    rnd = random.Random(3)
    data, t = [], 0
    for i in range(300):
        t += rnd.choice([0, 10, 60, 200, 700, 2000])
        data.append((i, rnd.choice([1, 1, 1, 2]), T0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(data, "id long, k long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(r["id"] for r in throttle(df, ["k"], 600, order_cols=("ts", "id")).collect())
    exp = []
    for k in (1, 2):
        seq = [(i, (ts - T0).total_seconds()) for i, kk, ts in data if kk == k]
        exp += _greedy(seq, 600)
    assert got == sorted(exp)


# W7 / J2 / J5 -----------------------------------------------------------------------------

def test_pump_timeline_and_context(spark):
    tel = frame(spark, [reading(1, 0, pump1="ON", pump2="OFF", temp=30.0)])
    cmds = spark.createDataFrame([
        (T0 - dt.timedelta(minutes=1), 1, 10, "pump1", "toggle"),   # before any reading: defaults, OFF -> ON
        (T0 + dt.timedelta(minutes=1), 1, 11, "pump1", "TOGGLE"),   # telemetry said ON -> OFF
        (T0 + dt.timedelta(minutes=2), 1, 12, "PUMP2", "ON"),
        (T0 + dt.timedelta(minutes=3), 1, 13, "pump3", "ON"),       # invalid pump
        (T0 + dt.timedelta(minutes=4), 1, 14, "pump2", "TOGGLE"),
    ], "ts timestamp, device_id long, command_id long, pump string, action string")
    tl = rows(SQ.pump_state_timeline(tel, cmds), "ts")
    assert [(r["event_id"], r["pump1_state"], r["pump2_state"]) for r in tl] == [
        (10, "ON", "OFF"), (1, "ON", "OFF"), (11, "OFF", "OFF"), (12, "OFF", "ON"), (14, "OFF", "OFF")]
    ctx = rows(SQ.command_context(tel, cmds), "ts")
    assert (ctx[0]["temperature"], ctx[0]["soil1"]) == (25.0, "DRY")
    assert ctx[1]["temperature"] == 30.0


def test_auto_pump_decision_override(spark):
    s = spark.createDataFrame([
        (1, 1, T0, 25.0, 50.0, True, False, 300),
        (2, 1, T0 + dt.timedelta(minutes=2), 25.0, 50.0, True, False, 300),   # after a command: override
        (3, 1, T0 + dt.timedelta(minutes=3), 25.0, 50.0, True, False, 100),   # water low -> OFF
        (4, 1, T0 + dt.timedelta(minutes=4), float("nan"), 50.0, True, False, 300),  # dropped
    ], "reading_id long, device_id long, ts timestamp, temperature double, humidity double, soil1_dry boolean, "
       "soil2_dry boolean, water_raw int")
    cmds = spark.createDataFrame([(T0 + dt.timedelta(minutes=1), 1, 9, "pump1", "OFF")],
                                 "ts timestamp, device_id long, command_id long, pump string, action string")
    got = [(r["reading_id"], r["manual_override"], r["pump1"]) for r in
           rows(SQ.auto_pump_decision(s, cmds), "reading_id")]
    assert got == [(1, False, "ON"), (2, True, "OFF"), (3, False, "OFF")]


# A3 / A9 / T -------------------------------------------------------------------------------

def test_recent_averages_truthiness(spark):
    data = [reading(1, 0, temp=0.0, hum=40.0), reading(2, 1, temp=0.0, hum=50.0)]
    as_of = F.lit("2024-01-01 09:00:00").cast("timestamp")
    r = ST.recent_averages(frame(spark, data), as_of).first()
    assert (r["avg_temperature"], r["avg_humidity"], r["soil1_dry_ratio"]) == (25.0, 45.0, 0.5)


def test_binary_metrics_baseline_matrix(spark):
    cells = [(1, 1)] * 15 + [(0, 1)] * 3 + [(1, 0)] * 1 + [(0, 0)] * 312
    m = ST.binary_metrics(spark.createDataFrame(cells, "actual int, predicted int")).first()
    assert m["accuracy_pct"] == pytest.approx(98.79154078549848)
    assert m["precision_pct"] == pytest.approx(83.33333333333334)
    assert m["recall_pct"] == pytest.approx(93.75)
    assert m["f1_pct"] == pytest.approx(88.23529411764706)


def test_latest_and_topk(spark):
    data = [reading(1, 0), reading(2, 5, device=1), reading(3, 5, device=2), reading(4, 1, device=2)]
    lr = {r["device_id"]: r["reading_id"] for r in latest.latest_reading(frame(spark, data)).collect()}
    assert lr == {1: 2, 2: 3}
    h = rows(latest.history(frame(spark, data), limit=1), "device_id")
    assert [r["reading_id"] for r in h] == [2, 3]


def test_settings_upsert_and_defaults(spark):
    existing = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    defaults = spark.createDataFrame([("a", "9"), ("c", "3")], "key string, value string")
    assert sorted(tuple(r) for r in settings_defaults(existing, defaults).collect()) == \
        [("a", "1"), ("b", "2"), ("c", "3")]
    upd = spark.createDataFrame([("a", 5, 2), ("a", 7, 1), ("d", 1, 1)], "key string, value int, version long")
    assert sorted(tuple(r) for r in settings_upsert(existing, upd).collect()) == \
        [("a", "5"), ("b", "2"), ("d", "1")]


def test_resolve_alerts(spark):
    al = spark.createDataFrame([(1, 1, T0, "t", "m", 0), (2, 1, T0 + dt.timedelta(hours=2), "t", "m", 0),
                                (3, 2, T0, "t", "m", 0)],
                               "id long, device_id long, ts timestamp, type string, message string, resolved int")
    acks = spark.createDataFrame([(1, T0 + dt.timedelta(hours=1), None), (2, T0 + dt.timedelta(hours=1), 3)],
                                 "device_id long, ts timestamp, alert_id long")
    got = {r["id"]: r["resolved"] for r in resolve_alerts(al, acks).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
