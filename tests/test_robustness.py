"""Inputs that the first version dropped, rejected or answered wrongly."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import alerts as AL
from hydrospark.operators import stats as ST
from hydrospark.operators.filters import trailing_window
from hydrospark.operators.sequences import command_context
from hydrospark.plans.plant_health import plant_health_report
from hydrospark.schemas import READING_COLUMNS
from hydrospark.session import scratch_path
from hydrospark.sinks.writers import append_readings
from hydrospark.sources import ingest, legacy, timestamps, weather
from hydrospark.sources import testdata as td
from hydrospark.streaming.pipeline import (alert_stream, late_readings_stream, notification_stream,
                                           run_available_now)

SF = "/root/testdata/sf0.001"
MAIL = {"email_enabled": "1", "email_recipient": "a@example.invalid", "email_cooldown_minutes": "10"}


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@pytest.mark.parametrize("json,want", [
    ("60.0", 60), ("12.7", 12), ("true", 1), ("false", 0), ('"12"', 12), ('"12.7"', None), ('"abc"', None), ("null", None)])
def test_durations(spark, json, want):
    body = ('{"temperature":20,"humidity":1,"soil1":"DRY","soil2":"DRY","water":"AVAILABLE","pump1":"ON","pump2":"OFF",'
            '"pump1_duration":%s}' % json)
    r = ingest.parse_readings(spark.createDataFrame([(1, body)], "device_id long, payload string")).first()
    assert r["pump1_duration"] == want and (r["reject_reason"] is None) == (want is not None)
    assert isinstance(r["ts"], dt.datetime)


def test_last_of_repeated_keys(spark):
    body = ('{"temperature":25,"humidity":1,"soil1":"DRY","soil2":"DRY","water":"AVAILABLE","pump1":"ON","pump2":"OFF",'
            '"temperature":31}')
    r = ingest.parse_readings(spark.createDataFrame([(1, body)], "device_id long, payload string")).first()
    assert r["temperature"] == 31.0 and r["reject_reason"] is None


def test_weather_without_entries(spark):
    cur = '{"main":{"temp":1.5,"humidity":2},"weather":[%s]}'
    rows = [(1, cur % "", '{"list":[{"weather":[]}]}'), (2, cur % '{"description":"x"}', '{"list":[{"weather":[]}]}'),
            (3, cur % '{"description":"x"}', '{"list":[{"rain":null,"weather":[]}]}')]
    df = spark.createDataFrame(rows, "id int, current_json string, forecast_json string")
    assert [r["id"] for r in weather.parse_current_weather(df).orderBy("id").collect()] == [2, 3]
    assert [r[0] for r in df.orderBy("id").select(weather.rain_forecast(F.col("forecast_json"))).collect()] == [0, 0, 1]


@pytest.mark.parametrize("text,want", [
    ("2024-01-02T10:00:00+05:30", "2024-01-02 10:00:00"), ("2024-01-02T10:00:00Z", "2024-01-02 10:00:00"),
    ("2024-01-02 10:00:00.250000", "2024-01-02 10:00:00"), ("2024-01-02T10:00", "2024-01-02 10:00:00"),
    ("2024-01-02", "2024-01-02 00:00:00"), ("2024", "2024"), ("12:30:00", "12:30:00"), ("soon", "soon"), ("", "")])
def test_wall_clock(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(timestamps.normalize_timestamp(F.col("t"))).first()[0] == want


def test_r2_of_a_constant_label(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (1.0, 1.0, "a"), (1.0, 0.5, "b"), (1.0, 1.0, "b")],
                               "label double, prediction double, g string")
    assert {r["g"]: r["r2"] for r in ST.regression_metrics(df, keys=("g",)).collect()} == {"a": 1.0, "b": 0.0}


def test_context_keeps_nulls_of_the_newest_reading(spark):
    t = dt.datetime(2024, 1, 1, 10)
    readings = td.readings(spark, SF).limit(1).select(
        *[F.lit(1).cast("long").alias(c) if c == "device_id" else F.lit(t).cast("timestamp_ntz").alias(c) if c == "ts"
          else F.lit(None).cast("double").alias(c) if c == "temperature" else F.col(c) for c in READING_COLUMNS])
    cmd = td.commands(spark, SF)
    rows = cmd.limit(1).select(*[
        F.lit(d).cast("long").alias("device_id") if c == "device_id" else
        F.lit(t + dt.timedelta(minutes=5)).cast("timestamp_ntz").alias("ts") if c == "ts" else F.col(c)
        for d in (1,) for c in cmd.columns])
    other = rows.withColumn("device_id", F.lit(2).cast("long"))
    got = {r["device_id"]: r["temperature"] for r in command_context(readings, rows.unionByName(other)).collect()}
    assert got == {1: None, 2: 25.0}


def test_snapshots_keep_different_rows_of_one_second(spark):
    head = "timestamp,temperature,humidity,soil,water,pump,pump_duration,manual_override"
    a, b, c = (f"2026-02-09 10:00:00,{x},50.0,600,AVAILABLE,OFF,0,0" for x in (20.5, 21.5, 22.5))
    folder = _scratch(spark, "snap")
    for name, lines in (("1", [a, a]), ("2", [a, a, b]), ("3", [c])):
        spark.createDataFrame([("\n".join([head, *lines]),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    got = legacy.read_snapshots(spark, [f"{folder}/{n}" for n in "123"])
    assert sorted(r["temperature"] for r in got.collect()) == [20.5, 20.5, 21.5, 22.5]


def test_idle_devices_are_unknown(spark):
    readings = td.readings(spark, SF)
    as_of = F.lit(dt.datetime(2024, 1, 8)).cast("timestamp_ntz")
    rep = plant_health_report(readings, as_of).collect()
    assert len(rep) == 2 * readings.select("device_id").distinct().count()
    live = {r[0] for r in trailing_window(readings, as_of, 7).select("device_id").distinct().collect()}
    for r in rep:
        if r["device_id"] in live:
            assert r["health"] != "Unknown"
        else:
            assert (r["health"], r["score"], r["avg_soil_moisture"], r["recommendations"]) == ("Unknown", 0.0, None, [])
    none = plant_health_report(readings.where("false"), as_of, devices=spark.createDataFrame([(5,)], "device_id long"))
    assert [(r["plant"], r["health"]) for r in none.orderBy("plant").collect()] == [(1, "Unknown"), (2, "Unknown")]


def test_window_prunes_dates(spark):
    path = _scratch(spark, "dated")
    append_readings(td.readings(spark, SF), path)
    back = spark.read.parquet(path)
    week = trailing_window(back, td.as_of_lit(), 3)
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert week.count() == trailing_window(td.readings(spark, SF), td.as_of_lit(), 3).count()
    assert back.count() == td.readings(spark, SF).count()


def test_samples_filter_is_pushed(spark):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 20), "success")], "ts timestamp_ntz, status string")
    out = ST.samples_since_training(td.readings(spark, SF), log)
    assert "GreaterThan(ts" in out._jdf.queryExecution().executedPlan().toString()
    assert out.first()["new_samples"] == td.readings(spark, SF).where("ts > timestamp_ntz'2024-01-20'").count()


def test_settings_by_device(spark):
    base = AL.settings_table(spark).select(F.lit(None).cast("long").alias("device_id"), "key", "value")
    own = spark.createDataFrame([(1, "max_temperature", "9"), (2, "max_temperature", "35"), (1, "alert_soil_dry", "0")],
                                "device_id long, key string, value string")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "device_id long")
    got = AL.with_settings(rows, base.unionByName(own))
    assert {r["device_id"]: r["max_temperature"] for r in got.collect()} == {1: 9.0, 2: 35.0, 3: 35.0}
    switch = AL.ALERT_ENABLE_KEYS[0]
    off = spark.createDataFrame([(1, switch[1], "0"), (2, switch[1], "1")], "device_id long, key string, value string")
    alerts = spark.createDataFrame([(1, switch[0]), (2, switch[0]), (1, "no such")], "device_id long, severity string")
    left = AL.alert_enabled(alerts, base.where(F.col("key") != switch[1]).unionByName(off))
    assert sorted(map(tuple, left.collect())) == [(1, "no such"), (2, switch[0])]


def _drain(spark, build, schema, parts, name):
    path = _scratch(spark, name)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    run_available_now(build(stream), table, os.path.join(path + "-ckpt"))
    return [tuple(r) for r in spark.table(table).collect()]


@pytest.mark.parametrize("mail", [True, False])
def test_mail_gate_on_the_stream(spark, mail):
    settings = AL.settings_table(spark, MAIL if mail else {"email_enabled": "0"})
    alerts = AL.alerts_all(td.readings(spark, SF), settings)
    parts = [alerts.where("ts < timestamp_ntz'2024-01-15'"), alerts.where("ts >= timestamp_ntz'2024-01-15'")]
    got = _drain(spark, lambda s: notification_stream(s, settings), alerts.schema, parts, "mail")
    want = AL.notifications(alerts, settings).select("device_id", "reading_id", "rule_pos").collect()
    assert sorted((g[0], g[1], g[3]) for g in got) == sorted(map(tuple, want))
    assert bool(got) is mail


def test_slow_clock_is_not_silenced_and_late_rows_are_returned(spark):
    base = td.readings(spark, SF).limit(1)

    def reading(device, rid, minute, pump):
        t = dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute)
        fixed = {"device_id": F.lit(device).cast("long"), "reading_id": F.lit(rid).cast("long"),
                 "ts": F.lit(t).cast("timestamp_ntz"), "pump1": F.lit(pump), "pump2": F.lit("OFF"),
                 "soil1": F.lit("DRY"), "manual_override": F.lit(0).cast("int")}
        return base.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in base.columns])

    parts = [reading(1, 1, 60, "OFF"), reading(1, 2, 120, "ON"), reading(2, 3, 3, "OFF"), reading(2, 4, 4, "ON"),
             reading(1, 5, 61, "ON")]
    settings = AL.settings_table(spark, {"alert_dry_duration": "0"})
    got = _drain(spark, lambda s: alert_stream(s, settings), base.schema, parts, "slow")
    assert {(g[0], g[1]) for g in got if g[4] == "pump1_start"} == {(1, 2), (2, 4)}
    assert {(g[0], g[1]) for g in got if g[4] == "pump1_still_dry"} == {(1, 2), (2, 4)}
    late = _drain(spark, late_readings_stream, base.schema, parts, "late")
    assert sorted((x[0], x[1], x[2]) for x in late) == [(1, 1, 5), (1, 2, 5)]


def test_top_k_of_a_hot_device(spark):
    from hydrospark.operators.latest import first_n_chronological, history
    r = td.readings(spark, SF)
    hot = r.withColumn("device_id", F.when(F.col("reading_id") % 3 > 0, 7).otherwise(F.col("device_id")).cast("long"))
    rows = sorted((x["device_id"], x["ts"], x["reading_id"]) for x in hot.collect())
    for op, flip in ((history, True), (first_n_chronological, False)):
        got = sorted((x["device_id"], x["rank"], x["reading_id"]) for x in op(hot.repartition(16), 3).collect())
        want = []
        for d in {x[0] for x in rows}:
            own = [x for x in rows if x[0] == d]
            want += [(d, i + 1, x[2]) for i, x in enumerate((own[::-1] if flip else own)[:3])]
        assert got == sorted(want)
