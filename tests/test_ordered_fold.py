"""Ordered folds on streams: whatever the batches, every row leaves once, and what
is folded equals the batch operator over the same rows."""

import datetime as dt
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import alerts as AL
from hydrospark.operators import maintenance as MT
from hydrospark.operators import sequences as SQ
from hydrospark.session import scratch_path
from hydrospark.sources import testdata as td
from hydrospark.sources.weather import join_feeds, weather_payloads_from_events, weather_rows
from hydrospark.streaming import pipeline as P

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 10)
READING = ("device_id long, reading_id long, ts timestamp_ntz, temperature double, humidity double, soil1 string, "
           "soil2 string, water string, pump1 string, pump2 string, pump1_duration int, pump2_duration int, "
           "manual_override int")


def _readings(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        d, m = r.choice([1, 1, 2]), r.randrange(0, 90)
        out.append((d, i, T0 + dt.timedelta(minutes=m), r.choice([20.0, 36.0]), 50.0, r.choice(["DRY", "WET"]), "DRY",
                    "AVAILABLE", r.choice(["ON", "ON", "OFF", None]), r.choice(["ON", "OFF"]), 0, 0, int(r.random() < 0.1)))
    return out


def _split(rows, seed):
    """Rows in time order with some disorder, cut into batches at random places."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x[2] + dt.timedelta(minutes=r.choice([0, 0, 0, 15, 40])))
    cuts = sorted(r.sample(range(1, len(rows)), r.randint(1, 3)))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def _land(spark, batches, schema, name):
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    for b in batches:
        df = b if hasattr(b, "columns") else spark.createDataFrame(b, schema)
        df.coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(spark, df):
    name = f"t_{uuid.uuid4().hex[:8]}"
    P.run_available_now(df, name, scratch_path(spark, name))
    return spark.table(name)


@pytest.mark.parametrize("seed, wait", [(1, 0), (2, 0), (3, 0), (4, 600)])
def test_every_reading_leaves_once(spark, seed, wait):
    rows = _readings(60, seed)
    path = _land(spark, _split(rows, seed), READING, "runs")
    out = _drained(spark, P.pump_runs_stream(_stream(spark, path, READING), wait_seconds=wait)).collect()
    posted = [x for x in rows if x[-1] == 0]
    seen = sorted((o["reading_id"], o["plant"]) for o in out)
    want = sorted((x[1], p) for x in posted for p in (1, 2))
    if not wait:
        assert seen == want
    assert len(set(seen)) == len(seen) and set(seen) <= set(want)
    # Rows that wait at the end are those within the wait of their device's newest.
    for key in set(want) - set(seen):
        d, ts = next((x[0], x[2]) for x in rows if x[1] == key[0])
        assert wait and ts > max(x[2] for x in posted if x[0] == d) - dt.timedelta(seconds=wait)
    kept = {(o["reading_id"], o["plant"]) for o in out if not o["late"]}
    batch = SQ.pump_runs(spark.createDataFrame(rows, READING)).withColumn("one", F.lit(1))
    for plant in (1, 2):
        sub = [x for x in rows if (x[1], plant) in kept]
        ref = SQ.pump_runs(spark.createDataFrame(sub, READING)).where(F.col("plant") == plant)
        want_runs = sorted((r["reading_id"], r["run_start"], r["run_start_ts"]) for r in ref.collect())
        got_runs = sorted((o["reading_id"], o["run_start"], o["run_start_ts"]) for o in out
                          if o["plant"] == plant and not o["late"])
        assert [(a, bool(b), c) for a, b, c in want_runs] == got_runs
    assert batch.count() == len(want)
    if seed != 4:
        assert any(o["late"] for o in out)


def test_alerts_of_devices_with_their_own_dry_duration(spark):
    settings = AL.settings_table(spark).select(F.lit(None).cast("long").alias("device_id"), "key", "value").unionByName(
        spark.createDataFrame([(1, "alert_dry_duration", "2"), (2, "alert_dry_duration", "30")],
                              "device_id long, key string, value string"))
    rows = sorted(_readings(80, 9), key=lambda x: (x[2], x[1]))
    path = _land(spark, [rows[:30], rows[30:55], rows[55:]], READING, "alerts")
    got = _drained(spark, P.alert_stream(_stream(spark, path, READING), settings)).collect()
    key = ["device_id", "reading_id", "rule_pos", "type", "message"]
    late = {(g["reading_id"], g["rule_pos"]) for g in got if g["late"]}
    assert not late  # batches in time order
    want = AL.alerts_all(spark.createDataFrame(rows, READING), settings).collect()
    assert sorted(tuple(g[c] for c in key) for g in got) == sorted(tuple(w[c] for c in key) for w in want)
    dry = [{w["reading_id"] for w in want if w["type"].endswith("still_dry") and w["device_id"] == d} for d in (1, 2)]
    assert dry[0] and len(dry[0]) > len(dry[1])


def test_equal_time_smaller_id_is_late(spark):
    fixed = (20.0, 50.0, "DRY", "DRY", "AVAILABLE", "ON", "ON", 0, 0, 0)
    path = _land(spark, [[(1, 7, T0, *fixed)], [(1, 5, T0, *fixed)], [(1, 9, T0, *fixed)]], READING, "ties")
    out = _drained(spark, P.pump_runs_stream(_stream(spark, path, READING))).where("plant = 1").collect()
    assert sorted((o["reading_id"], o["late"]) for o in out) == [(5, True), (7, False), (9, False)]


def test_rows_without_time_or_id(spark):
    fixed = (20.0, 50.0, "DRY", "DRY", "AVAILABLE", "ON", "ON", 0, 0, 0)
    rows = [(1, 1, None, *fixed), (1, None, T0, *fixed), (1, 2, T0, *fixed), (None, 3, T0, *fixed)]
    path = _land(spark, [rows], READING, "nulls")
    out = _drained(spark, P.pump_runs_stream(_stream(spark, path, READING))).where("plant = 1").collect()
    assert sorted(((o["device_id"], o["reading_id"], o["late"], o["run_start"]) for o in out), key=str) == sorted(
        [(1, 1, True, False), (1, None, False, True), (1, 2, False, False), (None, 3, False, True)], key=str)


def test_job_writes_kept_and_late_from_one_query(spark):
    rows = _readings(60, 5)
    base = scratch_path(spark, f"job-{uuid.uuid4().hex}")
    payload = F.to_json(F.struct("temperature", "humidity", "soil1", "soil2", "water", "pump1", "pump2"),
                        {"ignoreNullFields": "false"})
    named = [spark.createDataFrame(b, READING).select("device_id", "reading_id", "ts", payload.alias("payload"))
             for b in _split(rows, 5)]
    path = _land(spark, named, None, "payloads")
    settings = AL.settings_table(spark, {"email_enabled": "1", "email_recipient": "a@example.invalid"})
    raw = P.payload_stream(spark, path, named[0].schema, max_files=1)
    for q in P.start_ingest_job(raw, settings, f"{base}/out", f"{base}/ckpt").values():
        assert q.awaitTermination(600) and q.exception() is None
    alerts = spark.read.parquet(f"{base}/out/alerts")
    late = {(r["reading_id"], r["rule_pos"]) for r in alerts.where("late = 1").collect()}
    assert late
    readings = spark.read.parquet(f"{base}/out/readings").drop("date").collect()
    assert len(readings) == 60
    starts = sorted((r["reading_id"], r["type"]) for r in alerts.where("rule_pos >= 6").collect())
    want = []
    for plant in (1, 2):
        sub = [r for r in readings if (r["reading_id"], plant) not in late]
        runs = AL.pump_alerts(spark.createDataFrame(sub), settings).where(F.col("type").startswith(f"pump{plant}_"))
        want += [(r["reading_id"], r["type"]) for r in runs.collect()]
    assert starts == sorted(want)
    sent = spark.read.parquet(f"{base}/out/notifications")
    judged = sent.where("late = 0").count()
    kept = alerts.where("late = 0").drop("late")
    assert 0 < judged < kept.count()


def _commands(seed, n):
    r = random.Random(seed)
    return [(1 + i % 2, 1000 + i, T0 + dt.timedelta(minutes=r.randrange(0, 90), seconds=30), r.choice(["pump1", "PUMP2", "x"]),
             r.choice(["ON", "OFF", "toggle", "TOGGLE", "?"])) for i in range(n)]


COMMAND = "device_id long, command_id long, ts timestamp_ntz, pump string, action string"
SAMPLE = ("device_id long, reading_id long, ts timestamp_ntz, temperature double, humidity double, soil1_dry boolean, "
          "soil2_dry boolean, water_raw int")


def _by_time(rows, batches):
    """Time slices, the same for both inputs, so that a batch holds both sides of a time."""
    return [[x for x in rows if T0 + dt.timedelta(minutes=90 * i / batches) <= x[2]
             < T0 + dt.timedelta(minutes=90 * (i + 1) / batches)] for i in range(batches)]


@pytest.mark.parametrize("batches", [1, 3])
def test_decisions_and_states_equal_batch(spark, batches):
    r = random.Random(batches)
    samples = [(1 + i % 2, i, T0 + dt.timedelta(minutes=r.randrange(0, 90)), r.choice([20.0, float("nan"), None]) if i % 9 == 0
                else 21.0, 40.0, r.random() < 0.5, r.random() < 0.5, r.choice([100, 300])) for i in range(80)]
    commands = _commands(7, 24)
    spath = _land(spark, _by_time(samples, batches), SAMPLE, "samples")
    cpath = _land(spark, _by_time(commands, batches), COMMAND, "commands")
    s, c = spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(commands, COMMAND)
    cols = ["device_id", "reading_id", "manual_override", "pump1", "pump2"]
    got = _drained(spark, P.auto_pump_stream(_stream(spark, spath, SAMPLE), _stream(spark, cpath, COMMAND)))
    assert got.where("late").isEmpty()
    want = SQ.auto_pump_decision(s, c).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert want.where("manual_override").count() > 3
    rows = _readings(50, 3)
    rpath = _land(spark, _by_time(rows, batches), READING, "readings")
    cols = ["device_id", "source", "event_id", "pump1_state", "pump2_state"]
    got = _drained(spark, P.pump_state_stream(_stream(spark, rpath, READING), _stream(spark, cpath, COMMAND)))
    assert got.where("late").isEmpty()
    want = SQ.pump_state_timeline(spark.createDataFrame(rows, READING), c).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_cooldown_handed_over_between_stream_and_batch(spark):
    settings = AL.settings_table(spark, {"email_enabled": "1", "email_recipient": "a@example.invalid",
                                         "email_cooldown_minutes": "600"})
    alerts = AL.alerts_all(td.readings(spark, SF), settings)
    cuts = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-02-01"]
    parts = [alerts.where(f"ts >= timestamp_ntz'{a}' and ts < timestamp_ntz'{b}'") for a, b in zip(cuts, cuts[1:])]
    table, sent = spark.createDataFrame([], "device_id long, alert_type string, last_sent timestamp_ntz"), []
    for i, part in enumerate(parts):  # stream, batch, stream again
        if i == 1:
            kept = AL.notifications(part, settings, stored=table)
        else:
            half = F.col("ts") < F.lit(cuts[i + 1]).cast("timestamp_ntz") - F.expr("INTERVAL 4 DAYS")
            path = _land(spark, [part.where(half), part.where(~half)], None, "hand")
            kept = _drained(spark, P.notification_stream(_stream(spark, path, part.schema), settings, stored=table))
            assert kept.where("late").isEmpty()
        kept = spark.createDataFrame(kept.select("device_id", "reading_id", "rule_pos", "severity", "ts").collect(),
                                     "device_id long, reading_id long, rule_pos int, severity string, ts timestamp_ntz")
        sent += [tuple(r) for r in kept.select("device_id", "reading_id", "rule_pos").collect()]
        table = MT.cooldown_upsert(table, kept.select("device_id", F.col("severity").alias("alert_type"),
                                                      F.col("ts").alias("last_sent")), keys=("device_id", "alert_type"))
        table = spark.createDataFrame(table.collect(), "device_id long, alert_type string, last_sent timestamp_ntz")
    last, want = {}, []
    for a in sorted(alerts.collect(), key=lambda a: (a["ts"], a["reading_id"], a["rule_pos"])):
        k = (a["device_id"], a["severity"])
        if k not in last or a["ts"] - last[k] >= dt.timedelta(minutes=600):
            last[k] = a["ts"]
            want.append((a["device_id"], a["reading_id"], a["rule_pos"]))
    assert sorted(sent) == sorted(want)
    assert {(r["device_id"], r["alert_type"]): r["last_sent"] for r in table.collect()} == last


def test_idle_key_is_released(spark):
    fixed = (20.0, 50.0, "DRY", "DRY", "AVAILABLE", "ON", "ON", 0, 0, 0)
    path = _land(spark, [[(1, i, T0 + dt.timedelta(minutes=i), *fixed) for i in range(4)]], READING, "idle")
    name = f"t_{uuid.uuid4().hex[:8]}"
    runs = P.pump_runs_stream(_stream(spark, path, READING), wait_seconds=3600, idle_seconds=2)
    q = runs.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, name)) \
        .trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table(name).count() < 8:
            time.sleep(1)
        assert q.exception() is None
        assert spark.table(name).where("plant = 1 and not late").count() == 4
    finally:
        q.stop()


def test_weather_feeds(spark):
    pay = weather_payloads_from_events(td.load(spark, SF, "events"))
    near = F.col("id") % 7
    current = pay.where("id % 5 > 0").select("id", "ts", "city", "lat", "lon", "current_json")
    # Landed some seconds to minutes after; of some places too late, of some not at all.
    moved = (F.col("ts") + F.make_dt_interval(mins=F.when(near == 1, 30).otherwise(near.cast("int")))).alias("ts")
    forecast = pay.where("id % 3 > 0").select("id", moved, "city", "lat", "lon", "forecast_json")
    want = join_feeds(current, forecast)
    cols = ["id", "ts", "rain_forecast", "weather_description", "location_city", "forecast_id", "feeds"]
    def key(df):
        return sorted(map(str, df.select(*cols).collect()))
    # A last far pair moves the watermark past everything else.
    far = lambda df: df.limit(1).withColumn("ts", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz")) \
        .withColumn("city", F.lit("far")).withColumn("id", F.lit(-1).cast("long"))
    def halves(df):
        half = F.lit("2024-01-15").cast("timestamp_ntz")
        return [df.where(F.col("ts") < half), df.where(F.col("ts") >= half), far(df)]
    cpath, fpath = _land(spark, halves(current), None, "cur"), _land(spark, halves(forecast), None, "fc")
    got = _drained(spark, P.weather_stream(_stream(spark, cpath, current.schema), _stream(spark, fpath, forecast.schema)))
    assert key(got.where("location_city <> 'far'")) == key(want)
    kinds = {r["feeds"]: r["count"] for r in want.groupBy("feeds").count().collect()}
    assert set(kinds) == {"both", "current", "forecast"}
    whole = weather_rows(pay).select("id", "rain_forecast")
    both = want.where("feeds = 'both' and id = forecast_id").select("id", "rain_forecast")
    assert both.count() == both.join(whole, ["id", "rain_forecast"]).count() > 10


def test_mail_settings_by_device(spark):
    """Gate and cooldown of each device, batch and stream, against a sequential fold."""
    general = {"email_enabled": "1", "email_recipient": "a@example.invalid", "email_cooldown_minutes": "30"}
    rows = sorted(_readings(90, 12), key=lambda x: (x[2], x[1]))
    rows = [(d + (i % 4 == 0) * 2, i, *x) for i, (d, _, *x) in enumerate(rows)]  # devices 1 to 4
    own = [(2, "email_cooldown_minutes", "7"), (3, "email_enabled", "0"), (4, "email_recipient", ""), (4, "alert_high_temp", "0")]
    settings = AL.settings_table(spark, general).select(F.lit(None).cast("long").alias("device_id"), "key", "value") \
        .unionByName(spark.createDataFrame(own, "device_id long, key string, value string"))
    alerts = AL.alerts_all(spark.createDataFrame(rows, READING), settings)
    last, want = {}, []
    for a in sorted(alerts.collect(), key=lambda a: (a["ts"], a["reading_id"], a["rule_pos"])):
        d = a["device_id"]
        if d in (3, 4):  # off, no recipient
            continue
        k, minutes = (d, a["severity"]), 7 if d == 2 else 30
        if k not in last or a["ts"] - last[k] >= dt.timedelta(minutes=minutes):
            last[k] = a["ts"]
            want.append((d, a["reading_id"], a["rule_pos"]))
    got = [tuple(r) for r in AL.notifications(alerts, settings).select("device_id", "reading_id", "rule_pos").collect()]
    assert sorted(got) == sorted(want) and {w[0] for w in want} == {1, 2}
    path = _land(spark, [alerts.where("reading_id < 40"), alerts.where("reading_id >= 40")], None, "mail")
    sent = _drained(spark, P.notification_stream(_stream(spark, path, alerts.schema), settings))
    assert sent.where("late").isEmpty()
    assert sorted(tuple(r) for r in sent.select("device_id", "reading_id", "rule_pos").collect()) == sorted(want)
    table = spark.createDataFrame([(d, s, t) for (d, s), t in last.items()], "device_id long, alert_type string, last_sent timestamp_ntz")
    later = alerts.withColumn("ts", F.col("ts") + F.expr("INTERVAL 95 MINUTES"))
    first = AL.notifications(later, settings, stored=table).groupBy("device_id", "severity").agg(F.min("ts").alias("t")).collect()
    for r in first:
        assert r["t"] - last[(r["device_id"], r["severity"])] >= dt.timedelta(minutes=7 if r["device_id"] == 2 else 30)
