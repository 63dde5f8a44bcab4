"""Sources and sinks that touch files: S4 snapshots, K1 append, K2 export,
K10 schedule replacement, T8 recent log rows, M12 save/load."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from hydrospark.operators import latest, maintenance as MT
from hydrospark.session import scratch_path
from hydrospark.sinks import writers
from hydrospark.sources import legacy, testdata as td

HEADER = "timestamp,temperature,humidity,soil,water,pump,pump_duration,manual_override\n"
LINES = ["2026-02-09 10:28:39,0.0,0.0,0,AVAILABLE,OFF,0,1\n",
         "2026-02-09 10:28:45,0.0,0.0,0,AVAILABLE,ON,0,1\n",
         "2026-02-09 10:30:24,27.5,54.4,600,NOT AVAILABLE,OFF,0,0\n",
         "2026-02-09 10:30:24,27.5,54.4,600,NOT AVAILABLE,OFF,0,0\n",   # in-file duplicate is kept
         "2026-02-09 10:31:00,28.0,55.0,600,AVAILABLE,ON,120,0\n"]


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_read_snapshots_dedupes_cumulative_files(spark):
    d = _local(scratch_path(spark, f"snap-{uuid.uuid4().hex}"))
    os.makedirs(d)
    # cumulative snapshots: each is a prefix of the next; the last is repeated
    for i, n in enumerate([2, 4, 5, 5]):
        with open(os.path.join(d, f"snap{i}.csv"), "w") as f:
            f.write(HEADER + "".join(LINES[:n]))
    df = legacy.read_snapshots(spark, d)
    assert df.count() == 5
    assert df.filter(F.col("timestamp") == F.lit("2026-02-09 10:30:24").cast("timestamp")).count() == 2
    migrated = legacy.migrate_legacy(df)
    assert {"soil1", "soil2", "pump1", "pump2"} <= set(migrated.columns)


def test_append_and_export_readings(spark):
    r = td.readings(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, f"readings-{uuid.uuid4().hex}")
    writers.append_readings(r, path)
    back = spark.read.parquet(path)
    assert back.count() == r.count()
    plan = back.filter(F.col("date") == F.lit("2024-01-05").cast("date"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan
    exp = writers.export_readings_frame(r)
    assert exp.columns[1:] == ["ID", "Timestamp", "Temperature (°C)", "Humidity (%)", "Soil1 Status",
                               "Soil2 Status", "Water Level", "Pump1 Status", "Pump2 Status",
                               "Pump1 Duration (s)", "Pump2 Duration (s)", "Manual Override"]
    out = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    writers.export_readings_csv(r, out)
    assert spark.read.option("header", True).csv(out).count() == r.count()


def test_replace_schedule_and_ordering(spark):
    rows = [(1, 3, 18, 0, 300, None, None), (1, 1, 8, 0, 300, "plant1", False), (2, 7, 6, 30, 60, "plant2", True)]
    new = spark.createDataFrame(rows, "device_id long, pos long, hour int, minute int, duration int, plant string, "
                                      "enabled boolean")
    rep = MT.replace_schedule(new)
    got = {(r["device_id"], r["id"]): (r["hour"], r["plant"], r["enabled"]) for r in rep.collect()}
    assert got == {(1, 1): (8, "plant1", 0), (1, 2): (18, "both", 1), (2, 1): (6, "plant2", 1)}
    ordered = latest.schedule_ordered(rep).filter("device_id = 1").orderBy("position").collect()
    assert [(r["hour"], r["enabled"]) for r in ordered] == [(8, False), (18, True)]


def test_training_log_recent_and_cooldown(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, t0 + dt.timedelta(hours=i), "success") for i in range(10)],
                                "id long, ts timestamp, status string")
    assert [r["id"] for r in latest.training_log_recent(log, 7).collect()] == [9, 8, 7, 6, 5, 4, 3]
    old = spark.createDataFrame([("danger", t0)], "alert_type string, last_sent timestamp")
    sent = spark.createDataFrame([("danger", t0 + dt.timedelta(hours=1)), ("info", t0)],
                                 "alert_type string, last_sent timestamp")
    got = {r["alert_type"]: r["last_sent"] for r in MT.cooldown_upsert(old, sent).collect()}
    assert got == {"danger": t0 + dt.timedelta(hours=1), "info": t0}


def test_model_save_load_roundtrip(spark):
    from hydrospark.operators.features import SCHEDULE_FEATURES, features_schedule, standardize
    from hydrospark.plans import training as TR
    f = features_schedule(td.readings(spark, "/root/testdata/sf0.001"), td.as_of_lit())
    t = TR.train_pump_classifier(f, SCHEDULE_FEATURES, num_trees=5, max_depth=4)
    m = t.metrics.first()
    assert m["status"] == "success" and 0.0 <= m["accuracy"] <= 1.0
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    TR.save_model(t, path, td.AS_OF)
    model, stats, info = TR.load_model(spark, path)
    assert info.first()["feature_count"] == len(SCHEDULE_FEATURES)
    p = TR.score(model, standardize(f, stats, SCHEDULE_FEATURES)).agg(F.min("p_on"), F.max("p_on")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0
