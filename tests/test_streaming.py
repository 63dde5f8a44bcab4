"""Streams equal batch: the same readings split over several micro-batches."""

import os
import uuid

from pyspark.sql import functions as F

from hydrospark.operators import alerts as AL
from hydrospark.operators.throttle import throttle
from hydrospark.session import scratch_path
from hydrospark.sources import testdata as td
from hydrospark.streaming.pipeline import alert_stream, notification_stream, run_available_now

SF = "/root/testdata/sf0.001"


def _split_to_files(spark, df, path, n_files=4):
    # One file per time slice, so the stream sees several micro-batches in order.
    bounds = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = (bounds["hi"] - bounds["lo"]) / n_files
    for i in range(n_files):
        lo = bounds["lo"] + span * i
        hi = bounds["lo"] + span * (i + 1)
        part = df.filter((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) if i < n_files - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)


def _key(r):
    return (r["device_id"], r["reading_id"], r["rule_pos"], r["type"], r["message"])


def test_alert_stream_equals_batch(spark):
    readings = td.readings(spark, SF)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    src = os.path.join(base, "readings")
    _split_to_files(spark, readings, src)
    settings = AL.settings_table(spark)
    stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run_available_now(alert_stream(stream, settings), "alerts_stream_test", os.path.join(base, "ckpt"))
    got = sorted(_key(r) for r in spark.table("alerts_stream_test").collect())
    exp = sorted(_key(r) for r in AL.alerts_all(readings, settings).collect())
    assert got == exp and len(got) > 0


def test_notification_stream_equals_batch(spark):
    readings = td.readings(spark, SF)
    settings = AL.settings_table(spark, {"email_enabled": "1", "email_recipient": "a@example.invalid",
                                         "email_cooldown_minutes": "600"})
    alerts = AL.alerts_all(readings, settings)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    src = os.path.join(base, "alerts")
    _split_to_files(spark, alerts, src)
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run_available_now(notification_stream(stream, settings), "notify_stream_test", os.path.join(base, "ckpt"))
    got = sorted(_key(r) for r in spark.table("notify_stream_test").collect())
    exp = sorted(_key(r) for r in throttle(AL.alert_enabled(alerts, settings, "severity"), ["device_id", "severity"],
                                           600 * 60, order_cols=("ts", "reading_id", "rule_pos")).collect())
    assert got == exp and len(got) > 0


def test_ingest_job_equals_batch(spark):
    from hydrospark.sources import ingest
    from hydrospark.streaming.pipeline import start_ingest_job
    events = td.load(spark, SF, "events")
    payloads = ingest.payloads_from_events(events)
    base = scratch_path(spark, f"job-{uuid.uuid4().hex}")
    src = os.path.join(base, "payloads")
    _split_to_files(spark, payloads, src)
    settings = AL.settings_table(spark, {"email_enabled": "1", "email_recipient": "a@example.invalid"})
    raw = spark.readStream.schema(payloads.schema).option("maxFilesPerTrigger", 1).parquet(src)
    queries = start_ingest_job(raw, settings, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    for q in queries.values():
        assert q.awaitTermination(600)
        assert q.exception() is None
    ok, bad = ingest.ingest(payloads)
    out = os.path.join(base, "out")
    assert spark.read.parquet(os.path.join(out, "readings")).count() == ok.count()
    assert spark.read.parquet(os.path.join(out, "rejects")).count() == bad.count()
    exp_alerts = AL.alerts_all(ok, settings)
    got_alerts = spark.read.parquet(os.path.join(out, "alerts"))
    assert got_alerts.where("late = 1").isEmpty()
    assert sorted(_key(r) for r in got_alerts.collect()) == sorted(_key(r) for r in exp_alerts.collect())
    exp_notes = throttle(AL.alert_enabled(exp_alerts, settings, "severity"), ["device_id", "severity"], 600,
                         order_cols=("ts", "reading_id", "rule_pos"))
    got_notes = spark.read.parquet(os.path.join(out, "notifications"))
    assert sorted(_key(r) for r in got_notes.collect()) == sorted(_key(r) for r in exp_notes.collect())
