"""Table writes touch what they must and nothing else."""

import datetime as dt
import glob
import os
import uuid

from pyspark.sql import functions as F

from hydrospark.session import scratch_path
from hydrospark.sinks import writers as W


def _files(path):
    """part files by folder: name -> modification time."""
    path = path.removeprefix("file:")
    out = {}
    for f in glob.glob(f"{path}/*/part-*"):
        out.setdefault(os.path.basename(os.path.dirname(f)), {})[os.path.basename(f)] = os.stat(f).st_mtime_ns
    return out


def _path(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def test_retain_drops_days_and_rewrites_one(spark):
    rows = spark.range(240).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int))").alias("ts"))
    path = _path(spark, "retain")
    W.append_readings(rows, path)
    before = _files(path)
    as_of = dt.datetime(2024, 1, 11, 5)
    W.retain_table(spark, path, as_of, 7)
    back = spark.read.parquet(path)
    want = rows.where("ts >= timestamp_ntz'2024-01-04 05:00:00'")
    assert sorted(r["id"] for r in back.collect()) == sorted(r["id"] for r in want.collect())
    after = _files(path)
    assert sorted(after) == [f"date=2024-01-{d:02d}" for d in range(4, 11)]
    for day, files in after.items():
        assert (files == before[day]) is (day != "date=2024-01-04")
    W.retain_table(spark, path, as_of, 7)  # again: nothing more goes
    assert spark.read.parquet(path).count() == want.count()
    W.retain_table(spark, path, dt.datetime(2024, 1, 12), 7)  # a cut at midnight keeps its whole day
    assert sorted(_files(path)) == [f"date=2024-01-{d:02d}" for d in range(5, 11)]
    # The day of the cut has no row left.
    W.retain_table(spark, path, dt.datetime(2024, 1, 12, 23, 30), 7)
    assert sorted(_files(path)) == [f"date=2024-01-{d:02d}" for d in range(6, 11)]


def _schedule(spark, rows):
    return spark.createDataFrame(rows, "device_id long, pos long, hour int, minute int, duration int, plant string, enabled boolean")


def test_replaced_schedules_leave_other_folders(spark):
    path = _path(spark, "schedules")
    old = [(d, p, p % 24, 0, 60, None, None) for d in range(30) for p in range(d % 4 + 1)]
    from hydrospark.operators.maintenance import replace_schedule
    W.write_schedules(replace_schedule(_schedule(spark, old)), path, buckets=8)
    before = _files(path)
    new = [(3, 5, 7, 30, 10, "plant1", False), (3, 2, 6, 0, 20, None, None)]
    W.replace_schedules(spark, path, _schedule(spark, new), buckets=8)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("device_id", "id", "hour", "duration", "plant", "enabled").collect())
    want = sorted([(d, p + 1, p % 24, 60, "both", 1) for d in range(30) if d != 3 for p in range(d % 4 + 1)]
                  + [(3, 1, 6, 20, "both", 1), (3, 2, 7, 10, "plant1", 0)])
    assert got == want
    changed = [b for b, files in _files(path).items() if files != before[b]]
    assert len(changed) == 1
    W.replace_schedules(spark, path, _schedule(spark, []), buckets=8)
    assert spark.read.parquet(path).count() == len(want)


def test_a_hot_day_is_written_by_many_tasks(spark):
    day = F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 7).cast("int")
    rows = spark.range(200_000, numPartitions=12).select(
        "id", F.rand(1).alias("noise"), F.expr("timestamp_ntz'2024-01-01'").alias("ts0"), day.alias("d")) \
        .select("id", "noise", (F.col("ts0") + F.make_dt_interval("d")).alias("ts"))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.shuffle.partitions": "200"}
    keep = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        path = _path(spark, "hot")
        W.append_readings(rows, path)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    files = {d: len(f) for d, f in _files(path).items()}
    assert files["date=2024-01-01"] >= 5
    assert all(n <= 2 for d, n in files.items() if d != "date=2024-01-01") and len(files) == 7
    assert spark.read.parquet(path).count() == 200_000
