"""Sinks: K1, K2, K5, K12-K15 and the forecast CSVs (K3/K4).

Writers take a DataFrame and a path. Paths on a cluster must be shared
storage; tests pass a folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators.maintenance import replace_schedule
from hydrospark.schemas import READING_COLUMNS, READINGS_CSV_HEADERS
from hydrospark.sources.timestamps import display_ts


def append_readings(readings: DataFrame, path: str) -> None:
    """K1: append normalised readings, partitioned by day so trailing-window
    queries prune partitions (filter on both ``date`` and ``ts``). The rows are
    rebalanced by day: adaptive execution splits a large day into many tasks of
    the advisory partition size and puts small days together, one file a day and
    task, whatever the number of days and rows."""
    dated = readings.withColumn("date", F.to_date("ts"))
    dated.hint("rebalance", F.col("date")).write.mode("append").partitionBy("date").parquet(path)


def append_readings_stream(readings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """K1 streaming: same layout, exactly-once file sink with a checkpoint."""
    w = readings.withColumn("date", F.to_date("ts")).writeStream.format("parquet") \
        .option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def export_readings_frame(readings: DataFrame) -> DataFrame:
    """K2: all columns in time order with the 12 display headers; timestamps
    as ``yyyy-MM-dd HH:mm:ss`` ('' when missing)."""
    cols = []
    for name, header in zip([c for c in READING_COLUMNS if c != "device_id"], READINGS_CSV_HEADERS):
        c = F.col(name)
        if name == "ts":
            c = F.coalesce(display_ts(c), F.lit(""))
        cols.append(c.alias(header))
    return readings.orderBy("ts", "reading_id").select("device_id", *cols)


def export_readings_csv(readings: DataFrame, path: str) -> None:
    """K2: write the export frame as CSV with a header (one file per task)."""
    export_readings_frame(readings).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_forecast_rows(rows: DataFrame, path: str) -> None:
    """K5: append stored prediction rows."""
    rows.write.mode("append").parquet(path)


def metrics_csv_frame(metrics: DataFrame) -> DataFrame:
    """The four percentages as one row with report headers."""
    return metrics.select(F.col("accuracy_pct").alias("Accuracy (%)"), F.col("precision_pct").alias("Precision (%)"),
                          F.col("recall_pct").alias("Recall (%)"), F.col("f1_pct").alias("F1-Score (%)"))


def training_report_json(report: DataFrame, path: str) -> None:
    """The one-row training report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_training_log(rows: DataFrame, path: str) -> None:
    """One row per training attempt."""
    rows.write.mode("append").parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def overwrite_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of ``path`` that ``df`` has rows for and leave the
    files of all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def retain_table(spark: SparkSession, path: str, as_of: datetime.datetime, days: int = 7, ts: str = "ts") -> None:
    """K6 on a table partitioned by ``date``: rows with ts < as_of - days go.
    Days before the cut are deleted as folders, the day of the cut is rewritten,
    later days keep their files. The dates come from the partitions, no row is
    read for them. Idempotent: a job that was stopped half-way is run again."""
    cut = as_of - datetime.timedelta(days=days)
    table = spark.read.parquet(path)
    dates = [r["date"] for r in table.select("date").distinct().collect()]  # one row per day
    day = F.lit(cut.date())
    if cut.date() in dates:
        limit = F.lit(cut).cast(dict(table.dtypes)[ts])
        kept = table.where((F.col("date") == day) & (F.col(ts) >= limit))
        if kept.isEmpty():
            dates_gone = [d for d in dates if d is not None and d <= cut.date()]
        else:
            overwrite_partitions(kept, path, "date")
            dates_gone = [d for d in dates if d is not None and d < cut.date()]
    else:
        dates_gone = [d for d in dates if d is not None and d < cut.date()]
    for d in dates_gone:
        _delete(spark, f"{path}/date={d.isoformat()}")


def _schedule_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int").alias("bucket")


def write_schedules(schedules: DataFrame, path: str, buckets: int = 64) -> None:
    """Schedules as a table dealt to ``buckets`` folders by device."""
    schedules.select("*", _schedule_bucket(buckets)).repartition("bucket").write.mode("overwrite") \
        .partitionBy("bucket").parquet(path)


def replace_schedules(spark: SparkSession, path: str, new_rows: DataFrame, buckets: int = 64) -> None:
    """K10 on the table of ``write_schedules``: the submitted lists replace the
    schedules of their devices. Only buckets with such a device are read and
    rewritten; the others keep their files."""
    new = replace_schedule(new_rows).select("*", _schedule_bucket(buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    kept = old.join(new.select("device_id").distinct(), "device_id", "left_anti")
    overwrite_partitions(kept.select(*new.columns).unionByName(new).repartition("bucket"), path, "bucket")


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace a table with a new version (K7-K12 results)."""
    df.write.mode("overwrite").parquet(path)
