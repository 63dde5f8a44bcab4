"""M1-M6: feature sets, scaling and train/test splits.

The three feature sets differ on purpose (they mirror three generations of
the original code); all lag/rolling features come from one bucketed window
(``sequence_features``), never from a whole-device window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.columns import any_pump_on, combined_dryness, dow_monday0, dow_sunday0, sin_cos, \
    water_available
from hydrospark.operators.filters import complete_rows, trailing_window
from hydrospark.operators.latest import top_k_per_key
from hydrospark.operators.ordered import BKT, DEVICE_ORDER, prefix
from hydrospark.operators.ranking import below_cut, id_hash, smallest_hashes, stratified_test_counts
from hydrospark.operators.sequences import sequence_features

# Feature names of each set, in model order (fixed values).
SCHEDULE_FEATURES = [
    "temperature", "humidity", "soil_dry",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "temp_lag_1", "humidity_lag_1", "soil_dry_lag_1",
    "temp_ma_3", "humidity_ma_3", "soil_dry_ma_3",
    "temp_humidity_interaction",
    "water_available",
]

OFFLINE_FEATURES = [
    "temperature", "humidity", "soil",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "temp_lag_1", "humidity_lag_1", "soil_lag_1",
    "temp_ma_3", "humidity_ma_3", "soil_ma_3",
    "temp_humidity_interaction", "humidity_soil_interaction",
]

EVAL_FEATURES = [
    "temperature", "humidity", "soil",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "temp_lag_1", "humidity_lag_1", "soil_lag_1",
    "temp_ma_3", "humidity_ma_3", "soil_ma_3",
    "temp_humidity_interaction", "humidity_soil_interaction",
    "water_available",
]


def _drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def _min_rows_guard(df: DataFrame, of: DataFrame, min_rows: int) -> DataFrame:
    """Keep ``df`` only if ``of`` has at least ``min_rows`` rows (one-row count,
    broadcast-joined; nothing is collected)."""
    n = of.agg(F.count(F.lit(1)).alias("_n"))
    return df.crossJoin(F.broadcast(n)).filter(F.col("_n") >= min_rows).drop("_n")


def features_schedule(readings: DataFrame, as_of: Column, days: int = 30, min_rows: int = 10) -> DataFrame:
    """M1: feature set A (17 columns) + ``target`` (any pump on).

    Last ``days`` days, complete rows, weekday with Sunday = 0; rows with any
    null lag/rolling value (the first 5 per device) are dropped. Fewer than
    ``min_rows`` rows before or after cleaning -> empty.
    """
    r = complete_rows(trailing_window(readings, as_of, days))
    # Rows before and after cleaning, from per-device counts: with complete
    # rows only the first 5 rows of a device lack a lag/rolling value.
    per_dev = r.groupBy("device_id").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per_dev.agg(F.sum("_n").alias("_before"),
                        F.sum(F.greatest(F.col("_n") - 5, F.lit(0))).alias("_after"))
    base = r.select(
        "reading_id", "device_id", "ts", "temperature", "humidity",
        combined_dryness().alias("soil_dry"),
        F.hour("ts").alias("hour"), dow_sunday0(F.col("ts")).alias("day_of_week"), F.month("ts").alias("month"),
        any_pump_on().alias("target"), water_available().alias("water_available"))
    feats = sequence_features(base, {"temp": "temperature", "humidity": "humidity", "soil_dry": "soil_dry"},
                              lags=(1, 2, 3), windows=(3, 6))
    out = feats.select(
        "*", *sin_cos(F.col("hour"), 24, "hour"), *sin_cos(F.col("day_of_week"), 7, "day"),
        *sin_cos(F.col("month"), 12, "month"),
        (F.col("temperature") * F.col("humidity") / F.lit(100.0)).alias("temp_humidity_interaction"))
    lag_ma = [f"{s}_{k}" for s in ("temp", "humidity", "soil_dry") for k in ("lag_1", "lag_2", "lag_3", "ma_3", "ma_6")]
    out = _drop_incomplete(out, lag_ma)
    # Tested behind the windows, which read their input twice.
    out = out.crossJoin(F.broadcast(sizes)).filter((F.col("_before") >= min_rows) & (F.col("_after") >= min_rows))
    return out.select("reading_id", "device_id", "ts", *SCHEDULE_FEATURES, "target")


def features_offline(legacy: DataFrame, as_of: Column, days: int = 90, min_rows: int = 50) -> DataFrame:
    """M2: feature set B (15 columns, interactions unscaled) on legacy rows
    with numeric ``soil``; lags 1,2,3,24 and means over 3,6,12,24 rows, so
    the first 24 rows per device are dropped. Needs ``min_rows`` rows."""
    r = legacy.withColumnRenamed("timestamp", "ts") if "timestamp" in legacy.columns else legacy
    r = trailing_window(r, as_of, days).filter(
        F.col("temperature").isNotNull() & F.col("humidity").isNotNull() & F.col("soil").isNotNull())
    base = r.select(
        "reading_id", "device_id", "ts", "temperature", "humidity", F.col("soil").cast("double").alias("soil"),
        F.hour("ts").alias("hour"), dow_sunday0(F.col("ts")).alias("day_of_week"),
        F.when(F.col("pump") == "ON", 1).otherwise(0).alias("target"), "pump_duration")
    feats = sequence_features(base, {"temp": "temperature", "humidity": "humidity", "soil": "soil"},
                              lags=(1, 2, 3, 24), windows=(3, 6, 12, 24))
    out = feats.select(
        "*", *sin_cos(F.col("hour"), 24, "hour"), *sin_cos(F.col("day_of_week"), 7, "day"),
        (F.col("temperature") * F.col("humidity")).alias("temp_humidity_interaction"),
        (F.col("temperature") * F.col("soil")).alias("temp_soil_interaction"),
        (F.col("humidity") * F.col("soil")).alias("humidity_soil_interaction"))
    lag_ma = [f"{s}_{k}" for s in ("temp", "humidity", "soil")
              for k in ("lag_1", "lag_2", "lag_3", "lag_24", "ma_3", "ma_6", "ma_12", "ma_24")]
    out = _min_rows_guard(_drop_incomplete(out, lag_ma), r, min_rows)
    return out.select("reading_id", "device_id", "ts", *OFFLINE_FEATURES, "target")


def features_eval(legacy: DataFrame, first_n: int = 500) -> DataFrame:
    """M3: evaluation set C on the first ``first_n`` rows per device (Monday =
    0 weekday, month, interactions /100 and /1000); the first 2 rows per
    device drop out (3-row mean)."""
    r = legacy.withColumnRenamed("timestamp", "ts") if "timestamp" in legacy.columns else legacy
    r = r.filter(F.col("temperature").isNotNull() & F.col("humidity").isNotNull() & F.col("soil").isNotNull())
    r = top_k_per_key(r, first_n, order=[F.col("ts"), F.col("reading_id")])
    base = r.select(
        "reading_id", "device_id", "ts", "temperature", "humidity", F.col("soil").cast("double").alias("soil"),
        water_available().alias("water_available"), F.when(F.col("pump") == "ON", 1).otherwise(0).alias("actual"),
        F.hour("ts").alias("hour"), dow_monday0(F.col("ts")).alias("day"), F.month("ts").alias("month"))
    feats = sequence_features(base, {"temp": "temperature", "humidity": "humidity", "soil": "soil"},
                              lags=(1,), windows=(3,))
    out = feats.select(
        "*", *sin_cos(F.col("hour"), 24, "hour"), *sin_cos(F.col("day"), 7, "day"),
        *sin_cos(F.col("month"), 12, "month"),
        (F.col("temperature") * F.col("humidity") / F.lit(100.0)).alias("temp_humidity_interaction"),
        (F.col("humidity") * F.col("soil") / F.lit(1000.0)).alias("humidity_soil_interaction"))
    out = _drop_incomplete(out, ["temp_lag_1", "humidity_lag_1", "soil_lag_1", "temp_ma_3", "humidity_ma_3",
                                 "soil_ma_3"])
    return out.select("reading_id", "device_id", "ts", *EVAL_FEATURES, "actual")


# M4 --------------------------------------------------------------------------------

def scaler_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """M4 fit: one row of population mean and std per feature (a single
    aggregate; the result is len(cols) x 2 numbers)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def standardize(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """M4 apply: (x - mean) / std, with std 0 (constant column) treated as 1."""
    j = df.crossJoin(F.broadcast(stats))  # one row
    out = j.select(*[c for c in df.columns if c not in cols],
                   *[((F.col(c) - F.col(f"{c}__mean")) /
                      F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(F.lit(1.0))).alias(c)
                     for c in cols])
    return out.select(*df.columns)


# M5 / M6 ------------------------------------------------------------------------

def split_stratified(df: DataFrame, label: str = "target", test_fraction: float = 0.2, seed: int = 42,
                     id_col: str = "reading_id") -> DataFrame:
    """M5: adds ``is_test``. Exactly ceil(test_fraction * n) rows are test rows,
    shared out to the classes in proportion; in each class they are the rows with
    the smallest hashes of (id, seed), found by exact selection
    (``operators.ranking``) without sorting the table. Rows of one id go together."""
    d = df.withColumn("_h", id_hash(id_col, seed))
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    if not counts:
        return df.withColumn("is_test", F.lit(False))
    cuts = smallest_hashes(d, label, "_h", stratified_test_counts(counts, test_fraction))
    return d.withColumn("is_test", below_cut(label, "_h", cuts)).drop("_h")


def split_chronological(df: DataFrame, test_fraction: float = 0.2, keys=("device_id",)) -> DataFrame:
    """M6: per device, the last ceil(test_fraction * n) rows in time order are
    the test set (running position + per-device count, no whole-device sort)."""
    pos = prefix(df, DEVICE_ORDER, sums={"_pos": F.lit(1).cast("long")}).drop(BKT)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = pos.join(n, list(keys))
    n_test = F.ceil(F.col("_n") * F.lit(test_fraction))
    return j.withColumn("is_test", F.col("_pos") > F.col("_n") - n_test).drop("_pos", "_n")


__all__ = ["features_schedule", "features_offline", "features_eval", "scaler_stats", "standardize",
           "split_stratified", "split_chronological", "SCHEDULE_FEATURES", "OFFLINE_FEATURES", "EVAL_FEATURES"]
