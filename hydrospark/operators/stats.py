"""Aggregations. All are single hash aggregates (partial + final),
keyed by ``device_id`` unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.columns import any_pump_on, is_dry, pct, round_d, round_or_zero, soil_value, truthy_or
from hydrospark.operators.filters import complete_rows, trailing_window
from hydrospark.schemas import RECENT_DEFAULTS


def daily_stats(readings: DataFrame, as_of: Column, days: int = 1, keys=("device_id",)) -> DataFrame:
    """A1: trailing-day averages, dry/usage percentages, pump seconds and
    water warnings; averages and percentages rounded to 2; null -> 0."""
    r = trailing_window(readings, as_of, days)
    n = F.count(F.lit(1))
    return r.groupBy(*keys).agg(
        round_or_zero(F.avg("temperature")).alias("avg_temperature"),
        round_or_zero(F.avg("humidity")).alias("avg_humidity"),
        round_or_zero(pct(F.sum(is_dry("soil1")), n)).alias("soil1_dry_percent"),
        round_or_zero(pct(F.sum(is_dry("soil2")), n)).alias("soil2_dry_percent"),
        round_or_zero(pct(F.count_if(F.col("pump1") == "ON"), n)).alias("pump1_usage_percent"),
        round_or_zero(pct(F.count_if(F.col("pump2") == "ON"), n)).alias("pump2_usage_percent"),
        F.coalesce(F.sum("pump1_duration"), F.lit(0)).cast("long").alias("total_pump1_time"),
        F.coalesce(F.sum("pump2_duration"), F.lit(0)).cast("long").alias("total_pump2_time"),
        F.count_if(F.col("water") == "NOT AVAILABLE").cast("long").alias("water_warnings"),
    )


def recent_averages(readings: DataFrame, as_of: Column, days: int = 3, keys=("device_id",)) -> DataFrame:
    """A3: trailing 3 days over complete rows; null **or exactly 0** falls back
    to 25.0 / 60.0 / 0.5 / 0.5 (truthiness test of the original)."""
    r = complete_rows(trailing_window(readings, as_of, days))
    n = F.count(F.lit(1))
    agg = r.groupBy(*keys).agg(
        F.avg("temperature").alias("t"), F.avg("humidity").alias("h"),
        (F.sum(is_dry("soil1")) * F.lit(1.0) / n).alias("d1"),
        (F.sum(is_dry("soil2")) * F.lit(1.0) / n).alias("d2"))
    out = agg.select(
        *keys,
        truthy_or(F.col("t"), RECENT_DEFAULTS["avg_temperature"]).alias("avg_temperature"),
        truthy_or(F.col("h"), RECENT_DEFAULTS["avg_humidity"]).alias("avg_humidity"),
        truthy_or(F.col("d1"), RECENT_DEFAULTS["soil1_dry_ratio"]).alias("soil1_dry_ratio"),
        truthy_or(F.col("d2"), RECENT_DEFAULTS["soil2_dry_ratio"]).alias("soil2_dry_ratio"))
    return out.withColumn("avg_soil_dry", (F.col("soil1_dry_ratio") + F.col("soil2_dry_ratio")) / F.lit(2.0))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A4: row count per named table (each count is a partial aggregate)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def samples_since_training(readings: DataFrame, training_log: DataFrame,
                           default_since: str = "2000-01-01 00:00:00") -> DataFrame:
    """A5: newest successful training time (default 2000-01-01) and the number
    of readings strictly after it. The one-row time is read first and becomes a
    literal, so the filter reaches the scan of the readings."""
    last = training_log.filter(F.col("status") == "success").agg(F.max("ts").alias("last_success"))
    last = last.select(F.coalesce(F.col("last_success").cast("timestamp_ntz"),
                                  F.lit(default_since).cast("timestamp_ntz")).alias("last_success"))
    ts_type = dict(readings.dtypes)["ts"]
    r = readings.select("ts")
    since = F.lit(last.first()["last_success"]).cast("timestamp_ntz")
    cnt = r.filter(F.col("ts") > since.cast(ts_type)).agg(F.count(F.lit(1)).cast("long").alias("new_samples"))
    return cnt.select(since.alias("last_success"), "new_samples")


def should_retrain(since: DataFrame, model_exists: bool, min_new: int = 10) -> DataFrame:
    """Retrain when at least ``min_new`` new readings arrived, or no model."""
    return since.withColumn("retrain", (F.col("new_samples") >= min_new) | F.lit(not model_exists))


def dataset_summary(readings: DataFrame, keys=("device_id",)) -> DataFrame:
    """Row count, time range, pump-on count and percentage (any pump on)."""
    on = any_pump_on()
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(on).cast("long").alias("pump_on_rows"),
        round_d(F.avg(on) * F.lit(100.0), 6).alias("pump_on_percent"))


def day_average(hourly: DataFrame, keys=("date",)) -> DataFrame:
    """Mean of the already-rounded hourly probabilities; ``avg_raw`` feeds
    thresholds, ``avg_probability`` (1 decimal) is what gets stored."""
    from hydrospark.plans.forecast import mean_of_tenths
    return hourly.groupBy(*keys).agg(mean_of_tenths(F.col("probability")).alias("avg_raw")) \
        .withColumn("avg_probability", round_d(F.col("avg_raw"), 1))


def confusion_matrix(scored: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     keys=()) -> DataFrame:
    """All four cells (zero-filled) of the binary confusion matrix."""
    agg = scored.groupBy(*keys).agg(
        F.count_if((F.col(actual) == 1) & (F.col(predicted) == 1)).alias("tp"),
        F.count_if((F.col(actual) == 0) & (F.col(predicted) == 1)).alias("fp"),
        F.count_if((F.col(actual) == 1) & (F.col(predicted) == 0)).alias("fn"),
        F.count_if((F.col(actual) == 0) & (F.col(predicted) == 0)).alias("tn"))
    cells = F.inline(F.array(
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n"))))
    return agg.select(*keys, cells)


def binary_metrics(scored: DataFrame, actual: str = "actual", predicted: str = "predicted",
                   keys=()) -> DataFrame:
    """Accuracy, precision, recall, F1 in percent; zero division -> 0."""
    a, p = F.col(actual), F.col(predicted)
    agg = scored.groupBy(*keys).agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"), F.count_if((a == 0) & (p == 0)).alias("tn"))
    return metrics_from_counts(agg, keys)


def metrics_from_counts(counts: DataFrame, keys=()) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    hundred = F.lit(100.0)
    div = lambda x, y: F.coalesce(F.try_divide(x, F.nullif(y, F.lit(0.0))), F.lit(0.0))
    precision = div(tp, tp + fp)
    recall = div(tp, tp + fn)
    f1 = div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)
    return counts.select(*keys, (div(tp + tn, tp + tn + fp + fn) * hundred).alias("accuracy_pct"),
                         (precision * hundred).alias("precision_pct"), (recall * hundred).alias("recall_pct"),
                         (f1 * hundred).alias("f1_pct"))


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                       keys=(), clip: bool = True, also: tuple[Column, ...] = ()) -> DataFrame:
    """A10: mean squared error and R^2 (1 - SSE/SST; with an SST of 0, 1 if
    all predictions are right and else 0), predictions
    clipped to [0, 1] when ``clip``. ``also`` names further aggregates of the same
    pass."""
    pred = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prediction))) if clip else F.col(prediction)
    y = F.col(label).cast("double")
    agg = scored.groupBy(*keys).agg(
        F.avg((y - pred) * (y - pred)).alias("mse"),
        F.sum((y - pred) * (y - pred)).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"), *also)
    r2 = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst")).when(
        F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    known = {*keys, "mse", "_sse", "_sst"}
    return agg.select(*keys, "mse", r2.alias("r2"), *[c for c in agg.columns if c not in known])


def class_balance(labelled: DataFrame, label: str = "label") -> DataFrame:
    """``class_weight='balanced'``: weight = n / (n_classes * n_class)."""
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(tot)).select(  # tot is one row
        label, "n_class", (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))


def plant_health_metrics(readings: DataFrame, sessions: DataFrame, as_of: Column, days: int = 7,
                         ) -> DataFrame:
    """Per (device, plant) over the window: average soil number,
    population std (0 with <= 1 row), sessions, sessions per day, mean event
    duration (0 without events), total ON seconds and the device's latest
    temperature and humidity. ``sessions`` must come from the same window."""
    from hydrospark.operators.sequences import plant_rows
    p = plant_rows(readings).withColumn("soil_value", soil_value("soil"))
    dur = F.coalesce(F.col("pump_duration"), F.lit(0))
    # Soil numbers are whole, so these sums and the deviation do not depend on
    # the order of rows; a stability of exactly 150 stays at the threshold.
    n, v = F.count(F.lit(1)).cast("double"), F.col("soil_value").cast("double")
    soil = p.groupBy("device_id", "plant").agg(
        F.avg("soil_value").alias("avg_soil"),
        (F.sqrt(n * F.sum(v * v) - F.sum(v) * F.sum(v)) / n).alias("soil_stability"),
        F.sum(F.when((F.col("pump") == "ON") & (dur > 0), dur).otherwise(0)).cast("long").alias("total_water_time"),
        F.max_by(F.struct("temperature", "humidity"), F.struct("ts", "reading_id")).alias("_latest"))
    ev = sessions.groupBy("device_id", "plant").agg(
        F.count(F.lit(1)).alias("events"), F.avg("duration").alias("avg_duration"))
    out = soil.join(ev, ["device_id", "plant"], "left")
    return out.select(
        "device_id", "plant", "avg_soil", "soil_stability",
        F.coalesce("events", F.lit(0)).cast("long").alias("watering_events"),
        (F.coalesce("events", F.lit(0)) / F.lit(float(days))).alias("frequency"),
        F.coalesce("avg_duration", F.lit(0.0)).cast("double").alias("avg_duration"),
        "total_water_time",
        F.col("_latest.temperature").alias("latest_temperature"),
        F.col("_latest.humidity").alias("latest_humidity"))
