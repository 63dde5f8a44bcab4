"""The seven-day watering forecast, per device.

The grid (device x day x configured hour) is generated with ``explode`` per
device, scored in one ``transform`` / join, and folded back to one row per
(device, day); the only collected lists are the hours of one day (at most 24
entries), so no group grows with the data.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.columns import any_pump_on, round_d
from hydrospark.operators.latest import best_hour
from hydrospark.operators.stats import recent_averages
from hydrospark.schemas import DEFAULT_PREDICTION_HOURS, RECENT_DEFAULTS

log = logging.getLogger(__name__)


def prediction_hours(setting: Column) -> Column:
    """Comma text -> hours; parts that are not digits are dropped; missing or
    empty setting -> 6,9,12,15,18,21."""
    parts = F.filter(F.split(setting, ","), lambda x: F.trim(x).rlike("^[0-9]+$"))
    parsed = F.transform(parts, lambda x: F.trim(x).cast("int"))
    default = F.array(*[F.lit(h) for h in DEFAULT_PREDICTION_HOURS])
    return F.when(setting.isNull() | (setting == ""), default).otherwise(parsed)


def forecast_grid(devices: DataFrame, as_of: Column, hours_setting: Column | None = None,
                  days: int = 7) -> DataFrame:
    """Device x day offset 0..days-1 x hour (with its list position)."""
    hours = prediction_hours(hours_setting if hours_setting is not None else F.lit(None).cast("string"))
    g = devices.select("device_id").withColumn("day_offset", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    g = g.withColumn("date", F.date_add(F.to_date(as_of), F.col("day_offset")))
    return g.select("*", F.posexplode(hours).alias("hour_pos", "hour"))


def forecast_inputs(readings: DataFrame, as_of: Column) -> DataFrame:
    """Per device: A3 recent averages (defaults where missing) and T3 latest water."""
    # One pass lists every device and its newest non-null water state (T3):
    # max_by ignores rows whose ordering key is null.
    water = readings.groupBy("device_id").agg(F.max_by(
        "water", F.when(F.col("water").isNotNull(), F.struct("ts", "reading_id"))).alias("_w")) \
        .select("device_id", F.when(F.col("_w") == "AVAILABLE", 1).otherwise(0).alias("water_available"))
    recent = recent_averages(readings, as_of)
    j = water.join(recent, "device_id", "left")
    t = F.coalesce("avg_temperature", F.lit(RECENT_DEFAULTS["avg_temperature"]))
    h = F.coalesce("avg_humidity", F.lit(RECENT_DEFAULTS["avg_humidity"]))
    s = F.coalesce("avg_soil_dry", F.lit((RECENT_DEFAULTS["soil1_dry_ratio"] + RECENT_DEFAULTS["soil2_dry_ratio"]) / 2))
    return j.select("device_id", t.alias("avg_temperature"), h.alias("avg_humidity"), s.alias("avg_soil_dry"),
                    F.coalesce("water_available", F.lit(0)).alias("water_available"))


def forecast_features(grid: DataFrame, inputs: DataFrame, feature_names: list[str]) -> DataFrame:
    """The model's features for each grid cell, by name: recent averages
    stand in for every temperature/humidity/soil value (including all lag and
    rolling columns), time features come from the target hour and date
    (weekday Monday = 0), ``water_available`` from the latest reading,
    unknown names -> 0."""
    g = grid.join(inputs, "device_id")
    hour, dow, month = F.col("hour"), F.weekday("date"), F.month("date")
    t, h, s = F.col("avg_temperature"), F.col("avg_humidity"), F.col("avg_soil_dry")
    two_pi = F.lit(2.0 * 3.141592653589793)
    fixed = {
        "temperature": t, "humidity": h, "soil_dry": s,
        "hour_sin": F.sin(two_pi * hour / F.lit(24.0)), "hour_cos": F.cos(two_pi * hour / F.lit(24.0)),
        "day_sin": F.sin(two_pi * dow / F.lit(7.0)), "day_cos": F.cos(two_pi * dow / F.lit(7.0)),
        "month_sin": F.sin(two_pi * month / F.lit(12.0)), "month_cos": F.cos(two_pi * month / F.lit(12.0)),
        "water_available": F.col("water_available").cast("double"),
    }

    def value(name: str) -> Column:
        if name in fixed:
            return fixed[name]
        if "lag" in name or "ma" in name:
            if "temp" in name:
                return t
            if "humidity" in name:
                return h
            if "soil" in name:
                return s
            return F.lit(0.0)
        if "interaction" in name and "temp_humidity" in name:
            return t * h / F.lit(100.0)
        return F.lit(0.0)

    return g.select(*grid.columns, *[value(n).cast("double").alias(n) for n in feature_names])


def score_hours(scored: DataFrame) -> DataFrame:
    """M15 + M16: P(ON) x 100 x max(0.6, 1 - 0.03 day), clamped to 0..100;
    confidence and recommendation from the unrounded value; probability
    stored with 1 decimal. A cell that could not be scored (null ``p_on``)
    gets 50.0, not recommended, low, whatever the day."""
    factor = F.greatest(F.lit(0.6), F.lit(1.0) - F.col("day_offset") * F.lit(0.03))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("p_on") * F.lit(100.0) * factor))
    raw = F.when(F.col("p_on").isNull(), F.lit(50.0)).otherwise(raw)
    return scored.withColumn("prob_raw", raw).select(
        "*", round_d(F.col("prob_raw"), 1).alias("probability"), (F.col("prob_raw") > 60).alias("recommended"),
        F.when(F.col("prob_raw") > 80, "high").when(F.col("prob_raw") > 60, "medium").otherwise("low")
        .alias("confidence"),
        round_d(factor, 2).alias("weather_factor"))


def _pct0(x: Column) -> Column:
    """Python ``f"{x:.0f}"``: ties to even on the binary value."""
    return F.format_string("%.0f", F.bround(x, 0))


def day_recommendations(avg_raw: Column, best: Column) -> Column:
    """High (> 75) / Moderate (> 50) / Low advice lines."""
    return (F.when(avg_raw > 75, F.array(F.concat(F.lit("High watering probability ("), _pct0(avg_raw), F.lit("%)")),
                                         F.concat(F.lit("Best time: "), best.cast("string"), F.lit(":00")),
                                         F.lit("Consider watering today")))
            .when(avg_raw > 50, F.array(F.concat(F.lit("Moderate watering probability ("), _pct0(avg_raw), F.lit("%)")),
                                        F.lit("Check soil moisture before watering"),
                                        F.lit("Water in early morning or evening")))
            .otherwise(F.array(F.concat(F.lit("Low watering probability ("), _pct0(avg_raw), F.lit("%)")),
                               F.lit("No watering needed today"))))


def mean_of_tenths(c: Column) -> Column:
    """Mean of values that carry one decimal, computed exactly (integer sum
    of tenths, one division) so the result does not depend on summation
    order; ties of the later rounding are then decided the same way
    everywhere."""
    return F.sum(F.round(c * F.lit(10.0)).cast("long")).cast("double") / (F.lit(10.0) * F.count(c))


def assemble_forecast(hours: DataFrame) -> DataFrame:
    """A7 + T10 + M17 + M18: one row per (device, day) with the hourly list in
    configured order, the mean of the rounded hourly values (1 decimal),
    recommendations and the weather factor."""
    per_day = hours.groupBy("device_id", "day_offset", "date").agg(
        F.array_sort(F.collect_list(F.struct("hour_pos", "hour", "probability", "recommended", "confidence")))
        .alias("_h"),
        mean_of_tenths(F.col("probability")).alias("avg_raw"),
        F.first("weather_factor").alias("weather_factor"))
    hourly = F.transform("_h", lambda e: F.struct(e["hour"].alias("hour"), e["probability"].alias("probability"),
                                                  e["recommended"].alias("recommended"),
                                                  e["confidence"].alias("confidence")))
    return per_day.select(
        "device_id", "day_offset", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.date_format("date", "EEEE").alias("day_name"), round_d(F.col("avg_raw"), 1).alias("avg_probability"),
        hourly.alias("predictions"), day_recommendations(F.col("avg_raw"), best_hour(hourly)).alias("recommendations"),
        "weather_factor")


def forecast(readings: DataFrame, as_of: Column, scorer: Callable[[DataFrame], DataFrame],
             feature_names: list[str], hours_setting: Column | None = None, days: int = 7,
             settings: DataFrame | None = None) -> DataFrame:
    """M18 end to end. ``scorer`` adds ``p_on`` to the feature grid (a fitted
    model's ``transform`` or any other estimate). With ``settings`` whose
    ``prediction_enabled`` is ``0`` the forecast is empty and the reason is
    logged."""
    if settings is not None and not prediction_enabled(settings):
        log.warning("predictions are disabled in the settings: the forecast is empty")
        readings = readings.limit(0)
    inputs = forecast_inputs(readings, as_of)
    grid = forecast_grid(inputs.select("device_id"), as_of, hours_setting, days)
    hours = score_hours(scorer(forecast_features(grid, inputs, feature_names)))
    out = assemble_forecast(hours)
    if hours_setting is not None:
        # An hour list that parses to nothing still yields one row per day.
        empty = forecast_grid(inputs.select("device_id"), as_of, F.lit("6"), days) \
            .select("device_id", "day_offset", "date").filter(F.size(prediction_hours(hours_setting)) == 0)
        out = out.unionByName(empty.select(
            "device_id", "day_offset", F.date_format("date", "yyyy-MM-dd").alias("date"),
            F.date_format("date", "EEEE").alias("day_name"), F.lit(50.0).alias("avg_probability"),
            F.array().cast("array<struct<hour:int,probability:double,recommended:boolean,confidence:string>>")
            .alias("predictions"),
            F.array(F.lit("Unable to generate predictions")).alias("recommendations"),
            round_d(F.greatest(F.lit(0.6), F.lit(1.0) - F.col("day_offset") * F.lit(0.03)), 2).alias("weather_factor")))
    return out


def prediction_enabled(settings: DataFrame) -> bool:
    """False only if the fleet-wide setting says ``0``; a missing one is on."""
    if "device_id" in settings.columns:
        settings = settings.where("device_id is null")
    off = settings.where((F.col("key") == "prediction_enabled") & (F.col("value") == "0"))
    return off.isEmpty()  # one row per key


def hourly_frequency_scorer(readings: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A data-derived P(ON): share of the device's readings at that hour of
    day with a pump on (device-wide share if the hour was never seen, 0.5 for
    an unseen device). Usable where no trained model is wanted."""
    r = readings.select("device_id", F.hour("ts").alias("hour"), any_pump_on().alias("on"))
    by_hour = r.groupBy("device_id", "hour").agg(F.avg("on").alias("_p_hour"))
    overall = r.groupBy("device_id").agg(F.avg("on").alias("_p_dev"))

    def scorer(grid: DataFrame) -> DataFrame:
        j = grid.join(by_hour, ["device_id", "hour"], "left").join(overall, "device_id", "left")
        return j.withColumn("p_on", F.coalesce("_p_hour", "_p_dev", F.lit(0.5))).drop("_p_hour", "_p_dev")
    return scorer


def model_scorer(model, stats: DataFrame, feature_names: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Score the grid with a fitted pipeline after the training-time scaling."""
    from hydrospark.operators.features import standardize
    from hydrospark.plans.training import score

    def scorer(grid: DataFrame) -> DataFrame:
        return score(model, standardize(grid, stats, feature_names)).drop("predicted")
    return scorer


# M19 / K3-K6 ----------------------------------------------------------------------

def forecast_summary(fc: DataFrame) -> DataFrame:
    """Per device, number of days, the dates in order and the first day's average."""
    return fc.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.array_sort(F.collect_list("date")).alias("prediction_days"),  # one entry per forecast day
        F.min_by("avg_probability", "day_offset").alias("first_day_avg"))


def _hour_rows(fc: DataFrame) -> DataFrame:
    return fc.select("device_id", "date", "day_name", "avg_probability", "recommendations",
                     F.posexplode("predictions").alias("hour_pos", "h"))


def export_forecast_csv(fc: DataFrame, generated_at: Column) -> DataFrame:
    """K3: one row per day x hour with the display columns of the export."""
    r = _hour_rows(fc)
    return r.select(
        "device_id", F.col("date").alias("Date"), F.col("day_name").alias("Day"),
        F.concat(F.col("h.hour").cast("string"), F.lit(":00")).alias("Hour"),
        F.col("h.probability").alias("Probability (%)"),
        F.when(F.col("h.recommended"), "Yes").otherwise("No").alias("Recommended"),
        F.col("h.confidence").alias("Confidence"), F.col("avg_probability").alias("Day Average (%)"),
        F.array_join("recommendations", " | ").alias("Recommendations"),
        F.date_format(generated_at, "yyyy-MM-dd HH:mm:ss").alias("Generated At"))


def forecast_csv_plain(fc: DataFrame) -> DataFrame:
    """K4: the same grain with plain column names and integer hours."""
    r = _hour_rows(fc)
    return r.select(
        "device_id", F.col("date").alias("Date"), F.col("day_name").alias("Day"), F.col("h.hour").alias("Hour"),
        F.col("h.probability").alias("Hour_Probability"),
        F.when(F.col("h.recommended"), "Yes").otherwise("No").alias("Recommended"),
        F.col("h.confidence").alias("Confidence"), F.col("avg_probability").alias("Day_Avg_Probability"),
        F.array_join("recommendations", " | ").alias("Recommendations"))


def hourly_json(hourly: Column) -> Column:
    """The hourly list as ``json.dumps`` writes it (", " and ": " separators)."""
    items = F.transform(hourly, lambda e: F.concat(
        F.lit('{"hour": '), e["hour"].cast("string"), F.lit(', "probability": '), e["probability"].cast("string"),
        F.lit(', "recommended": '), F.when(e["recommended"], "true").otherwise("false"),
        F.lit(', "confidence": "'), e["confidence"], F.lit('"}')))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def save_forecast(fc: DataFrame, saved_at: Column) -> DataFrame:
    """K5: prediction rows as stored: hourly list as JSON text,
    recommendations joined with " | "."""
    return fc.select("device_id", saved_at.alias("ts"), F.col("date").alias("prediction_date"), "day_name",
                     "avg_probability", hourly_json(F.col("predictions")).alias("predictions_json"),
                     F.array_join("recommendations", " | ").alias("recommendations"))
