"""Explicit table schemas and fixed values.

No schema inference anywhere: every reader takes one of these StructTypes.
"""

from __future__ import annotations

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("reading_id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("soil1", T.StringType()),
    T.StructField("soil2", T.StringType()),
    T.StructField("water", T.StringType()),
    T.StructField("pump1", T.StringType()),
    T.StructField("pump2", T.StringType()),
    T.StructField("pump1_duration", T.IntegerType()),
    T.StructField("pump2_duration", T.IntegerType()),
    T.StructField("manual_override", T.IntegerType()),
])

READING_COLUMNS = [f.name for f in READINGS.fields]

LEGACY_READINGS = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("soil", T.IntegerType()),
    T.StructField("water", T.StringType()),
    T.StructField("pump", T.StringType()),
    T.StructField("pump_duration", T.IntegerType()),
    T.StructField("manual_override", T.IntegerType()),
])

ALERTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("resolved", T.IntegerType()),
])

SETTINGS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

WEATHER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("rain_forecast", T.IntegerType()),
    T.StructField("weather_description", T.StringType()),
    T.StructField("location_city", T.StringType()),
    T.StructField("location_lat", T.DoubleType()),
    T.StructField("location_lon", T.DoubleType()),
])

PUMP_SCHEDULE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("minute", T.IntegerType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("plant", T.StringType()),
    T.StructField("enabled", T.IntegerType()),
])

TRAINING_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("r2_score", T.DoubleType()),
    T.StructField("mse", T.DoubleType()),
    T.StructField("samples_used", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
])

HOURLY = T.StructType([
    T.StructField("hour", T.IntegerType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("recommended", T.BooleanType()),
    T.StructField("confidence", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("prediction_date", T.StringType()),
    T.StructField("day_name", T.StringType()),
    T.StructField("avg_probability", T.DoubleType()),
    T.StructField("predictions_json", T.StringType()),
    T.StructField("recommendations", T.StringType()),
])

COMMANDS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("pump", T.StringType()),
    T.StructField("action", T.StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Payload keys a reading must carry.
REQUIRED_READING_KEYS = ["temperature", "humidity", "soil1", "soil2", "water", "pump1", "pump2"]

# Default settings (key, value). The weather service key is left blank on purpose.
DEFAULT_SETTINGS = [
    ("soil_dry_threshold1", "500"),
    ("soil_wet_threshold1", "300"),
    ("pump1_max_duration", "120"),
    ("soil_dry_threshold2", "500"),
    ("soil_wet_threshold2", "300"),
    ("pump2_max_duration", "120"),
    ("auto_mode", "1"),
    ("rain_delay", "1"),
    ("rain_threshold", "0.5"),
    ("evaporation_rate", "medium"),
    ("weather_integration", "1"),
    ("location_city", ""),
    ("weather_api_key", ""),
    ("ml_model_type", "random_forest"),
    ("auto_train_interval", "10"),
    ("min_training_samples", "50"),
    ("prediction_enabled", "1"),
    ("prediction_days", "7"),
    ("prediction_hours", "6,9,12,15,18,21"),
    ("update_interval", "5"),
    ("auto_detect_location", "1"),
    ("max_temperature", "35"),
    ("min_humidity", "30"),
    ("email_enabled", "0"),
    ("email_recipient", ""),
    ("email_cooldown_minutes", "10"),
    ("alert_no_water", "1"),
    ("alert_pump_start", "0"),
    ("alert_pump_still_dry", "0"),
    ("alert_dry_duration", "5"),
    ("alert_high_temp", "1"),
    ("alert_low_humidity", "1"),
    ("alert_soil_dry_plant1", "1"),
    ("alert_soil_dry_plant2", "1"),
    ("soil_dry_threshold", "500"),
    ("soil_wet_threshold", "300"),
    ("enable_alerts", "1"),
    ("rain_stop_threshold", "60"),
    ("weather_rain_stop_pump", "1"),
]

# Alert type -> settings key that enables it. Unmapped types are always enabled.
ALERT_ENABLE_KEYS = [
    ("no_water", "alert_no_water"),
    ("pump_start", "alert_pump_start"),
    ("pump_still_dry", "alert_pump_still_dry"),
    ("high_temp", "alert_high_temp"),
    ("low_humidity", "alert_low_humidity"),
    ("soil_dry_plant1", "alert_soil_dry_plant1"),
    ("soil_dry_plant2", "alert_soil_dry_plant2"),
]

# Soil text -> number used by thresholds and health metrics.
SOIL_DRY_VALUE = 600
SOIL_WET_VALUE = 300

# Forecast defaults.
DEFAULT_PREDICTION_HOURS = [6, 9, 12, 15, 18, 21]
RECENT_DEFAULTS = {"avg_temperature": 25.0, "avg_humidity": 60.0,
                   "soil1_dry_ratio": 0.5, "soil2_dry_ratio": 0.5}

# Export headers of the readings CSV, in column order.
READINGS_CSV_HEADERS = ["ID", "Timestamp", "Temperature (°C)", "Humidity (%)",
                        "Soil1 Status", "Soil2 Status", "Water Level",
                        "Pump1 Status", "Pump2 Status", "Pump1 Duration (s)",
                        "Pump2 Duration (s)", "Manual Override"]
