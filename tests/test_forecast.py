"""Forecast branches, dashboard extras and status defaults."""

from pyspark.sql import functions as F

from hydrospark.operators import latest
from hydrospark.operators.features import SCHEDULE_FEATURES
from hydrospark.operators.alerts import settings_table
from hydrospark.plans import forecast as FC
from hydrospark.plans.training import model_status
from hydrospark.plans.dashboard import dashboard
from hydrospark.sources import testdata as td, weather

SF = "/root/testdata/sf0.001"


def test_prediction_hours_parsing(spark):
    df = spark.createDataFrame([("6, 9,x,21",), ("",), (None,), ("a,b",)], "s string")
    got = [r["h"] for r in df.select(FC.prediction_hours(F.col("s")).alias("h")).collect()]
    assert got == [[6, 9, 21], [6, 9, 12, 15, 18, 21], [6, 9, 12, 15, 18, 21], []]


def test_forecast_without_hours_falls_back(spark):
    r = td.readings(spark, SF)
    fc = FC.forecast(r, td.as_of_lit(), FC.hourly_frequency_scorer(r), SCHEDULE_FEATURES,
                     hours_setting=F.lit("a,b"))
    rows = fc.collect()
    n_dev = r.select("device_id").distinct().count()
    assert len(rows) == 7 * n_dev
    assert all(x["avg_probability"] == 50.0 and x["predictions"] == [] and
               x["recommendations"] == ["Unable to generate predictions"] for x in rows)
    assert sorted({x["weather_factor"] for x in rows}) == [0.82, 0.85, 0.88, 0.91, 0.94, 0.97, 1.0]


def test_forecast_invariants(spark):
    r = td.readings(spark, SF)
    fc = FC.forecast(r, td.as_of_lit(), FC.hourly_frequency_scorer(r), SCHEDULE_FEATURES)
    for x in fc.collect():
        assert [h["hour"] for h in x["predictions"]] == [6, 9, 12, 15, 18, 21]
        assert all(0.0 <= h["probability"] <= 100.0 for h in x["predictions"])
        assert x["day_name"] in {"Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"}
        first = x["recommendations"][0]
        assert first.split(" ")[0] in {"High", "Moderate", "Low"}
    s = FC.forecast_summary(fc).collect()
    assert all(x["prediction_count"] == 7 and len(x["prediction_days"]) == 7 for x in s)


def test_dashboard_with_weather_and_status_defaults(spark):
    r = td.readings(spark, SF)
    w = weather.weather_rows(weather.weather_payloads_from_events(td.load(spark, SF, "events")))
    d = dashboard(r, td.as_of_lit(), weather=w)
    row = d.first()
    assert row["weather"] is not None and isinstance(row["weather"]["rain_forecast"], bool)
    assert d.count() == r.select("device_id").distinct().count()
    devices = spark.createDataFrame([(10**9,)], "device_id long").unionByName(r.select("device_id").distinct())
    st = {x["device_id"]: x for x in latest.pump_status(r, devices).collect()}
    ghost = st[10**9]
    assert (ghost["pump1_state"], ghost["pump2_state"], ghost["manual_override"], ghost["auto_mode"]) == \
        ("OFF", "OFF", False, True)


def test_cell_without_score(spark):
    cells = spark.createDataFrame([(6, None), (6, 0.9), (0, 0.9)], "day_offset int, p_on double")
    got = [(r["probability"], r["recommended"], r["confidence"]) for r in FC.score_hours(cells).collect()]
    assert got == [(50.0, False, "low"), (73.8, True, "medium"), (90.0, True, "high")]


def test_disabled_predictions(spark):
    r = td.readings(spark, SF)
    off = settings_table(spark, {"prediction_enabled": "0"})
    args = (r, td.as_of_lit(), FC.hourly_frequency_scorer(r), SCHEDULE_FEATURES)
    assert FC.forecast(*args, settings=off).isEmpty()
    assert not FC.forecast(*args, settings=settings_table(spark, {})).isEmpty()
    assert FC.prediction_enabled(off.where("key <> 'prediction_enabled'"))


def test_model_status_feature_count(spark):
    schema = "id long, ts timestamp_ntz, accuracy double, r2_score double, samples_used int, status string"
    log = spark.sql("SELECT 1L AS id, TIMESTAMP_NTZ'2024-01-01' AS ts, 0.9D AS accuracy, 0.5D AS r2_score, "
                    "60 AS samples_used, 'success' AS status")
    assert model_status(log, 23).first()["feature_count"] == 23
    none = model_status(spark.createDataFrame([], schema), 23).first()
    assert (none["model_exists"], none["last_trained"], none["feature_count"]) == (False, "Never", 0)
