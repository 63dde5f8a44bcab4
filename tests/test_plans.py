"""Plan shape: the properties the scale design relies on, read from the
executed physical plans."""

import re

from hydrospark.operators import alerts, features, latest, sequences as SQ
from hydrospark.plans.plant_health import plant_health_report
from hydrospark.sources import testdata as td

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # run once so AQE shows its final plan
    return df._jdf.queryExecution().executedPlan().toString()


def _windows(plan):
    """(window expressions, partition spec) of every Window operator."""
    return re.findall(r"Window \[(.*?)\], \[([^\]]*)\]", plan)


def test_trailing_window_is_pushed_to_the_scan(spark):
    plan = plant_health_report(td.readings(spark, SF), td.as_of_lit())._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan


def test_latest_is_a_partial_aggregate(spark):
    plan = _plan(latest.latest_reading(td.readings(spark, SF)))
    assert "max_by" in plan and "partial_max_by" in plan
    assert "Window" not in plan


def test_top_k_uses_group_limit(spark):
    plan = _plan(latest.history(td.readings(spark, SF), limit=5))
    assert "WindowGroupLimit" in plan


def test_ordered_windows_are_bucketed(spark):
    df = SQ.lag_features(td.readings(spark, SF), {"temp": "temperature"}, lags=(1,))
    plan = _plan(df)
    wins = _windows(plan)
    assert wins, plan
    # every window over raw rows is partitioned by (device, bucket); windows
    # partitioned by the device alone only run over the per-bucket summary
    for exprs, part in wins:
        if "_bkt" not in part:
            assert re.search(r"_cnt|_bs_|_bl_", exprs), (exprs, part)


def test_sessions_shuffle_keys_include_bucket(spark):
    plan = _plan(SQ.watering_sessions(td.readings(spark, SF)))
    assert re.search(r"hashpartitioning\(device_id#\d+L, plant#\d+, _bkt#\d+", plan)


def test_ordered_operators_read_their_input_twice_at_most(spark):
    """Once for the summaries, once for the rows; the rows are shuffled twice
    at most (buckets and halo blocks). Automatic broadcasts are off."""
    r = td.readings(spark, SF)
    cases = {
        "lag_features": (SQ.lag_features(r, {"temp": "temperature"}, lags=(1,)), 2),
        "pump_runs": (SQ.pump_starts(r), 2),
        "timeline": (SQ.pump_state_timeline(r, td.commands(spark, SF)), 4),  # readings and commands
        "alerts_all": (alerts.alerts_all(r, alerts.settings_table(spark)), 3),
        "features_schedule": (features.features_schedule(r, td.as_of_lit()), 3),
    }
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, (df, most) in cases.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet") <= most, (name, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_plant_health_report_shuffles_rows_once(spark):
    """Rows to buckets, the device list, summaries to plants; broadcasts off."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rep = plant_health_report(td.readings(spark, SF), td.as_of_lit(), known_days=30)
        plan = rep._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= 4 and plan.count("FileScan parquet") <= 2, plan
        assert plan.count("GreaterThan(ts,") == plan.count("FileScan parquet")  # no scan of all history
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_schedule_numbers_are_carried(spark):
    """No window takes a whole device: rows by (device, bucket), summaries by device."""
    from hydrospark.operators.maintenance import replace_schedule
    rows = spark.createDataFrame([(1, p, p % 24, 0, 5, None, None) for p in range(50)],
                                 "device_id long, pos long, hour int, minute int, duration int, plant string, enabled boolean")
    for df in (replace_schedule(rows), latest.schedule_ordered(replace_schedule(rows))):
        for exprs, part in _windows(_plan(df)):
            assert "_bkt" in part or "_bs_" in exprs, (exprs, part)


def test_newest_weather_is_taken_before_it_is_parsed(spark):
    from pyspark.sql import functions as F

    from hydrospark.sources.weather import newest_weather_row, weather_payloads_from_events, weather_rows
    pay = weather_payloads_from_events(td.load(spark, SF, "events"))
    want = latest.latest_weather(weather_rows(pay))
    got = newest_weather_row(pay)
    assert got.collect() == want.select(*got.columns).collect()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate", 1)
    assert "StructField(main" in above and "StructField(main" not in below
    # The newest payload without a weather entry is passed over; nothing gives nothing.
    bare = pay.orderBy(F.desc("ts"), F.desc("id")).limit(1).withColumn("current_json", F.lit('{"main":{"temp":1}}')) \
        .withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    assert newest_weather_row(pay.unionByName(bare)).collect() == got.collect()
    assert newest_weather_row(bare).collect() == [] == newest_weather_row(pay.where("false")).collect()
