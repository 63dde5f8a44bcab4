"""The bucketed halo/carry core against plain pandas on the whole history.

Buckets are one minute wide and rows are sparse, so most lags, rolling
frames and running values have to cross several bucket boundaries; one
device holds most of the rows (a hot key)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from hydrospark.operators.ordered import BKT, Order, drop_halo, prefix, with_halo

ORDER = Order(keys=("device_id",), order=("ts", "reading_id"), unit="minute")


def _frame(spark, n=400, seed=7):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    data, t = [], t0
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([1, 5, 30, 90, 400]))
        dev = 1 if rnd.random() < 0.7 else rnd.randint(2, 5)  # device 1 is hot
        val = None if rnd.random() < 0.1 else round(rnd.uniform(0, 50), 2)
        data.append((i, dev, t, val, rnd.choice(["ON", "OFF"])))
    pdf = pd.DataFrame(data, columns=["reading_id", "device_id", "ts", "v", "pump"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")) \
        .withColumn("v", F.when(~F.isnan("v"), F.col("v")))  # pandas NaN -> SQL null
    return df, pdf.sort_values(["device_id", "ts", "reading_id"]).reset_index(drop=True)


def test_halo_lags_and_rolling_match_pandas(spark):
    df, pdf = _frame(spark)
    h = with_halo(df, 5, ORDER)
    w = ORDER.window()
    out = h.select("*", F.lag("v", 1).over(w).alias("lag1"), F.lag("v", 5).over(w).alias("lag5"),
                   F.avg("v").over(w.rowsBetween(-3, 0)).alias("ma4"),
                   F.count("v").over(w.rowsBetween(-3, 0)).alias("n4"))
    got = drop_halo(out).drop(BKT).toPandas().sort_values(["device_id", "ts", "reading_id"]).reset_index(drop=True)
    g = pdf.groupby("device_id")["v"]
    exp_lag1 = g.shift(1)
    exp_lag5 = g.shift(5)
    exp_ma4 = g.transform(lambda s: s.rolling(4, min_periods=1).mean())
    exp_n4 = g.transform(lambda s: s.rolling(4, min_periods=1).count())
    assert len(got) == len(pdf)
    pd.testing.assert_series_equal(got["lag1"], exp_lag1, check_names=False)
    pd.testing.assert_series_equal(got["lag5"], exp_lag5, check_names=False)
    pd.testing.assert_series_equal(got["ma4"].round(9), exp_ma4.round(9), check_names=False)
    assert (got["n4"].astype(int) == exp_n4.astype(int)).all()


def test_prefix_sums_and_last_values_match_pandas(spark):
    df, pdf = _frame(spark)
    out = prefix(df, ORDER, sums={"c_on": (F.col("pump") == "ON").cast("long")},
                 lasts={"last_v": F.col("v")}, inclusive=True)
    out_x = prefix(df, ORDER, sums={"c_on": (F.col("pump") == "ON").cast("long")},
                   lasts={"last_v": F.col("v")}, inclusive=False)
    got = out.toPandas().sort_values(["device_id", "ts", "reading_id"]).reset_index(drop=True)
    got_x = out_x.toPandas().sort_values(["device_id", "ts", "reading_id"]).reset_index(drop=True)
    on = (pdf["pump"] == "ON").astype(int)
    exp_c = on.groupby(pdf["device_id"]).cumsum()
    exp_last = pdf.groupby("device_id")["v"].ffill()
    assert (got["c_on"].to_numpy() == exp_c.to_numpy()).all()
    assert (got_x["c_on"].to_numpy() == (exp_c - on).to_numpy()).all()
    pd.testing.assert_series_equal(got["last_v"], exp_last, check_names=False)
    exp_last_x = pdf.groupby("device_id")["v"].transform(lambda s: s.ffill().shift(1))
    pd.testing.assert_series_equal(got_x["last_v"], exp_last_x, check_names=False)


def test_halo_keeps_window_partitions_bucketed(spark):
    df, _ = _frame(spark, n=50)
    plan = with_halo(df, 2, ORDER).select(F.lag("v", 1).over(ORDER.window())) \
        ._jdf.queryExecution().executedPlan().toString()
    # the window is partitioned by (device_id, bucket), never by device alone
    assert "_bkt" in plan


def test_auto_unit_splits_a_hot_device(spark):
    from hydrospark.operators.ordered import resolve_unit
    df, pdf = _frame(spark)
    # device 1 holds ~70% of the rows; a tiny row target forces fine buckets
    assert resolve_unit(df, Order(keys=("device_id",), unit="auto", target_rows=10_000)) == "day"
    assert resolve_unit(df, Order(keys=("device_id",), unit="auto", target_rows=3)) in ("minute", "second")
    auto = Order(keys=("device_id",), order=("ts", "reading_id"), unit="auto", target_rows=3)
    out = prefix(df, auto, sums={"c": F.lit(1).cast("long")})
    got = out.toPandas().sort_values(["device_id", "ts", "reading_id"]).reset_index(drop=True)
    exp = pdf.groupby("device_id").cumcount() + 1
    assert (got["c"].to_numpy() == exp.to_numpy()).all()
    h = with_halo(df, 3, auto)
    lag = drop_halo(h.select("*", F.lag("v", 3).over(auto.window()).alias("lag3"))).drop(BKT)
    got = lag.toPandas().sort_values(["device_id", "ts", "reading_id"]).reset_index(drop=True)
    pd.testing.assert_series_equal(got["lag3"], pdf.groupby("device_id")["v"].shift(3), check_names=False)


def _events(spark, n=500, seed=3):
    """Readings (samples) and commands of two devices over many hours, with
    empty buckets, repeated times and unknown pump states."""
    rnd = random.Random(seed)
    t, samples, commands = dt.datetime(2024, 1, 1), [], []
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([0, 60, 600, 1800, 9000]))
        dev = 1 if rnd.random() < 0.7 else 2
        if rnd.random() < 0.6:
            samples.append((i, dev, t, 20.0, 50.0, rnd.random() < 0.5, rnd.random() < 0.5, rnd.choice([100, 400])))
        else:
            commands.append((i, dev, t, rnd.choice(["pump1", "pump2"]), rnd.choice(["ON", "OFF", "TOGGLE", "TOGGLE"])))
    s = spark.createDataFrame(samples, "reading_id long, device_id long, ts timestamp_ntz, temperature double, "
                                       "humidity double, soil1_dry boolean, soil2_dry boolean, water_raw int")
    c = spark.createDataFrame(commands, "command_id long, device_id long, ts timestamp_ntz, pump string, action string")
    return s, c, samples, commands


def test_auto_pump_decision_matches_a_sequential_fold(spark):
    from hydrospark.operators.sequences import auto_pump_decision
    s, c, samples, commands = _events(spark)
    got = {(r["device_id"], r["reading_id"]): (r["manual_override"], r["pump1"], r["pump2"])
           for r in auto_pump_decision(s, c).collect()}
    exp, state = {}, {}
    stream = sorted([(r[1], r[2], 0, r[0], r) for r in samples] + [(r[1], r[2], 1, r[0], r) for r in commands])
    for dev, _, src, i, r in stream:
        pumps, last = state.get(dev, (["OFF", "OFF"], 0))
        if src == 1:
            k = 0 if r[3] == "pump1" else 1
            pumps[k] = r[4] if r[4] != "TOGGLE" else ("OFF" if pumps[k] == "ON" else "ON")
        else:
            if last == 0:
                pumps = ["ON" if dry and r[7] >= 250 else "OFF" for dry in r[5:7]]
            exp[(dev, i)] = (last == 1, *pumps)
        state[dev] = (pumps, src)
    assert got == exp


def test_pump_runs_match_a_sequential_fold(spark):
    from hydrospark.operators.sequences import pump_runs
    rnd = random.Random(11)
    t, rows = dt.datetime(2024, 1, 1), []
    for i in range(500):
        t += dt.timedelta(seconds=rnd.choice([0, 60, 900, 5000, 9000]))
        rows.append((i, 1 if rnd.random() < 0.7 else 2, t, rnd.choice(["ON", "ON", "OFF", None])))
    df = spark.createDataFrame(rows, "reading_id long, device_id long, ts timestamp_ntz, pump1 string").selectExpr(
        "*", "pump1 AS pump2", "1 AS pump1_duration", "1 AS pump2_duration", "'DRY' AS soil1", "'DRY' AS soil2",
        "20.0D AS temperature", "50.0D AS humidity", "'AVAILABLE' AS water", "0 AS manual_override")
    got = {r["reading_id"]: (bool(r["run_start"]), r["run_start_ts"]) for r in pump_runs(df).filter("plant = 1").collect()}
    exp, state = {}, {}
    for i, dev, ts, pump in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        prev, start = state.get(dev, (None, None))
        begins = pump == "ON" and prev != "ON"
        start = ts if begins else start
        exp[i] = (begins, start if pump == "ON" else None)
        state[dev] = (pump or prev, start)
    assert got == exp


def test_halo_copies_stay_few_on_sparse_rows(spark):
    df, pdf = _frame(spark)
    assert with_halo(df, 24, Order(keys=("device_id",), unit="second")).count() < 2 * len(pdf)
