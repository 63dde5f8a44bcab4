"""Exact selection by hash, least squares, merged session summaries, settings in time."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import alerts as AL
from hydrospark.operators import ranking as RK
from hydrospark.operators.features import split_stratified
from hydrospark.operators.regression import linear_regression
from hydrospark.operators.sequences import watering_sessions
from hydrospark.operators.sessions import plant_figures
from hydrospark.operators.stats import plant_health_metrics
from hydrospark.operators.throttle import throttle

T0 = dt.datetime(2024, 1, 1)


def _hash(i, seed):
    return int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("sizes", [{0: 700, 1: 301}, {0: 5, 1: 1}, {"a": 40, "b": 33, None: 27}, {1: 64}])
def test_split_is_exact(spark, sizes):
    ids = iter(range(10_000))
    rows = [(next(ids), c) for c, n in sizes.items() for _ in range(n)]
    kind = "string" if any(isinstance(c, str) for c in sizes) else "long"
    df = spark.createDataFrame(rows, f"reading_id long, target {kind}").repartition(5)
    out = split_stratified(df, "target").collect()
    n = len(rows)
    assert sum(r["is_test"] for r in out) == math.ceil(0.2 * n)
    for c, m in sizes.items():
        own = sorted((_hash(r["reading_id"], 42), r["is_test"]) for r in out if r["target"] == c)
        k = sum(t for _, t in own)
        assert abs(k - m * math.ceil(0.2 * n) / n) < 1
        assert [t for _, t in own] == [True] * k + [False] * (m - k)
    assert split_stratified(df.where("false"), "target").count() == 0


def test_selection_refines_down_to_single_hashes(spark):
    # Hashes that agree in all but the last bits, ties included.
    hashes = [5 << 40 | i for i in range(50)] + [5 << 40 | 60] * 4 + [1 << 59]
    df = spark.createDataFrame([("x", h) for h in hashes], "label string, h long")
    ranked = sorted(hashes)
    for k in (0, 1, 17, 50, 54, 55, 99):
        cut = RK.smallest_hashes(df, "label", "h", {"x": k})["x"]
        assert sum(h <= cut for h in hashes) == min(k, len(hashes))
        if 0 < k <= 50:
            assert max(h for h in hashes if h <= cut) == ranked[k - 1]
    cut = RK.smallest_hashes(df, "label", "h", {"x": 52})["x"]
    assert sum(h <= cut for h in hashes) == 50  # four equal ones do not fit


def test_sample_per_class(spark):
    df = spark.range(3000).select(F.col("id").alias("reading_id"), (F.col("id") % 10 == 0).cast("int").alias("target"))
    got = RK.sample_per_class(df, "target", "reading_id", 500).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in got} == {0: 500, 1: 300}


def test_least_squares(spark):
    r = random.Random(2)
    rows = [[r.gauss(0, 1) for _ in range(3)] for _ in range(400)]
    rows = [[*x, x[0] * 2 - 3, 1.5 * x[0] - 0.5 * x[1] + 2 + r.gauss(0, 0.1)] for x in rows]  # d is collinear
    df = spark.createDataFrame(rows + [[None, 1.0, 1.0, 1.0, 1.0]], "a double, b double, c double, d double, y double")
    fit = linear_regression(df, ["a", "b", "c"], "y")
    x = np.array(rows)
    want = np.linalg.lstsq(np.c_[x[:, :3], np.ones(400)], x[:, 4], rcond=None)[0]
    assert np.allclose([*fit.coefficients, fit.intercept], want, atol=1e-9)
    same = linear_regression(df, ["a", "b", "c", "d"], "y")
    pred = [p[0] for p in df.dropna().select(same.predict()).collect()]
    assert np.allclose(pred, x[:, :3] @ want[:3] + want[3], atol=1e-8)
    assert linear_regression(df.where("false"), ["a"], "y").coefficients == [0.0]


def _readings(spark, seed, n=300, minutes=60 * 30):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        soil = [r.choice(["DRY", "WET", None]) for _ in range(2)]
        pump = [r.choice(["ON", "ON", "OFF", None]) for _ in range(2)]
        rows.append((r.choice([1, 1, 1, 2, 3]), i, T0 + dt.timedelta(minutes=r.randrange(minutes)), float(r.randrange(40)),
                     float(r.randrange(100)), *soil, "AVAILABLE", *pump, r.choice([0, 30, 60, None]), r.choice([0, 45]), 0))
    return spark.createDataFrame(rows, "device_id long, reading_id long, ts timestamp_ntz, temperature double, "
                                 "humidity double, soil1 string, soil2 string, water string, pump1 string, pump2 string, "
                                 "pump1_duration int, pump2_duration int, manual_override int")


@pytest.mark.parametrize("seed, minutes", [(1, 60 * 30), (2, 60 * 300), (3, 30)])
def test_merged_summaries_equal_sessions(spark, seed, minutes):
    df = _readings(spark, seed, minutes=minutes)
    cols = ["device_id", "plant", "avg_soil", "soil_stability", "watering_events", "frequency", "avg_duration",
            "total_water_time", "latest_temperature", "latest_humidity"]
    want = plant_health_metrics(df, watering_sessions(df), F.lit(T0), 7).select(*cols).collect()
    known = spark.createDataFrame([(2,), (9,), (9,)], "device_id long")
    got = plant_figures(df.repartition(6), 7, known).select(*cols).collect()
    by = {(g["device_id"], g["plant"]): g for g in got}
    assert len(by) == len(got) == len(want) + 2
    for w in want:
        assert by[(w["device_id"], w["plant"])] == w
    assert tuple(by[(9, 1)])[2:] == (None,) * 8


def test_settings_in_time(spark):
    t = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    versions = spark.createDataFrame([
        (None, t(1, 10), "max_temperature", "20", 1), (None, t(1, 10), "max_temperature", "21", 2),
        (None, t(5, 30), "max_temperature", "25", 1), (1, t(3), "max_temperature", "30", 1), (1, t(6), "max_temperature", "x", 1),
        (2, t(2), "alert_high_temp", "0", 1), (None, t(4), "alert_high_temp", "1", 1), (None, t(2), "unknown", "7", 1)],
        "device_id long, ts timestamp_ntz, key string, value string, version int")
    rows = spark.createDataFrame([(d, t(h, m)) for d in (1, 2) for h, m in ((0, 0), (1, 9), (1, 10), (3, 0), (5, 29), (5, 30), (9, 0))],
                                 "device_id long, ts timestamp_ntz")
    got = {(r["device_id"], r["ts"]): r for r in AL.with_settings(rows, versions).collect()}
    assert len(got) == 14
    one = [got[(1, t(*x))]["max_temperature"] for x in ((0, 0), (1, 9), (1, 10), (3, 0), (5, 29), (5, 30), (9, 0))]
    assert one == [35.0, 35.0, 21.0, 30.0, 30.0, 30.0, 25.0]  # at last an unparsable own value
    two = [got[(2, t(*x))]["max_temperature"] for x in ((0, 0), (1, 10), (5, 29), (5, 30))]
    assert two == [35.0, 21.0, 21.0, 25.0]
    assert [got[(2, t(*x))]["alert_high_temp"] for x in ((1, 10), (3, 0), (9, 0))] == [None, "0", "0"]
    assert got[(1, t(9))]["alert_high_temp"] == "1"
    no_device = AL.with_settings(rows, versions.where("device_id is null").drop("device_id"))
    assert {r["max_temperature"] for r in no_device.where(F.col("ts") == F.lit(t(9))).collect()} == {25.0}


def test_cooldown_after_what_was_sent(spark):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    alerts = spark.createDataFrame([(k, i, minute(m)) for k in ("a", "b") for i, m in enumerate((0, 3, 9, 10, 14, 40))],
                                   "k string, id long, ts timestamp_ntz")
    sent = spark.createDataFrame([("a", minute(-6)), ("a", minute(-60)), ("c", minute(0))], "k string, ts timestamp_ntz")
    got = throttle(alerts, ["k"], 600, order_cols=("ts", "id"), sent=sent)
    assert got.columns == alerts.columns
    assert sorted((r["k"], r["id"]) for r in got.collect()) == [("a", 2), ("a", 5), ("b", 0), ("b", 3), ("b", 5)]
