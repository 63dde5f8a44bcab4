"""Trees, their split points and their tops come from every training row."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators import forest as FO
from hydrospark.operators import split_points as SP
from hydrospark.plans import training as TR


def _features(spark, n):
    t0 = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    return spark.range(n).select(
        F.col("id").alias("reading_id"), (F.col("id") % 3).alias("device_id"),
        (t0 + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("ts"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(97)) / 97.0).alias("b")
    ).withColumn("target", F.when((F.col("a") > 0.98) != (F.col("b") > 0.99), 1).otherwise(0))


@pytest.fixture
def fitted_rows(monkeypatch):
    """How many rows each tree learner is given, in turn."""
    seen, fit, forest = [], TR.Pipeline.fit, TR.fit_forest
    monkeypatch.setattr(TR.Pipeline, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    monkeypatch.setattr(TR, "fit_forest", lambda df, *a: seen.append(df.count()) or forest(df, *a))
    return seen


def test_ensemble_is_fitted_on_all_training_rows(spark, fitted_rows):
    metrics, _ = TR.train_regressor_ensemble(_features(spark, 270_000), ["a", "b"], trees=1, max_depth=2)
    assert fitted_rows == [216_000, 216_000] and metrics.count() == 3


def test_pump_classifier_is_fitted_on_all_training_rows(spark, fitted_rows):
    f = _features(spark, 270_000)
    t = TR.train_pump_classifier(f, ["a", "b"], num_trees=1, max_depth=2)
    assert fitted_rows == [216_000] and t.metrics.first()["samples_used"] == 270_000
    # MLlib's thresholds lie between the bins, all of which come from all rows.
    assert [len(e) for e in t.model.stages[0].getSplitsArray()] == [33, 33]
    assert t.model.stages[-1].trees[0].numNodes >= 3
    scored = TR.score(t.model, TR.standardize(f, t.stats, ["a", "b"]))
    assert scored.columns == [*f.columns, "p_on", "predicted"]


def test_table_split_points_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(SP, "_BLOCK_ROWS", 7_000)
    rng = np.random.default_rng(5)
    n = 25_000
    cols = {"few": rng.integers(-3, 9, n) / 4, "many": rng.normal(0, 3, n), "heavy": np.where(rng.random(n) < 0.9, 7.0, rng.random(n)),
            "wide": rng.choice([-1e300, -1e-300, 0.0, 5e-324, 1e12], n) * rng.random(n), "same": np.full(n, 2.5),
            "rare": (np.arange(n) == 20_111) * 1.0}
    rows = [[float(v) for v in r] for r in zip(*cols.values())]
    rows[3][1] = None
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).withColumn("void", F.lit(None).cast("double"))
    got = SP.table_split_points(df.repartition(5), df.columns)
    cols["many"][3] = np.nan
    for c, points in zip(df.columns, got):
        want = SP.split_points(cols[c]) if c in cols else np.array([])
        assert points.tolist() == want.tolist(), c
    for c, points in zip(df.columns, SP.table_split_points(df, df.columns, nearest=True)):
        found, m = np.unique(cols.get(c, np.array([])), return_counts=True)
        found, m = found[~np.isnan(found)], m[~np.isnan(found)]
        mid, upto = (found[:-1] + found[1:]) / 2, np.cumsum(m)[:-1]
        # Of two as near the upper one.
        near = [len(mid) - 1 - np.abs(upto - m.sum() * i / 32)[::-1].argmin() for i in range(1, 32)] if len(found) > 32 else range(len(mid))
        assert points.tolist() == sorted(set(mid[list(near)])), c
    assert SP.table_split_points(df.where("false"), ["few"])[0].tolist() == []


def test_weights_are_hashes_of_row_and_tree(spark):
    df = spark.range(400).select(F.xxhash64("id").alias("row"))
    hashed = [r[0] for r in df.select(F.xxhash64("row", F.lit(11), F.lit(42))).collect()]
    draw = np.array([h % 2 ** 52 for h in hashed]) / 2.0 ** 52
    want = [int(sum(d >= p for p in FO._POISSON)) for d in draw]
    assert FO._weights(np.array([r[0] for r in df.collect()]), 11, 42).tolist() == want and max(want) > 2


def _predicted(forest, f):
    return [r[0] for r in forest.transform(f).orderBy("reading_id").select("prediction").collect()]


def test_tops_split_over_the_table_are_the_tree_one_task_grows(spark, monkeypatch):
    # With one feature nothing is drawn but the rows, so both ways must give the same tree.
    f = _features(spark, 3000)
    f = f.withColumn("target", (F.pmod(F.xxhash64("reading_id", F.lit(3)), F.lit(10)) / 10.0 < F.col("a")).cast("int"))
    one = FO.fit_forest(f, ["a"], "target", 3)
    monkeypatch.setattr(FO, "_LOCAL_ROWS", 100)
    monkeypatch.setattr(FO, "_BLOCK_ROWS", 400)
    monkeypatch.setattr(FO, "_GROUP_DRAWS", 6000)
    monkeypatch.setattr(FO, "_BUCKET_ROWS", 50)
    many = FO.fit_forest(f.repartition(5), ["a"], "target", 3)
    assert all(len(t[0]) == 1 for t in one.tops.values()) and all(len(t[0]) > 30 for t in many.tops.values())
    assert _predicted(many, f) == pytest.approx(_predicted(one, f), rel=1e-12)
    # More features: the same forest however rows are dealt, as deep as asked for.
    two, again = (FO.fit_forest(f.repartition(p), ["a", "b"], "target", 4, 3) for p in (2, 7))
    assert _predicted(two, f) == pytest.approx(_predicted(again, f), rel=1e-12)
    assert two.importances == pytest.approx(again.importances) and sum(two.importances) == pytest.approx(1.0)
    assert len(set(_predicted(FO.fit_forest(f, ["a"], "target", 1, 2), f))) <= 4


def test_top_nodes_that_cannot_be_split(spark, monkeypatch):
    monkeypatch.setattr(FO, "_LOCAL_ROWS", 50)
    f = _features(spark, 600)
    whole = FO.fit_forest(f.withColumn("a", F.lit(1.0)), ["a"], "target", 2)
    assert all(len(t[0]) == 1 for t in whole.tops.values())
    pure = FO.fit_forest(f.withColumn("target", F.lit(1)), ["a", "b"], "target", 2)
    assert set(_predicted(pure, f)) == {1.0}
    # A row so few that some trees draw none.
    few = FO.fit_forest(f.limit(1).withColumn("target", F.lit(1)), ["a", "b"], "target", 12)
    assert 0 < len(few.tops) < 12 and set(_predicted(few, f)) == {1.0}
