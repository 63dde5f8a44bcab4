"""The forest of the regressor ensemble and the samples trees are fitted on."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.operators.forest import fit_forest, grow_tree, split_points
from hydrospark.plans import training as TR


def _features(spark, n=600):
    rng = np.random.default_rng(7)
    rows = [(i, i % 6, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(a), float(b), int((a > 0.4) != (b > 0.7)))
            for i, (a, b) in enumerate(rng.random((n, 2)))]
    return spark.createDataFrame(rows, "reading_id long, device_id long, ts timestamp_ntz, a double, b double, target int")


def test_split_points():
    assert split_points(np.array([3.0, 1.0, 1.0, 2.0, np.nan])).tolist() == [1.5, 2.5]
    assert split_points(np.array([4.0, 4.0])).tolist() == []
    many = split_points(np.arange(6400.0))
    assert len(many) == 31 and np.allclose(np.diff(many), 200)


def test_first_split_is_the_best_one_and_leaves_are_pure():
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 32, (200, 1)).astype("uint8"), rng.integers(1, 4, 200).astype(float)
    y = (rng.random(200) < x[:, 0] / 32).astype(float)

    def sse(m):
        return (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()

    best = min((sse(x[:, 0] <= c) + sse(x[:, 0] > c), c) for c in range(x.min(), x.max()))[1]
    t = grow_tree(x, y, w, 1, np.random.default_rng(0))
    assert (t["feature"].tolist(), t["bin"][0], t["left"][0]) == ([0, -1, -1], best, 1)
    for side, m in ((1, x[:, 0] <= best), (2, x[:, 0] > best)):
        assert t["value"][side] == pytest.approx(np.average(y[m], weights=w[m]))
    # Grown out, every leaf holds one value of the feature or one label.
    t = grow_tree(x, y, w, 30, np.random.default_rng(0))
    at = np.zeros(200, int)
    while (open_ := t["feature"][at] >= 0).any():
        at = np.where(open_, t["left"][at] + (x[:, 0] > t["bin"][at]), at)
    for leaf in np.unique(at):
        m = at == leaf
        assert len(np.unique(x[m])) == 1 or len(np.unique(y[m])) == 1
        assert t["value"][leaf] == pytest.approx(np.average(y[m], weights=w[m]))


def test_ensemble_does_not_depend_on_how_rows_are_dealt(spark):
    f = _features(spark)
    one, many = (TR.train_regressor_ensemble(f.repartition(n), ["a", "b"], trees=8) for n in (1, 23))
    a, b = ({r["name"]: (r["mse"], r["r2"]) for r in m[0].collect()} for m in (one, many))
    assert a["random_forest"] == pytest.approx(b["random_forest"], rel=1e-9) and a["random_forest"][1] > 0.3
    imp = {r["feature"]: r["importance"] for r in TR.feature_importance(one[1]["random_forest"], ["a", "b"]).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and min(imp.values()) > 0.1


def test_forest_nulls_and_no_rows(spark):
    f = _features(spark).withColumn("a", F.when(F.col("reading_id") % 7 > 0, F.col("a")))
    forest = fit_forest(f, ["a", "b"], "target", trees=4)
    p = [r[0] for r in forest.transform(f).select("prediction").collect()]
    assert len(p) == 600 and all(0.0 <= v <= 1.0 for v in p)
    with pytest.raises(ValueError):
        fit_forest(f.limit(0), ["a", "b"], "target", trees=4)


def test_pump_sample_lies_in_few_partitions(spark, monkeypatch):
    # A learner's work is partitions times nodes, so a bounded sample must not keep the pieces of its table.
    pieces, fit = [], TR.Pipeline.fit
    monkeypatch.setattr(TR.Pipeline, "fit", lambda self, df: pieces.append(df.rdd.getNumPartitions()) or fit(self, df))
    t = TR.train_pump_classifier(_features(spark).repartition(40), ["a", "b"], num_trees=5, max_depth=4)
    assert len(pieces) == 1 and pieces[0] <= 8
    m = t.metrics.first()
    assert m["status"] == "success" and m["samples_used"] == 600 and m["accuracy"] > 0.7


def test_smallest_hashes_with_ties_of_leading_bits(spark):
    from hydrospark.operators.ranking import smallest_hashes
    h = sorted([5 << 20, (5 << 20) + 1, (5 << 20) + 2, 7 << 44, (7 << 44) + 9, 9, 9, 9])
    df = spark.createDataFrame([(c, v) for c in (0, 1) for v in h], "c int, h long")
    for k in range(1, 8):
        cut = smallest_hashes(df, "c", "h", {0: k, 1: 0})
        # Equal hashes at the cut stay out together.
        want = k if h[k - 1] != h[k] else sum(v < h[k - 1] for v in h)
        assert sum(v <= cut[0] for v in h) == want and cut[1] == -1
