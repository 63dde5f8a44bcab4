import numpy as np
from pyspark.sql import functions as F

from hydrospark.llm import quality as q
from hydrospark.llm.common import held_out


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = q.fit(docs, labels, where=~held_out(F.col("doc_id")))
    out = q.score_quality(docs.where(held_out(F.col("doc_id"))).join(labels, "doc_id"), model)
    rows = [(r["score"], r["quality"], r["predicted"]) for r in out.collect()]
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    order = s.argsort()
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.98 and np.mean([p == t for _, t, p in rows]) > 0.97
    assert all(0 <= a <= 1 and p == (a >= 0.5) for a, _, p in rows)


def test_risk_is_non_negative_pu():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, q.N_FEATURES)), rng.normal(-1, 1, (100, q.N_FEATURES))
    model = q.fit_nnpu(good[:200], np.concatenate([good[200:], bad]), 2 / 3)
    assert q.score_matrix(model, good).mean() > 0.9 and q.score_matrix(model, bad).mean() < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0, "a"), (2, "", 1.0, "b"), (2, "", 1.0, "b"), (None, "x y " * 90_000, 0.0, "c")],
                                 "doc_id long, text string, Score double, x string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit(docs, none) is None
    assert [r["score"] for r in q.score_quality(docs, None).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    model = q.fit(docs, labels, steps=20)
    out = q.score_quality(docs, model).collect()
    assert len(out) == 4 and out[0]["score"] == out[1]["score"] and out[0]["x"] == "a"
    assert q.score_quality(docs.where("false"), model).count() == 0
    assert q.fit(docs.where("false"), labels) is None


def direct_risk(w, p, u, prior):
    """The risk row by row, as the estimator is written down."""
    import math

    def loss(x, y):  # logistic loss of label y, 1 or 0
        t = float(x @ w)
        return math.log1p(math.exp(-t if y else t))
    rp1 = sum(loss(x, 1) for x in p) / len(p)
    rp0 = sum(loss(x, 0) for x in p) / len(p)
    ru0 = sum(loss(x, 0) for x in u) / len(u)
    return prior * rp1 + max(0.0, ru0 - prior * rp0), ru0 - prior * rp0


def test_risk_and_gradient_match_direct_sums():
    rng = np.random.default_rng(3)
    p, u = rng.normal(0.5, 1, (30, 6)), rng.normal(0, 1, (50, 6))
    seen = set()
    for k in range(40):
        w, prior = rng.normal(0, 1 + k % 3, 6), [0.2, 0.5, 0.9][k % 3]
        risk, rest, g = q.pu_risk(w, p, u, prior)
        want, bracket = direct_risk(w, p, u, prior)
        assert abs(risk - want) < 1e-9 and abs(rest - bracket) < 1e-9
        seen.add(bracket >= 0)

        def of(x, clipped=bracket < 0):
            r, b = direct_risk(x, p, u, prior)
            return -b if clipped else r
        step = np.eye(6) * 1e-6
        slope = np.array([(of(w + s) - of(w - s)) / 2e-6 for s in step])
        assert np.allclose(g, slope, atol=1e-5)
    assert seen == {True, False}  # both branches


def test_fit_follows_the_direction():
    rng = np.random.default_rng(5)
    p, u = rng.normal(0.7, 1, (80, q.N_FEATURES)), rng.normal(0, 1, (160, q.N_FEATURES))
    start = q.fit_nnpu(p, u, 0.4, steps=0)
    done = q.fit_nnpu(p, u, 0.4, steps=200)
    x = [q._expand(a, done.mean, done.scale) for a in (p, u)]
    assert q.pu_risk(done.weights, *x, 0.4)[0] < q.pu_risk(start.weights, *x, 0.4)[0]


def test_repeated_rows_and_prior(spark):
    docs = spark.createDataFrame([(i, "good text number " * (i % 5 + 1) if i % 2 else "$$ 99 ## !!" * 9, 1) for i in range(40)] * 2,
                                 "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 3 + [(31, 1), (33, 1)], "doc_id long, quality int")
    model = q.fit(docs, labels, steps=100)
    assert abs(model.prior - 17 / 32) < 1e-12  # labels once each, known negatives included
    out = q.score_quality(docs, model).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(out) == 80 and all(len(x) == 1 for x in by.values())
    assert min(max(by[i]) for i in range(1, 40, 2)) > max(max(by[i]) for i in range(0, 40, 2))
