import math

import numpy as np
import pytest

from hydrospark.llm import embed_dedup as ed


def brute(rows, least=0.95):
    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = [[] for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and ok(rows[a][1]) and ok(rows[b][1]) and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    link[a].append(b)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        comp = min(ids, default=None)
        out.append((str(rows[a][0]), len(link[a]), comp, rows[a][0] == comp))
    return sorted(out)


@pytest.mark.parametrize("opts", [{}, {"list_rows": 20, "cell_rows": 15, "sample_rows": 120}])
def test_matches_brute_force(spark, opts):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        c = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (c + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.25])).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0, None] + [0.0] * 10), (904, [math.nan] * 12),
             (905, [math.inf] + [1.0] * 11), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), (3, rows[3][1]),
             (908, [x * 1e200 for x in rows[5][1]]), (909, [1e-300] * 12), (910, [5.0] * 12), (None, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, root int, n int")
    got = ed.embedding_groups(df, **opts).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.embedding_groups(df).count() == 0
    one = spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ed.embedding_groups(one).collect()] == [(4, 0, 4, True)]


def test_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], [float(x) for x in r[1]]) for r in df.collect()]
    got = ed.embedding_groups(df, list_rows=32, cell_rows=64).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == brute(rows)
