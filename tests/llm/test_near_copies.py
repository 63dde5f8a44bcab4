import random

import pytest
from pyspark.sql import functions as F

from hydrospark.llm import near_copies as nc
from hydrospark.llm.components import connected_components


def shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def corpus(seed):
    """Families of edited copies of many sizes beside unrelated texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([12, 60, 200, 600]))]
        for _ in range(r.choice([1, 2, 6, 15])):
            w = list(base)
            for _ in range(max(0, int(len(w) * r.choice([0, 0.005, 0.01, 0.03])))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    return texts + [" ".join(r.choice(vocab) for _ in range(80)) for _ in range(100)]


def clusters(spark, texts, **extra):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "id long, text string, key int, sig string")
    out = nc.near_copy_clusters(df.repartition(4), F.xxhash64(F.lower(F.col("text"))), F.col("text"), [F.col("id")])
    return {r["id"]: r["cluster"] for r in out.collect()}


def test_recall_against_exact_jaccard(spark):
    texts = corpus(1)
    got = clusters(spark, texts)
    assert len(got) == len(texts)
    sets = [shingles(t) for t in texts]
    near = far = 0
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            jaccard = len(sets[i] & sets[j]) / union if union else 0
            if jaccard >= 0.8:
                near += 1
                assert got[i] == got[j], (i, j, jaccard)
            elif jaccard == 0:
                far += got[i] == got[j]
    assert near > 150 and far == 0


def test_split_cells_find_the_same_groups(spark):
    texts = corpus(2)
    rows = [(i, nc.signature(t.encode())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key long, sig binary")

    def groups(cell_rows):
        roots = {r["node"]: r["root"] for r in connected_components(nc.signature_links(df, cell_rows)).collect()}
        by = {}
        for n, root in roots.items():
            by.setdefault(root, set()).add(n)
        return sorted(map(sorted, by.values()))
    whole = groups(4096)
    assert whole == groups(3) == groups(1) and len(whole) > 5


def test_odd_texts(spark):
    texts = ["", " \t ", "one", "one", "One", "one two three four", "one two three four", "x " * 20_000, "x " * 20_001, None]
    got = clusters(spark, [t for t in texts if t is not None])
    assert got[2] == got[3] == got[4] and got[5] == got[6] and got[2] != got[5]
    assert got[7] == got[8]  # one shingle each, the same
    assert got[0] != got[1]  # without words only equals are copies
    df = spark.createDataFrame([(1, None), (2, None)], "id long, text string")
    null = nc.near_copy_clusters(df, F.xxhash64("text"), F.col("text"), [F.col("id")]).collect()
    assert len(null) == 2 and null[0]["cluster"] == null[1]["cluster"]
    assert nc.near_copy_clusters(df.where("false"), F.xxhash64("text"), F.col("text"), [F.col("id")]).count() == 0


@pytest.mark.parametrize("data,n", [(b"", None), (b"  ", None), (b"a", 256), (b"a b c d e f", 256)])
def test_signature_size(data, n):
    assert (len(nc.signature(data)) if n else nc.signature(data)) == n
