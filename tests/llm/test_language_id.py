import numpy as np
from pyspark.sql import functions as F

from hydrospark.llm import language_id as li
from hydrospark.llm.common import held_out

DOCS = [(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, "The End, and then!", "en"),
        (4, "Über den Wäldern und Ästen", "de"), (5, None, "en"), (6, "", "de"), (7, "123 !!", None),
        (8, "and the thing", None), (8, "and the thing", None), (None, "und der die das", None)]


def brute_vector(text, dim, seed):
    def letter(c):
        return np.random.default_rng((seed, ord(c))).integers(0, 2, dim, dtype=np.int8).astype(float) * 2 - 1
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in s:
        s = s.replace("  ", " ")
    out = np.zeros(dim)
    for a, b, c in zip(s, s[1:], s[2:]):
        out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out


def test_matches_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    model = li.fit(df, dim=128)
    protos = {}
    for _, t, lang in DOCS:
        if t is not None and lang is not None:
            protos[lang] = protos.get(lang, 0) + brute_vector(t, 128, 7)
    assert model.languages == tuple(sorted(protos))
    got = li.identify(df, model).collect()
    assert len(got) == len(DOCS)
    for r in got:
        v = brute_vector(r["text"] or "", 128, 7)
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert r["lang_pred"] == best
        assert abs(r["score"] - min(max(cos[best], 0), 1)) < 1e-9


def test_partitioning_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = li.fit(df.repartition(1), dim=64), li.fit(df.repartition(7), dim=64)
    assert a.languages == b.languages and np.array_equal(a.prototypes, b.prototypes)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(df, where=~held_out(F.col("doc_id")))
    out = li.identify(df, model).where(held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_long_text_equals_its_slices(spark):
    text = "the quick brown fox " * 120_000  # 2.4 million characters
    rows, keys = li._trigrams([text.encode()])
    n, v = len(text.split()), li._bundles(li._Binder(64, 7), rows, keys, 1)[0]
    one = brute_vector("the quick brown fox the quick brown fox", 64, 7) - brute_vector("the quick brown fox", 64, 7)
    assert np.array_equal(v, brute_vector("the quick brown fox", 64, 7) + (n // 4 - 1) * one)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = li.fit(empty)
    assert model.languages == () and li.identify(empty, model).count() == 0
    df = spark.createDataFrame([(1, "a", "x", 2.0, 5)], "doc_id long, text string, Lang_Pred string, score double, n int")
    r = li.identify(df, model).first()
    assert r["lang_pred"] == "und" and r["n"] == 5 and r["score"] == 0.0
