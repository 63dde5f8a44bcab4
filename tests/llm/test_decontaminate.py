import random
import re

import pytest

from hydrospark.llm import decontaminate as de

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[s:s + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(x) for x in ids if x is not None}
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("small_rows", [10 ** 6, 0])
def test_matches_brute_force(spark, short, small_rows):
    r = random.Random(9 + short)
    vocab = ["a", "b", "the", "of", "Éa", "x9"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([5, 8, 13, 20] + [1, 2, 3] * short)))) for k in range(14)]
    items += [(2, items[2][1]), (50, None), (51, "--"), (None, items[4][1]), (52, items[0][1].upper())]
    docs = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 30, 200])))) for k in range(40)]
    for k in range(20):
        t = r.choice(items)[1] or ""
        docs.append((100 + k, f"{r.choice(vocab)}, {t}! {r.choice(vocab)} {t[:9]}"))
    docs += [(1, None), (100, docs[-1][1]), (None, items[3][1]), (300, items[1][1] + " " + items[1][1])]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, pos int, item string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, win int")
    got = de.contamination(d, b, window=8, small_rows=small_rows).collect()
    want = brute(docs, items, 8)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], list(x["items"])) for x in got) == want
    bad = {i for i, n, h, _ in want if h > 0 and 20 * h >= n}
    left = de.drop_contaminated(d, b, window=8, small_rows=small_rows)
    assert left.columns == d.columns
    keep = sorted(str(i) for i, t in docs if (lambda w: not (w[2] > 0 and 20 * w[2] >= w[1]))(brute([(i, t)], items, 8)[0]))
    assert sorted(str(x["doc_id"]) for x in left.collect()) == keep and bad


def test_empty_and_native(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = de.contamination(d, b).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (3, 0, [])
    assert de.contamination(d.where("false"), b).count() == 0
    assert de.contamination(d.where("false"), d.withColumnRenamed("doc_id", "item_id")).count() == 0
    long = spark.createDataFrame([(1, "x " * 50_000 + " ".join(f"w{i}" for i in range(13)))], "doc_id long, text string")
    item = spark.createDataFrame([(5, " ".join(f"W{i}" for i in range(13)))], "item_id long, text string")
    out = de.contamination(long, item)
    assert (out.first()["n_words"], out.first()["n_hit"]) == (50_013, 13)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
