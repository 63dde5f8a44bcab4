import random

from pyspark.sql import functions as F

from hydrospark.llm import packing as pk


def brute(pieces, capacity):
    bins = []
    for i, (n, s, c) in enumerate(pieces):
        best = None
        for k, b in enumerate(bins):
            room = capacity - sum(pieces[j][0] for j in b)
            if room >= n and all(pieces[j][1] != s and pieces[j][2] != c for j in b):
                if best is None or room < best[0]:
                    best = (room, k)
        if best:
            bins[best[1]].append(i)
        else:
            bins.append([i])
    return bins


def test_best_fit_matches_brute_force():
    r = random.Random(1)
    for _ in range(40):
        cap = r.choice([10, 50, 200])
        pieces = [(r.randint(1, cap), r.choice(["hot"] * 5 + ["a", "b", "c", None, "d"]), r.choice([i, 1, 2]))
                  for i in range(r.randint(0, 120))]
        if r.random() < 0.5:
            pieces.sort(key=lambda p: -p[0])
        assert pk.pack_shard(pieces, cap) == brute(pieces, cap)


def check(df, out, capacity, rows):
    seen = []
    for b in out:
        assert b["used"] == sum(b["lengths"]) <= capacity and b["residual"] == capacity - b["used"]
        own = [rows[d] for d in b["doc_ids"]]
        assert len({o[1] for o in own}) == len(own)
        assert len({o[2] for o in own if o[2] is not None}) == len([o for o in own if o[2] is not None])
        seen += [(d, s, n) for d, s, n in zip(b["doc_ids"], b["starts"], b["lengths"])]
    want = [(d, s, min(capacity, n - s)) for d, (n, _, _) in rows.items() for s in range(0, n or 0, capacity)]
    assert sorted(seen) == sorted(want)
    assert len({b["bin_id"] for b in out}) == len(out)


def test_pack(spark):
    r = random.Random(6)
    rows = {i: (r.choice([None, 0, 1, 7, 99, 100, 101, 250, 1000, r.randint(1, 300)]), r.choice(["hot", "hot", f"s{i % 9}", None]),
                r.choice([None, i, i % 5])) for i in range(600)}
    df = spark.createDataFrame([(i, *v, 1) for i, v in rows.items()],
                               "doc_id long, n long, source string, c long, shard int")
    out = pk.pack(df, F.col("n"), F.col("c"), capacity=100, shard_rows=100).collect()
    check(df, out, 100, rows)
    assert pk.pack(df.where("false"), F.col("n"), F.col("c")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "ab", "s"), (1, "ab", "s"), (None, "cd", "t"), (2, None, "t"), (3, "", "t")],
                               "doc_id long, text string, source string")
    out = pk.pack(df, pk.byte_tokens(F.col("text")), pk.copy_cluster(F.col("text")), capacity=10).collect()
    assert sorted(sorted(map(str, b["doc_ids"])) for b in out) == [["1"], ["1", "None"]]


def test_near_copies_share_no_bin(spark):
    r = random.Random(3)
    rows, i = [], 0
    for _ in range(40):
        words = [f"w{r.randint(0, 5000)}" for _ in range(120)]
        for _ in range(3):
            edited = list(words)
            edited[r.randint(0, 119)] = "edited"
            rows.append((i, " ".join(edited), f"s{i}"))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pk.pack_texts(df, capacity=4000).collect()
    assert sorted(d for b in out for d in b["doc_ids"]) == list(range(120))
    assert any(len(b["doc_ids"]) > 2 for b in out)
    for b in out:
        groups = [d // 3 for d in b["doc_ids"]]
        assert len(set(groups)) == len(groups)


def test_rows_of_one_id_are_dealt_over_shards(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"s{i}") for i in range(4000)], "doc_id long, source string")
    out = pk.pack(df, F.lit(1), F.lit(None), capacity=10, shard_rows=100).collect()
    pieces = {}
    for b in out:
        shard = b["bin_id"].split(":")[0]
        pieces[shard] = pieces.get(shard, 0) + len(b["doc_ids"])
    assert sum(pieces.values()) == 4000 and len(pieces) == 40 and max(pieces.values()) < 200


def test_bin_ids_are_unique(spark):
    docs = spark.createDataFrame([(1, 20), (1, 20), (None, 25), (None, 25), (2, 7), (1, 3)], "doc_id long, n long") \
        .withColumn("source", F.lit("s"))
    bins = pk.pack(docs, F.col("n"), F.lit(None), capacity=10, shard_rows=2).collect()
    assert len({b["bin_id"] for b in bins}) == len(bins)
    assert sum(sum(b["lengths"]) for b in bins) == 100
