import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.llm import registered, sharding
from hydrospark.llm.ordering import number_rows, running


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097, 65_537])
def test_permutation_and_its_inverse(n):
    p = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, seed=3, back=True).tolist() == list(range(n))
    shard, slot = sharding.locate(np.arange(n), n, 7, seed=3)
    for k in range(7):
        slots = np.sort(slot[shard == k])
        assert slots.tolist() == list(range(len(slots))) and abs(len(slots) - n / 7) <= 1
        rows = sharding.row_at(k, slots, n, 7, seed=3)
        assert (shard[rows] == k).all() and slot[rows].tolist() == slots.tolist()


def test_shuffles_large_domains():
    rows = np.arange(1 << 40, (1 << 40) + 4096)
    p = sharding.permute(rows, (1 << 61) + 5, seed=1)
    assert len(set(p.tolist())) == 4096 and p.min() >= 0
    assert sharding.permute(p, (1 << 61) + 5, seed=1, back=True).tolist() == rows.tolist()
    q = sharding.permute(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), q)[0, 1]) < 0.02
    # Neighbours land in unrelated shards.
    assert abs(np.mean(q[1:] % 8 == q[:-1] % 8) - 1 / 8) < 0.01


def _docs(spark):
    rows = [(i // 3 if i % 5 else None, None if i % 7 == 0 else "" if i % 7 == 1 else "é" * (i % 11), i) for i in range(400)]
    rows += [(9, "same", 0)] * 300
    return spark.createDataFrame(rows, "doc_id long, text string, shard long")


def test_same_rows_same_shards_however_dealt(spark):
    docs = _docs(spark)

    def shards(df):
        out = sharding.shard_rows(df, ["doc_id", "text"], shards=6, seed=2)
        return Counter(tuple(r) for r in out.select("doc_id", "text", "shard", "slot").collect())
    one = shards(docs.repartition(1))
    assert one == shards(docs.repartition(13))
    slots = {}
    for (_, _, shard, slot), k in one.items():
        assert k == 1
        slots.setdefault(shard, []).append(slot)
    assert sorted(slots) == list(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_number_rows_order_and_frequent_keys(spark):
    docs = _docs(spark).withColumn("tie", F.lit(1))
    out = number_rows(docs, "doc_id", "text").orderBy("row_number").collect()
    assert [r["row_number"] for r in out] == list(range(700))
    key = [((r["doc_id"] is not None, r["doc_id"] or 0), (r["text"] is not None, r["text"] or "")) for r in out]
    assert key == sorted(key)
    assert out[0].asDict().keys() >= {"shard", "tie"}
    assert number_rows(docs.where("false"), "doc_id").count() == 0


def test_running_over_blocks(spark):
    rows = [(k, p, (p * 37 + 11) % 64) for k in (1, None) for p in range(-10, 40)]
    df = spark.createDataFrame(rows, "k long, p long, v long").repartition(5)
    out = running(df, "k", "p", {"s": (F.sum, F.col("v"), lambda a, b: a + b),
                                 "x": (F.bit_xor, F.col("v"), lambda a, b: a.bitwiseXOR(b))}, block_rows=7).collect()
    assert len(out) == 100
    for r in out:
        before = [v for k, p, v in rows if k == r["k"] and p <= r["p"]]
        assert r["s"] == sum(before) and r["x"] == np.bitwise_xor.reduce(before)


def test_written_shards(spark, tmp_path):
    docs = _docs(spark).drop("shard")
    out = sharding.shard_rows(docs, ["doc_id", "text"], shards=3)
    sharding.write_shards(out, str(tmp_path / "s"), rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = ["doc_id", "text", "row_number", "shard", "slot"]
    assert Counter(map(tuple, back.select(key).collect())) == Counter(map(tuple, out.select(key).collect()))
    assert back.select(F.input_file_name()).distinct().count() >= 3 * 5
    assert sharding.shard_rows(docs.where("false"), ["doc_id"]).count() == 0


def test_query(spark):
    out = registered.QUERIES["op11_sharding"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
