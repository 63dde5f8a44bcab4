"""Clusters of near copies by MinHash signatures.

A signature holds, for each of 128 permutations, the smallest value of the
text's five-word shingles; two signatures agree at a share of places that
estimates the Jaccard similarity of the shingle sets. Signatures that agree on
one of 32 bands of 4 values meet in a cell, where whole signatures are
compared. A pair of similarity 0.8 meets in no cell with probability 5e-8 and
agrees on under ``MIN_AGREE`` of its places with probability 1e-4.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import byte_slices, cut_lineage, space_words
from hydrospark.llm.components import connected_components

PLACES, BAND, SHINGLE, SEED = 128, 4, 5, 42
# Four standard deviations under 0.8, so that the estimate misses hardly any pair of 0.8.
MIN_AGREE = 84
_RNG = np.random.default_rng(SEED)
_MULTIPLY = (_RNG.integers(0, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1))[:, None]
_FLIP = _RNG.integers(0, 1 << 32, PLACES, dtype=np.uint32)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(data: bytes | None) -> bytes | None:
    """128 values of 16 bits; None for a text without words. A text of under
    five words has one shingle of all of them."""
    import xxhash

    words = space_words(data) if data else []
    if not words:
        return None
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, SEED) for x in words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * _MIX + w[i:len(w) - k + 1 + i]
    h = ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32)
    low = np.full(PLACES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, ((h[at:at + 2048] ^ _FLIP) * _MULTIPLY).min(axis=1))
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype("<u2").tobytes()


def _band_rows(batches):
    import pyarrow as pa

    n = PLACES // BAND
    tag = np.arange(1, n + 1, dtype=np.uint64)
    for b in batches:
        key = np.asarray(b.column(0))
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u2").reshape(-1, n, BAND).astype(np.uint64)
        band = sig[:, :, 0] | sig[:, :, 1] << np.uint64(16) | sig[:, :, 2] << np.uint64(32) | sig[:, :, 3] << np.uint64(48)
        band = (band ^ (band >> np.uint64(31))) * _MIX + tag * np.uint64(0xC2B2AE3D27D4EB4F)
        yield pa.RecordBatch.from_arrays(
            [pa.array(band.reshape(-1).view(np.int64)), pa.array(np.repeat(key, n))], names=["band", "key"])


def _compare(key: np.ndarray, sig: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges with the components of one cell's links: each signature against
    those that are not joined to it yet."""
    root = np.arange(len(key))
    a, b = [], []
    for i in range(len(key)):
        rest = np.flatnonzero(root != root[i])
        if not len(rest):
            break
        near = rest[(sig[rest] == sig[i]).sum(axis=1) >= MIN_AGREE]
        for r in np.unique(root[near]).tolist():
            a.append(int(key[i]))
            b.append(int(key[near[root[near] == r][0]]))
            root[root == r] = root[i]
    return a, b


def _cell_links(batches):
    """Compare sorted rows (band, i, j, key, sig) cell by cell; a cell may
    continue in the next Arrow batch."""
    import pyarrow as pa

    def links(cell, key, sig):
        edge = (np.flatnonzero(np.any(cell[1:] != cell[:-1], axis=1)) + 1).tolist()
        a, b = [], []
        for s, e in zip([0, *edge], [*edge, len(cell)], strict=True):
            if e - s > 1:
                x, y = _compare(key[s:e], sig[s:e])
                a += x
                b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rest = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cell = np.stack([np.asarray(b.column(i)) for i in range(3)], axis=1)
        key = np.asarray(b.column(3))
        sig = np.frombuffer(b"".join(b.column(4).to_pylist()), dtype="<u2").reshape(-1, PLACES)
        if rest is not None:
            cell, key, sig = (np.concatenate(p) for p in zip(rest, (cell, key, sig), strict=True))
        last = np.flatnonzero(np.any(cell != cell[-1], axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield links(cell[:cut], key[:cut], sig[:cut])
        rest = (cell[cut:], key[cut:], sig[cut:])
    if rest is not None:
        yield links(*rest)


def signature_links(distinct: DataFrame, cell_rows: int = 4096) -> DataFrame:
    """Edges (a, b) with the components of all linked pairs that share a band,
    from (``key``, ``sig``) with different keys. A cell of over ``cell_rows``
    is split exactly into pairs of blocks."""
    at = distinct.select("key", "sig").mapInArrow(_band_rows, "band long, key long")
    sizes = (at.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("band", F.ceil(F.col("n") / cell_rows).cast("int").alias("k")))
    rows = at.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    cells = cut_lineage(rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
                        .select("band", F.least("block", "other").cast("long").alias("i"),
                                F.greatest("block", "other").cast("long").alias("j"), "key"))
    met = distinct.join(cells.select("key").distinct(), "key", "left_semi")
    dealt = (cells.join(met, "key").select("band", "i", "j", "key", "sig").repartition("band", "i", "j")
             .sortWithinPartitions("band", "i", "j"))
    return dealt.mapInArrow(_cell_links, "a long, b long")


def near_copy_clusters(docs: DataFrame, key: Column, normal: Column, carry: list[Column]) -> DataFrame:
    """``carry`` columns and ``cluster`` (long) per row of ``docs``: rows of one
    ``key`` (a hash of the normal text) and, through chains, of near copies
    share it. Texts are read once and never moved; whole texts are read. A text
    without words is only a copy of its equals. An empty table stays empty."""
    import pyarrow as pa

    base = docs.select(*carry, key.alias("key"), normal.alias("_text"))

    def run(batches):
        for b in batches:
            sig = [signature(v) for _, values in byte_slices(b.column(b.num_columns - 1)) for v in values]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sig, pa.binary())],
                                             names=[*b.schema.names[:-1], "sig"])

    schema = base.drop("_text").withColumn("sig", F.lit(None).cast("binary")).schema
    rows = cut_lineage(base.mapInArrow(run, schema))
    distinct = cut_lineage(rows.where("sig is not null").select("key", "sig").dropDuplicates(["key"]))
    roots = connected_components(signature_links(distinct))
    named = rows.drop("sig").join(roots.withColumnRenamed("node", "key"), "key", "left")
    return named.withColumn("cluster", F.coalesce("root", "key")).drop("key", "root")
