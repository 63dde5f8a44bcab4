"""SimHash near-duplicate groups by anchor-point covering.

A pair of 64-bit fingerprints that differ in at most 3 bits differs in at most
one bit in one of its two 32-bit halves. The anchors of a half are the points
of a covering code: the [31, 26] Hamming code (covering radius 1) times both
values of the top bit. Every fingerprint is at home at the one anchor within
radius 1 and is replicated to all anchors within radius 1 plus the half's
threshold 1; the two members of such a pair therefore meet at the home anchor
of either, where their whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import byte_slices, cut_lineage, space_words, text_key
from hydrospark.llm.components import connected_components

SEED = 42
_CHECK = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)], dtype=np.uint64)


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles (repeats included): a bit is 1 if set
    in over half of the shingles' XXH64 values; no words give 0."""
    import xxhash

    words = space_words(data) if data else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(counts * 2 > len(h)).tolist())


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ("doc_id",),
                 extra: list[Column] | None = None) -> DataFrame:
    """``carry`` columns, ``extra`` expressions and ``fp`` (long, the fingerprint's bits as signed) per row."""
    import pyarrow as pa

    extra = extra or []
    base = docs.select(*[F.col(f"`{c}`") for c in carry], *extra, F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for _, values in byte_slices(b.column(b.num_columns - 1)):
                fps.extend(fingerprint(v, shingle) for v in values)
            out = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "fp"])

    schema = base.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema
    return base.mapInArrow(run, schema)


def home_anchor(half: np.ndarray) -> np.ndarray:
    """The anchor within distance 1 of each 32-bit value."""
    low = half & np.uint64(0x7FFFFFFF)
    s = _syndrome(low)
    flip = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64), np.uint64(0))
    return half ^ flip


def _syndrome(low: np.ndarray) -> np.ndarray:
    s = np.zeros(len(low), dtype=np.int64)
    for k in range(5):
        s |= (np.bitwise_count(low & _CHECK[k]).astype(np.int64) & 1) << k
    return s


def near_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within distance 2 of each 32-bit value, as (row, anchor) arrays."""
    one, top = np.uint64(1), np.uint64(1 << 31)
    rows = np.arange(len(half))
    s = _syndrome(half & np.uint64(0x7FFFFFFF))
    home = home_anchor(half)
    out_rows, out = [rows, rows], [home, home ^ top]  # the latter is at distance 1 + (s > 0), at most 2
    off = s > 0
    for i in range(1, 32):
        j = i ^ s
        use = off & (j > i)
        bit_j = one << (np.where(use, j, 1) - 1).astype(np.uint64)
        out_rows.append(rows[use])
        out.append((half ^ (one << np.uint64(i - 1)) ^ bit_j)[use])
    return np.concatenate(out_rows), np.concatenate(out)


def _anchor_rows(batches):
    import pyarrow as pa

    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        for lo in range(0, len(fp), 1 << 14):
            part = fp[lo:lo + (1 << 14)]
            for side in (0, 1):
                half = (part >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                home = home_anchor(half)
                rows, anchors = near_anchors(half)
                tag = np.uint64(side << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((anchors | tag).view(np.int64)), pa.array(part[rows].view(np.int64)),
                     pa.array(anchors == home[rows])], names=["anchor", "fp", "home"])


def _compare(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the roots of one anchor cell's components, at most one per
    fingerprint: each home fingerprint against all; no pair list is kept."""
    parent = np.arange(len(fps))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits)
        # Already joined neighbours are skipped in bulk by their current parents.
        r = find(i)
        for p in np.unique(parent[near]).tolist():
            q = find(p)
            if q != r:
                parent[max(q, r)] = min(q, r)
                r = min(q, r)
        parent[near] = r
    # parent[near] = r may only lower chains inside one set, so roots stay right.
    roots = np.array([find(i) for i in range(len(fps))])
    sel = roots != np.arange(len(fps))
    return fps[sel], fps[roots[sel]]


def _cell_links(max_bits: int):
    """Compare the sorted rows of a partition cell by cell. A cell may continue
    in the next Arrow batch; its rows are bounded by the salting."""
    import pyarrow as pa

    def links(cell, fp, home):
        edge = np.flatnonzero(np.any(cell[1:] != cell[:-1], axis=1)) + 1 if len(cell) else np.array([], int)
        starts, ends = np.concatenate([[0], edge]).astype(int), np.concatenate([edge, [len(cell)]]).astype(int)
        keep = (ends - starts) > 1
        a, b = [], []
        for s, e in zip(starts[keep], ends[keep], strict=True):
            h = home[s:e]
            if not h.any():
                continue
            f, at = np.unique(fp[s:e], return_index=True)
            if len(f) < 2:
                continue
            hh = np.zeros(len(f), dtype=bool)
            hh[np.searchsorted(f, fp[s:e][h])] = True
            x, y = _compare(f, hh, max_bits)
            a.append(x)
            b.append(y)
        a = np.concatenate(a) if a else np.array([], np.uint64)
        b = np.concatenate(b) if b else np.array([], np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            if b.num_rows == 0:
                continue
            cell = np.stack([np.asarray(b.column(i)) for i in range(3)], axis=1)
            fp = np.asarray(b.column(3)).view(np.uint64)
            home = b.column(4).to_numpy(zero_copy_only=False)
            if rest is not None:
                cell, fp, home = (np.concatenate(p) for p in zip(rest, (cell, fp, home), strict=True))
            last = np.flatnonzero(np.any(cell != cell[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(cell[:cut], fp[:cut], home[:cut])
            rest = (cell[cut:], fp[cut:], home[cut:])
        if rest is not None:
            yield links(*rest)

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Edges (a, b) with the same components as the links between distinct
    fingerprints (column ``fp``) that differ in at most ``max_bits`` <= 3 bits:
    per anchor cell each linked fingerprint with its cell's root, not all pairs.

    An anchor with over ``cell_rows`` fingerprints (a large group of near
    copies) is split exactly: its fingerprints are dealt into k blocks and
    every pair of blocks is a cell of its own, so a cell holds about
    2 * ``cell_rows`` rows at most and any number of tasks share the anchor.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors cover distances up to 3")
    at = distinct.select("fp").mapInArrow(_anchor_rows, "anchor long, fp long, home boolean")
    counts = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("home").cast("int")).alias("h"))
    # Anchors with one fingerprint or without a home have nothing to compare.
    sizes = (counts.where("n > 1 and h = 1")
             .select("anchor", F.ceil(F.col("n") / cell_rows).cast("int").alias("k")))
    rows = at.join(sizes, "anchor").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    # A fingerprint of block i takes part in the cells (i, j) and (j, i) of its anchor.
    cells = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("anchor", F.least("block", "other").cast("long").alias("i"),
                     F.greatest("block", "other").cast("long").alias("j"), "fp", "home"))
    dealt = cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(_cell_links(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3,
                   max_bits: int = 3, extra: list[Column] | None = None) -> DataFrame:
    """Near-duplicate groups of all rows of ``docs`` by whole-text SimHash.

    Returns one row per input row: the id, ``_text_hash``/``_text_bytes`` (which
    with the id identify the row's content), ``fp`` (long), ``root`` (long, one
    fingerprint of the group) and ``component_id`` (smallest id of the group).
    ``extra`` columns, expressions over ``docs``, are carried along.

    Null and word-less texts have fingerprint 0 and are linked like any other.
    A null id takes part in links but is never a ``component_id`` while the
    group has another id. Repeated rows share their fingerprint; ties need no
    rule. Copies are collapsed to distinct fingerprints before the covering, so
    a group of exact copies of any size costs one row there. Other columns are
    ignored. An empty table gives an empty result.
    """
    fps = cut_lineage(fingerprints(docs, text_col, shingle, (id_col,),
                                   [*text_key(F.col(f"`{text_col}`")), *(extra or [])]))
    groups = cut_lineage(fps.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("least")))
    roots = connected_components(fingerprint_links(groups, max_bits))
    member = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    member = cut_lineage(member)
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.select("fp", "root").join(least, "root")
    return fps.join(named, "fp")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
