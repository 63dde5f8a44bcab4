"""Split points of features for tree learners: thresholds at equal shares of the
rows, exact over the whole table.

Each block of rows is sorted by every feature once. The value at a share is then
found bit by bit: doubles are taken as integers of the same order, and a step
counts the rows below 255 candidates of each open prefix, so a step returns at
most 31 * 255 counts a feature however many rows or values there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
_BLOCK_ROWS = 131_072
_STEP = 8
_SIGN = np.uint64(1 << 63)


def split_points(values: np.ndarray) -> np.ndarray:
    """At most 31 thresholds: midpoints of all neighbours, or of those at equal
    shares of the rows where there are more than 32 values."""
    found, n = np.unique(values[~np.isnan(values)], return_counts=True)
    mid = (found[:-1] + found[1:]) / 2
    if len(found) <= BINS:
        return mid
    at = np.searchsorted(np.cumsum(n), n.sum() * np.arange(1, BINS) / BINS)
    return np.unique(mid[np.minimum(at, len(mid) - 1)])


def _keys(values: np.ndarray) -> np.ndarray:
    u = (values + 0.0).view("uint64")
    return np.where(u & _SIGN, ~u, u | _SIGN)


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _SIGN, keys ^ _SIGN, ~keys).view("float64")


def as_doubles(cols: list[str]) -> list[Column]:
    """The columns as doubles, named by position."""
    return [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]


def in_blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about ``rows`` rows, the last one of what is left."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held = []
    if held and sum(map(len, held)):
        yield pd.concat(held)


def table_split_points(df: DataFrame, features: list[str], nearest: bool = False) -> list[np.ndarray]:
    """``split_points`` of each feature over all rows of ``df``, in one scan of it.
    With ``nearest`` the threshold of a share is the one nearest to it, above or
    below, as MLlib takes them, rather than the first that reaches it."""
    k = len(features)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_blocks(batches, _BLOCK_ROWS):
            cols = [pdf[f"_{i}"].to_numpy("float64", na_value=np.nan) for i in range(k)]
            yield pd.DataFrame({"f": range(k), "keys": [np.sort(_keys(v[~np.isnan(v)])).tobytes() for v in cols]})

    blocks = df.select(*as_doubles(features)).mapInPandas(ordered, "f int, keys binary").persist(
        StorageLevel.MEMORY_AND_DISK)

    def merged(of_block, merge) -> dict[int, np.ndarray]:
        """feature -> ``merge`` of what ``of_block(feature, sorted keys)`` gives, first per task, then in all."""
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, keys in zip(batch["f"].to_pylist(), batch["keys"]):
                    keys = keys.as_buffer()  # not a copy
                    a = of_block(f, np.frombuffer(keys, "uint64") if keys.size else np.array([], "uint64"))
                    if a is not None:
                        got[f] = merge(got[f], a) if f in got else a
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()),
                                              pa.array([a.tobytes() for a in got.values()], pa.binary())], names=["f", "a"])

        def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            a = np.frombuffer(pdf["a"].iloc[0], "uint64")
            for b in pdf["a"].iloc[1:]:
                a = merge(a, np.frombuffer(b, "uint64"))
            return pd.DataFrame({"f": [key[0]], "a": [a.tobytes()]})

        out = blocks.mapInArrow(part, "f int, a binary").groupBy("f").applyInPandas(whole, "f int, a binary")
        return {r["f"]: np.frombuffer(r["a"], "uint64") for r in out.collect()}  # one row a feature

    try:
        # The smallest values, up to one more than there are bins.
        least = merged(lambda f, keys: np.unique(keys)[:BINS + 1], lambda a, b: np.union1d(a, b)[:BINS + 1])
        points = {f: split_points(_values(a)) for f, a in least.items() if len(a) <= BINS}
        n = merged(lambda f, keys: None if f in points else np.array([len(keys)], "uint64"), np.add)
        share = {f: int(m[0]) * np.arange(1, BINS) / BINS for f, m in n.items()}
        # Smallest key with at least a share of the rows at or below it: leading bits so far.
        at = {f: np.zeros(BINS - 1, "uint64") for f in share}
        for shift in range(64 - _STEP, -1, -_STEP) if share else ():
            tried = {f: (a[:, None] + (np.arange(1, 1 << _STEP, dtype="uint64") << np.uint64(shift))[None, :])
                     for f, a in at.items()}
            below = merged(lambda f, keys: None if f not in tried else np.searchsorted(keys, tried[f].ravel()).astype("uint64"),
                           np.add)
            for f, b in below.items():
                short = (b.reshape(tried[f].shape) < share[f][:, None]).sum(axis=1)
                at[f] = at[f] + (short.astype("uint64") << np.uint64(shift))
        top = np.uint64(2 ** 64 - 1)  # the key of no double
        after = merged(lambda f, keys: None if f not in at else np.append(keys, top)[np.searchsorted(keys, at[f], "right")],
                       np.minimum) if at else {}
        before = merged(lambda f, keys: None if f not in at else np.append(np.uint64(0), keys)[np.searchsorted(keys, at[f])],
                        np.maximum) if at else {}
        sides = merged(lambda f, keys: None if f not in at else np.concatenate(
            [np.searchsorted(keys, at[f]), np.searchsorted(keys, at[f], "right")]).astype("uint64"), np.add) if at and nearest else {}
        for f, a in at.items():
            last = after[f] == top
            if nearest:
                below, upto = sides[f].astype("float64").reshape(2, -1)
                last |= (below > 0) & (share[f] - below < upto - share[f])
            points[f] = np.unique((_values(np.where(last, before[f], a)) + _values(np.where(last, a, after[f]))) / 2)
        return [points.get(i, np.array([])) for i in range(k)]
    finally:
        blocks.unpersist()
