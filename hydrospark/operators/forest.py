"""Random forest regression with deep trees, fitted on every row of a table.

A level-by-level learner over the whole cluster sends the statistics of every
open node from every partition; trees that grow until their leaves are pure have
about as many nodes as rows, so that traffic is many times the rows themselves.
Here only the nodes of more than ``_LOCAL_ROWS`` rows are split that way (the top
of each tree, at most a few nodes per ``_LOCAL_ROWS`` rows). The rows of the others
(binned to one byte a feature, in blocks) are dealt to one task a node, which grows
the rest of the tree there. Trees are grown in groups, so that what is dealt at a
time is bounded by ``_GROUP_DRAWS`` rows, or one tree.

The rules are those of MLlib's ``RandomForestRegressor``: 32 bins, Poisson(1)
bootstrap weights, a third of the features drawn per node, variance gain, mean of
the trees; split points come from all rows. Weights and draws are hashes of the row
and the tree, so a forest does not depend on how rows are dealt. A fitted forest has
about as many nodes as rows, so it is a table too and never gathered.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators.split_points import BINS as _BINS
from hydrospark.operators.split_points import as_doubles, in_blocks, split_points, table_split_points  # noqa: F401
from hydrospark.session import scratch_path

_LOCAL_ROWS = 250_000
_BLOCK_ROWS = 131_072
_GROUP_DRAWS = 100_000_000
_BUCKET_ROWS = 16_384
# Poisson(1): P(weight <= k); a draw's weight is the number of these it reaches.
_POISSON = np.array([sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)])
_TREE = "tree int, node int, feature binary, bin binary, left binary, value binary, importance binary"
_KINDS = {"feature": "int8", "bin": "uint8", "left": "int32", "value": "float64"}


def _binned(cols: list[np.ndarray], points: list[np.ndarray]) -> np.ndarray:
    # Bin b of a value: it is at most point b and above point b - 1; null is above all.
    return np.column_stack([np.searchsorted(p, c).astype("uint8") for c, p in zip(cols, points)])


def _doubles(pdf: pd.DataFrame, k: int) -> list[np.ndarray]:
    return [pdf[f"_{i}"].to_numpy("float64", na_value=np.nan) for i in range(k)]


def _weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weights of rows in a tree, from Spark's xxhash64(row, tree, seed)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    u = np.uint64

    def turned(x, by):
        return (x << u(by)) | (x >> u(64 - by))

    def mixed(h):
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))

    with np.errstate(over="ignore"):
        h = mixed(turned((u(42) + p5 + u(8)) ^ (turned(row.view("uint64") * p2, 31) * p1), 27) * p1 + p4)
        for word in (tree, seed):
            h = mixed(turned((h + p5 + u(4)) ^ (u(word & 0xFFFFFFFF) * p1), 23) * p2 + p3)
    draw = (h & u(2 ** 52 - 1)).astype("float64") / 2.0 ** 52
    return np.searchsorted(_POISSON, draw, "right").astype("uint8")


def _best_cut(nh: np.ndarray, sh: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best gain of each node and the last bin that goes left, from the weights and sums of its bins."""
    nl, sl = np.cumsum(nh, axis=1)[:, :-1], np.cumsum(sh, axis=1)[:, :-1]
    nr, sr = n[:, None] - nl, s[:, None] - sl
    both = (nl > 0) & (nr > 0)
    gain = np.where(both, sl * sl / np.where(both, nl, 1) + sr * sr / np.where(both, nr, 1) - (s * s / n)[:, None], 0.0)
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(n)), at]
    return np.where(top > 1e-12 * n, top, 0.0), at


def _tried(rng: np.random.Generator, nodes: int, n_features: int) -> np.ndarray:
    return np.argsort(rng.random((nodes, n_features)), axis=1)[:, :math.ceil(n_features / 3)]


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int, rng: np.random.Generator) -> dict:
    """One tree, level by level: ``feature`` (-1: leaf) and ``bin`` of each node's
    split (at most that bin goes left), ``left`` child (the right one follows),
    ``value``, and the gain of each feature (``importance``)."""
    n_features = x.shape[1]
    importance = np.zeros(n_features)
    levels, node, k, after = [], np.zeros(len(y), "int64"), 1, 1
    for depth in range(max_depth + 1):
        n, s = np.bincount(node, w, k), np.bincount(node, w * y, k)
        best, feature, cut = np.zeros(k), np.full(k, -1, "int8"), np.zeros(k, "uint8")
        if depth < max_depth:
            tried = _tried(rng, k, n_features)
            for j in range(tried.shape[1]):
                f = tried[:, j]
                key = node * _BINS + x[np.arange(len(y)), f[node]]
                top, at = _best_cut(np.bincount(key, w, k * _BINS).reshape(k, _BINS),
                                    np.bincount(key, w * y, k * _BINS).reshape(k, _BINS), n, s)
                better = top > best
                best, feature, cut = np.where(better, top, best), np.where(better, f, feature), np.where(better, at, cut)
        split = feature >= 0
        np.add.at(importance, feature[split], best[split])
        left = np.where(split, after + 2 * (np.cumsum(split) - split), 0)
        levels.append((feature.astype("int8"), cut.astype("uint8"), left.astype("int32"), s / n))
        if not split.any():
            break
        keep = split[node]
        x, y, w, node = x[keep], y[keep], w[keep], node[keep]
        right = x[np.arange(len(y)), feature[node]] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        k = 2 * int(split.sum())
        after += k
    parts = [np.concatenate(a) for a in zip(*levels)]
    return dict(zip(("feature", "bin", "left", "value"), parts)) | {"importance": importance}


def _descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, open_ = np.zeros(len(x), "int64"), np.arange(len(x))
    while len(open_ := open_[feature[at[open_]] >= 0]):
        here = at[open_]
        at[open_] = left[here] + (x[open_, feature[here]] > cut[here])
    return at


def _by_value(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and where it stands."""
    order = np.argsort(ids, kind="stable")
    found, first = np.unique(ids[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


class _Top:
    """The upper part of a tree: nodes, those still to be split over the whole
    table (``open``), and those no task has to grow (``closed``: node -> value)."""

    def __init__(self, tree: int, seed: int, is_open: bool, n_features: int):
        self.tree, self.rng = tree, np.random.default_rng([seed, tree, 0])
        self.feature, self.bin, self.left, self.depth = [-1], [0], [0], [0]
        self.open, self.closed, self.importance = [0] if is_open else [], {}, np.zeros(n_features)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, "int8"), np.array(self.bin, "uint8"), np.array(self.left, "int32")

    def split(self, tried: np.ndarray, sums: dict[int, np.ndarray], max_depth: int) -> None:
        """One level: ``sums`` has (features tried, weight and sum, bins) of each open node."""
        opened = []
        for i, node in enumerate(self.open):
            h = sums[node]
            n, s = h[0].sum(axis=1)
            gains, cuts = _best_cut(h[:, 0], h[:, 1], np.full(len(h), n), np.full(len(h), s))
            j = int(gains.argmax())
            if gains[j] <= 0 or self.depth[node] >= max_depth:
                self.closed[node] = s / n
                continue
            f, cut = int(tried[i, j]), int(cuts[j])
            self.importance[f] += gains[j]
            self.feature[node], self.bin[node], self.left[node] = f, cut, len(self.feature)
            in_left = h[j, 0, :cut + 1].sum()
            for rows in (in_left, n - in_left):
                if rows > _LOCAL_ROWS:
                    opened.append(len(self.feature))
                self.feature.append(-1)
                self.bin.append(0)
                self.left.append(0)
                self.depth.append(self.depth[node] + 1)
        self.open = opened


def _node_sums(blocks: DataFrame, tops: list[_Top], tried: dict[int, np.ndarray], seed: int, k: int) -> dict:
    """(tree, open node) -> weights and sums of the bins of the features tried there."""
    trees = {t.tree: (t.arrays(), t.open) for t in tops if t.open}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = {t: np.zeros((len(open_), tried[t].shape[1], 2, _BINS)) for t, (_, open_) in trees.items()}
        for pdf in batches:
            for block in pdf.itertuples():
                row, y = np.frombuffer(block.row, "int64"), np.frombuffer(block.y)
                x = np.frombuffer(block.x, "uint8").reshape(len(y), k)
                for t, (top, open_) in trees.items():
                    w = _weights(row, t, seed)
                    drawn = np.flatnonzero(w)
                    place = np.full(len(top[0]), -1)
                    place[open_] = np.arange(len(open_))
                    node = place[_descend(x[drawn], *top)]
                    drawn, node = drawn[node >= 0], node[node >= 0]
                    wd = w[drawn].astype("float64")
                    wy, size = wd * y[drawn], len(open_) * _BINS
                    for j in range(tried[t].shape[1]):
                        key = node * _BINS + x[drawn, tried[t][node, j]]
                        got[t][:, j, 0] += np.bincount(key, wd, size).reshape(-1, _BINS)
                        got[t][:, j, 1] += np.bincount(key, wy, size).reshape(-1, _BINS)
        for t, (_, open_) in trees.items():
            yield pd.DataFrame({"tree": t, "node": open_, "sums": [a.tobytes() for a in got[t]]}).astype(
                {"tree": "int32", "node": "int32"})

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [key[0]], "node": [key[1]],
                             "sums": [sum(np.frombuffer(b) for b in pdf["sums"]).tobytes()]})

    schema = "tree int, node int, sums binary"
    found = blocks.mapInPandas(part, schema).groupBy("tree", "node").applyInPandas(whole, schema).collect()  # a row per open node
    return {(r["tree"], r["node"]): np.frombuffer(r["sums"]).reshape(-1, 2, _BINS) for r in found}


def _grown(blocks: DataFrame, tops: list[_Top], max_depth: int, seed: int, k: int) -> DataFrame:
    """Each tree below its top: a row per node that one task grows, with the tree from there on."""
    trees = {t.tree: (t.arrays(), t.closed) for t in tops}
    depth = {t.tree: t.depth for t in tops}

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf.itertuples():
                row, y = np.frombuffer(block.row, "int64"), np.frombuffer(block.y)
                x = np.frombuffer(block.x, "uint8").reshape(len(y), k)
                for t, (top, closed) in trees.items():
                    w = _weights(row, t, seed)
                    drawn = np.flatnonzero(w)
                    out = [(t, node, x[at].tobytes(), y[at].tobytes(), w[at].tobytes())
                           for node, p in _by_value(_descend(x[drawn], *top)) if node not in closed for at in (drawn[p],)]
                    if out:
                        yield pd.DataFrame(out, columns=["tree", "node", "x", "y", "w"])

    def grown(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(key[0]), int(key[1])
        x = np.frombuffer(b"".join(pdf["x"]), "uint8").reshape(-1, k)
        y, w = np.frombuffer(b"".join(pdf["y"])), np.frombuffer(b"".join(pdf["w"]), "uint8").astype("float64")
        rng = np.random.default_rng([seed, tree, node] if node else [seed, tree])
        t = grow_tree(x, y, w, max_depth - depth[tree][node], rng)
        return pd.DataFrame([{"tree": key[0], "node": key[1], **{c: v.tobytes() for c, v in t.items()}}])

    pieces = blocks.mapInPandas(dealt, "tree int, node int, x binary, y binary, w binary")
    tasks = sum(t.feature.count(-1) for t in tops)
    return pieces.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(grown, _TREE)


@dataclass(frozen=True)
class Forest:
    features: list[str]
    points: list[np.ndarray]
    tops: dict[int, tuple[np.ndarray, ...]]  # tree -> feature, bin, left of its upper part
    path: str  # table of the trees below, a row per (tree, leaf of the upper part)
    importances: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the mean of the trees. Rows go to the trees: what is
        moved grows with the rows to predict, not with the forest. Equal binned rows
        are predicted once; they travel in buckets of about ``_BUCKET_ROWS``."""
        points, tops, k = self.points, self.tops, len(self.features)

        @F.pandas_udf("binary")
        def binned(pdf: pd.DataFrame) -> pd.Series:
            return pd.Series([r.tobytes() for r in _binned(_doubles(pdf, k), points)], dtype=object)

        scored = df.withColumn("_x", binned(F.struct(*as_doubles(self.features))))
        buckets = max(1, math.ceil(df.count() / _BUCKET_ROWS))
        keys = scored.select("_x", F.pmod(F.xxhash64("_x"), F.lit(buckets)).alias("b")).distinct()

        def routed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(sorted(pdf["_x"])), "uint8").reshape(-1, k)
            return pd.DataFrame([(key[0], t, node, p.astype("int32").tobytes(), x[p].tobytes())
                                 for t, top in tops.items() for node, p in _by_value(_descend(x, *top))],
                                columns=["b", "tree", "node", "at", "x"])

        def valued(key: tuple, pdf: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame({"b": [], "tree": [], "at": [], "value": []})
            feature, cut, left, value = (np.frombuffer(below[c].iloc[0], t) for c, t in _KINDS.items())
            return pd.DataFrame({"b": pdf["b"], "tree": pdf["tree"], "at": pdf["at"], "value": [
                value[_descend(np.frombuffer(x, "uint8").reshape(-1, k), feature, cut, left)].tobytes() for x in pdf["x"]]})

        def mean(key: tuple, pdf: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
            x, total = sorted(pdf["_x"]), np.zeros(len(pdf))
            for r in values.sort_values("tree").itertuples():
                total[np.frombuffer(r.at, "int32")] += np.frombuffer(r.value)
            return pd.DataFrame({"_x": x, "prediction": total / len(tops)})

        pieces = keys.groupBy("b").applyInPandas(routed, "b long, tree int, node int, at binary, x binary")
        below = df.sparkSession.read.schema(_TREE).parquet(self.path)
        values = pieces.groupBy("tree", "node").cogroup(below.groupBy("tree", "node")).applyInPandas(
            valued, "b long, tree int, at binary, value binary")
        predicted = keys.groupBy("b").cogroup(values.groupBy("b")).applyInPandas(mean, "_x binary, prediction double")
        return scored.join(predicted, "_x").select(*df.columns, "prediction")


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 100, max_depth: int = 30,
               seed: int = 42) -> Forest:
    """A forest fitted on all rows of ``df``, with one binned copy of it persisted
    meanwhile. Nodes below the tops are written to the checkpoint folder."""
    spark, k = df.sparkSession, len(features)
    points = table_split_points(df, features)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_blocks(batches, _BLOCK_ROWS):
            yield pd.DataFrame({"n": [len(pdf)], "row": [pdf["row"].to_numpy("int64").tobytes()],
                                "x": [_binned(_doubles(pdf, k), points).tobytes()],
                                "y": [pdf["y"].to_numpy("float64", na_value=np.nan).tobytes()]})

    # By what identifies a row, not by features: their last digits depend on the order of a sum.
    row = F.xxhash64(*[c for c in df.columns if c not in features], F.lit(1))
    blocks = df.select(row.alias("row"), *as_doubles(features), F.col(label).cast("double").alias("y")).mapInPandas(
        packed, "n long, row binary, x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
    path, tops = scratch_path(spark, f"models/forest-{uuid.uuid4().hex}"), []
    try:
        n = blocks.agg(F.sum("n")).first()[0]
        if not n:
            raise ValueError("no rows to fit a forest on")
        size = max(1, min(trees, _GROUP_DRAWS // n))
        for first in range(0, trees, size):
            group = [_Top(t, seed, n > _LOCAL_ROWS, k) for t in range(first, min(first + size, trees))]
            while any(t.open for t in group):
                tried = {t.tree: _tried(t.rng, len(t.open), k) for t in group if t.open}
                sums = _node_sums(blocks, group, tried, seed, k)
                for t in group:
                    if t.open:
                        t.split(tried[t.tree], {m: sums[t.tree, m] for m in t.open}, max_depth)
            _grown(blocks, group, max_depth, seed, k).write.mode("append").parquet(path)
            _append_closed(spark, group, path, k)
            tops += group
    finally:
        blocks.unpersist()
    gains = {t.tree: t.importance for t in tops}
    parts = spark.read.schema(_TREE).parquet(path).select("tree", "node", "importance").collect()  # k numbers a part
    if not parts:
        raise ValueError("no rows to fit a forest on")
    for r in sorted(parts):
        gains[r["tree"]] = gains[r["tree"]] + np.frombuffer(r["importance"])
    mean = sum((g / g.sum() for g in gains.values() if g.sum() > 0), np.zeros(k))
    grown = {r["tree"] for r in parts}  # of a few rows a tree may have drawn none
    return Forest(list(features), points, {t.tree: t.arrays() for t in tops if t.tree in grown}, path,
                  (mean / (mean.sum() or 1.0)).tolist())


def _append_closed(spark: SparkSession, tops: list[_Top], path: str, k: int) -> None:
    leaf = [np.array([v], t) for v, t in ((-1, "int8"), (0, "uint8"), (0, "int32"))]
    rows = [(t.tree, node, *[a.tobytes() for a in leaf], np.array([value], "float64").tobytes(), np.zeros(k).tobytes())
            for t in tops for node, value in t.closed.items()]
    if rows:
        spark.createDataFrame(rows, _TREE).coalesce(1).write.mode("append").parquet(path)
