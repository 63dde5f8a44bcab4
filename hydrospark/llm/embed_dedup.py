"""Embedding near-duplicates by product quantisation.

Unit vectors are kept in inverted lists by their nearest coarse centroid, as
subspace codes of the residual. Two vectors within the link distance r of each
other lie on both sides of the boundary of their lists, at distances that add
up to r at most, so one of them is within r / 2 of it. A query therefore visits
the lists whose boundary is within r / 2 (sufficient by construction), compares
by asymmetric table-lookup distances and confirms what is left by exact cosine
in double precision. Of the two visits that may find a pair the one from the
vector nearer to the boundary counts, for both vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import cut_lineage
from hydrospark.llm.components import connected_components

_SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dim
    codebooks: np.ndarray  # parts x codes x (dim / parts)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c * c).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        out[lo:lo + 4096] = (half - x[lo:lo + 4096] @ c.T).argmin(axis=1)
    return out


def _parts(dim: int, wanted: int) -> int:
    return next(p for p in range(min(wanted, dim), 0, -1) if dim % p == 0)


def fit_index(x: np.ndarray, lists: int, parts: int = 8, codes: int = 64, rounds: int = 8, seed: int = 5) -> Index:
    """Coarse centroids and residual codebooks from a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(x, lists, rounds, rng)
    res = x - centroids[_nearest(x, centroids)]
    m = _parts(x.shape[1], parts)
    books = [_kmeans(r, codes, rounds, rng) for r in np.split(res, m, axis=1)]
    return Index(centroids, np.stack(books))


def encode(index: Index, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual codes per subspace and each vector's quantisation error."""
    res = x - index.centroids[home]
    pieces = np.split(res, len(index.codebooks), axis=1)
    codes = np.stack([_nearest(r, b) for r, b in zip(pieces, index.codebooks, strict=True)], axis=1)
    back = np.concatenate([b[codes[:, i]] for i, b in enumerate(index.codebooks)], axis=1)
    return codes.astype(np.uint8), np.linalg.norm(res - back, axis=1)


def side(index: Index, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance of each row, in list ``own``, from the boundary with list ``other``."""
    a, b = index.centroids[own], index.centroids[other]
    gap = a - b
    return (np.einsum("ij,ij->i", gap, x) - ((a * a).sum(axis=1) - (b * b).sum(axis=1)) / 2) / np.sqrt(
        (gap * gap).sum(axis=1))


def centroid_gaps(index: Index) -> np.ndarray:
    """Distances between the coarse centroids."""
    c = index.centroids
    sq = (c * c).sum(axis=1)
    return np.sqrt(np.maximum(sq[:, None] - 2 * c @ c.T + sq, 0))


def probes(index: Index, x: np.ndarray, home: np.ndarray, reach: float, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every row's own list and all lists with a boundary within ``reach``."""
    c = index.centroids
    sq = (c * c).sum(axis=1)
    rows, lists = [], []
    for lo in range(0, len(x), 1024):
        own = home[lo:lo + 1024]
        d2 = sq - 2 * x[lo:lo + 1024] @ c.T  # without the row's own norm
        near = d2 - d2[np.arange(len(own)), own][:, None] <= 2 * (reach + _SLACK) * gaps[own] + _SLACK
        near[np.arange(len(own)), own] = True
        r, li = np.nonzero(near)
        rows.append(r + lo)
        lists.append(li)
    return np.concatenate(rows), np.concatenate(lists)


def cell_matches(index: Index, cell: int, q: np.ndarray, y: np.ndarray, codes: np.ndarray, errors: np.ndarray,
                 min_cosine: float):
    """Yields (query rows, member rows) with cosine >= ``min_cosine`` in one list.

    The distance from a query to a member's reconstruction is a sum of table
    entries; it is at most radius + the member's own error for any match, so
    nothing is lost by that filter. The rerank is exact.
    """
    radius = np.sqrt(max(0.0, 2 - 2 * min_cosine))
    m = len(index.codebooks)
    # The slack covers the single precision of the tables, whose sums are at most about 4.
    limit = ((radius + errors + _SLACK) ** 2 + 1e-5)[:, None]
    for lo in range(0, len(q), 512):
        part = q[lo:lo + 512]
        res = np.split(part - index.centroids[cell], m, axis=1)
        d2 = np.zeros((len(y), len(part)), dtype=np.float32)
        for k, book in enumerate(index.codebooks):
            table = (res[k] ** 2).sum(axis=1) - 2 * book @ res[k].T + (book * book).sum(axis=1)[:, None]
            d2 += np.take(table.astype(np.float32), codes[:, k], axis=0)
        b, a = np.nonzero(d2 <= limit)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for s in range(0, len(a), 1 << 18):
            i, j = a[s:s + (1 << 18)], b[s:s + (1 << 18)]
            ok = np.einsum("ij,ij->i", part[i], y[j]) >= min_cosine
            yield i[ok] + lo, j[ok]


def _unit_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec, emb: the components as doubles, u: unit vector bytes or null)."""
    import pyarrow as pa

    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("emb"))

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                unit = None
                if v and None not in v:
                    x = np.array(v, dtype=np.float64)
                    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                    if top > 0:
                        x = x / top  # no overflow in the norm
                        unit = (x / np.linalg.norm(x) + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec", "u"])

    return base.mapInArrow(run, "vec long, u binary")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     min_cosine: float = 0.95, sample_rows: int = 65_536, list_rows: int | None = None,
                     max_lists: int = 4096, cell_rows: int = 4096) -> DataFrame:
    """One row per vector: the id, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable) and ``kept``.

    Two vectors link if the cosine of their double components is at least
    ``min_cosine``. Null or zero vectors, empty ones and those with null or
    non-finite components link with nothing and are their own component, as
    are vectors of another dimension than the compared ones (each dimension is
    indexed apart). Repeated rows link with each other. A null id links but
    names no component while the component has another id. Other columns are
    ignored. An empty table gives an empty result.

    The index has lists of about ``list_rows`` vectors; by default their number
    grows with the root of the input, sqrt(n) / 4: a visit costs a table whatever
    the list's length, so longer lists cost no more work and far fewer visits. At
    most ``max_lists`` lists (reached at 268 million vectors by default); beyond,
    lists only get longer and the work grows with the square. The index is
    fitted on a sample of about ``sample_rows`` unit vectors, chosen by hash;
    every vector is indexed. Equal unit vectors are one row with a count. A list with more than
    ``cell_rows`` members is dealt into blocks compared by different tasks. Each
    cell returns per query its number of links and at most one spanning link
    per vector, never all pairs.
    """
    units = cut_lineage(_unit_rows(vectors, id_col, vec_col))
    reps = cut_lineage(units.where("u is not null").groupBy("u").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    dims = [r[0] for r in reps.select(F.octet_length("u")).distinct().limit(1025).collect()]
    if len(dims) > 1024:
        raise ValueError("over 1024 different dimensions")
    parts = [_linked(reps.where(F.octet_length("u") == d), min_cosine, sample_rows, list_rows, max_lists, cell_rows)
             for d in dims]
    empty = vectors.sparkSession.createDataFrame([], "x long, y long, c long")
    out = empty
    for p in parts:
        out = out.union(p)
    out = cut_lineage(out)  # x: a representative; y: one linked to it; c: count of linked vectors (with y null)
    roots = connected_components(out.where("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = out.where("y is null").groupBy("x").agg(F.sum("c").alias("others")).withColumnRenamed("x", "rep")
    member = (reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
              .select("u", "least", F.coalesce("root", "rep").alias("root"),
                      (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    member = cut_lineage(member)
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    named = member.join(least, "root").select("u", "n_links", "component")
    done = units.join(named, "u", "left")
    component = F.coalesce("component", "vec")
    return done.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"), F.col("vec").eqNullSafe(component).alias("kept"))


def _linked(reps: DataFrame, min_cosine: float, sample_rows: int, list_rows: int | None, max_lists: int,
            cell_rows: int) -> DataFrame:
    import pandas as pd
    import pyarrow as pa

    total = reps.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = reps.where(F.pmod(F.xxhash64("u"), F.lit(1 << 30)) < int((1 << 30) * share)).select("u").limit(
        2 * sample_rows).collect()
    x = np.stack([np.frombuffer(r["u"]) for r in sample] or [np.frombuffer(reps.first()["u"])])
    lists = total // list_rows if list_rows else int(np.sqrt(total) / 4)
    index = fit_index(x[np.lexsort(x.T)], max(1, min(max_lists, lists)))
    radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))

    def assign(batches):
        gaps = centroid_gaps(index)
        for b in batches:
            if not b.num_rows:
                continue
            u = np.stack([np.frombuffer(v.as_py()) for v in b.column(2)])
            home = _nearest(u, index.centroids)
            codes, errors = encode(index, u, home)
            row, lists = probes(index, u, home, radius / 2, gaps)
            is_home = lists == home[row]
            none = np.full(len(row), None, dtype=object)
            code_col = none.copy()
            code_col[is_home] = [codes[i].tobytes() for i in row[is_home]]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(lists), pa.array(home[row]), pa.array(is_home), b.column(0).take(take), b.column(1).take(take),
                b.column(2).take(take), pa.array(code_col.tolist(), pa.binary()), pa.array(errors[row])],
                names=["list", "own", "home", "rep", "n", "u", "code", "err"])

    placed = cut_lineage(reps.select("rep", "n", "u").mapInArrow(
        assign, "list long, own long, home boolean, rep long, n long, u binary, code binary, err double"))
    # One row per list: at most max_lists rows.
    sizes = placed.groupBy("list").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / cell_rows).cast("int").alias("ky"),
        F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("kq"))
    dealt = placed.join(F.broadcast(sizes), "list").where("ky > 0")
    block = F.xxhash64("rep")
    members = dealt.where("home").select(
        "list", F.pmod(block, "ky").cast("int").alias("by"), F.explode(F.sequence(F.lit(0), F.col("kq") - 1)).alias("bq"),
        F.lit(True).alias("member"), "own", "rep", "n", "u", "code", "err")
    queries = dealt.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("ky") - 1)).alias("by"), F.pmod(block, "kq").cast("int").alias("bq"),
        F.lit(False).alias("member"), "own", "rep", "n", "u",
        F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("err"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ms, qs = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(ms) or not len(qs):
            return pd.DataFrame({"x": [], "y": [], "c": []}).astype("Int64")
        y = np.stack([np.frombuffer(v) for v in ms["u"]])
        q = np.stack([np.frombuffer(v) for v in qs["u"]])
        codes = np.stack([np.frombuffer(v, dtype=np.uint8) for v in ms["code"]])
        yid, qid = ms["rep"].to_numpy(), qs["rep"].to_numpy()
        ny, nq, own, cell = ms["n"].to_numpy(), qs["n"].to_numpy(), qs["own"].to_numpy(), int(key[0])
        ids = np.unique(np.concatenate([yid, qid]))
        count = np.zeros(len(ids), dtype=np.int64)
        parent = np.arange(len(ids))
        ym, qm = np.searchsorted(ids, yid), np.searchsorted(ids, qid)

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in cell_matches(index, cell, q, y, codes, ms["err"].to_numpy(), min_cosine):
            first = qid[i] < yid[j]
            away = own[i] != cell
            if away.any():
                o, here = own[i[away]], np.full(int(away.sum()), cell)
                sx, sy = side(index, q[i[away]], o, here), side(index, y[j[away]], here, o)
                first[away] = (sx < sy) | (sx == sy) & first[away]
            i, j = i[first], j[first]
            np.add.at(count, qm[i], ny[j])
            np.add.at(count, ym[j], nq[i])
            # The pairs come by query; after a few queries a group has one parent.
            for rows in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                if not len(rows):
                    continue
                near, r = ym[j[rows]], find(qm[i[rows[0]]])
                for p in np.unique(parent[near]).tolist():
                    o = find(p)
                    if o != r:
                        parent[max(o, r)] = min(o, r)
                        r = min(o, r)
                parent[near] = r
        roots = np.array([find(i) for i in range(len(ids))])
        tree = np.flatnonzero(roots != np.arange(len(ids)))
        linked = np.flatnonzero(count)
        return pd.DataFrame({"x": pd.array(np.concatenate([ids[tree], ids[linked]]), "Int64"),
                             "y": pd.array([*ids[roots[tree]].tolist(), *[None] * len(linked)], "Int64"),
                             "c": pd.array([*[None] * len(tree), *count[linked].tolist()], "Int64")})

    return members.unionByName(queries).groupBy("list", "by", "bq").applyInPandas(compare, "x long, y long, c long")
