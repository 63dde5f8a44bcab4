"""Exact selection of the k rows with the smallest hash, per class.

A row's rank is its hash of (id, seed), the same in every engine (MD5). The k-th
smallest hash of a class is found by refining a histogram: rows are counted per
class and leading bits, the bin that holds the k-th is split by the next bits,
and so on. Every step is one aggregate of at most 65,536 counts a class, nothing
is sorted and no class is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 60
_STEP = 16


def id_hash(id_col: Column | str, seed: int = 42) -> Column:
    """60 bits of MD5 of "id:seed" as a long; '0x' || substr(md5(...), 1, 15) in SQL."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def smallest_hashes(df: DataFrame, label: str, hash_col: str, wanted: dict) -> dict:
    """class -> largest hash among its ``wanted[class]`` smallest (-1 for none,
    the largest hash there is for all). Hashes that are equal at the cut are
    left out together where they do not all fit. Classes are few (labels)."""
    cuts = {c: -1 for c, k in wanted.items() if k <= 0}
    # class -> (leading bits so far, rows still wanted among those that share them)
    open_ = {c: (0, k) for c, k in wanted.items() if k > 0}
    seen = 0
    rows, kept = df.select(label, hash_col), None
    while open_ and seen < _BITS:
        step = min(_STEP, _BITS - seen)
        rest = _BITS - seen - step
        in_bin = F.lit(False)
        for c, (prefix, _) in open_.items():
            in_bin = in_bin | (F.col(label).eqNullSafe(F.lit(c)) & (F.shiftright(hash_col, _BITS - seen) == prefix))
        rows = rows.where(in_bin)
        if seen:
            rows = rows.persist()  # what shares the bits so far: two scans of the table in all
        counts = (rows.groupBy(label, F.shiftright(hash_col, rest).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                  .collect())  # at most 2**16 bins a class
        if kept is not None:
            kept.unpersist()
        kept = rows if seen else None
        by_class: dict = {}
        for r in counts:
            by_class.setdefault(r[label], []).append((r["bin"], r["n"]))
        for c, (prefix, k) in list(open_.items()):
            for b, n in sorted(by_class.get(c, [])):
                if n >= k:
                    if n == k:
                        cuts[c] = ((b + 1) << rest) - 1
                        del open_[c]
                    else:
                        open_[c] = (b, k)
                    break
                k -= n
            else:  # fewer rows than wanted
                cuts[c] = (1 << _BITS) - 1
                del open_[c]
        seen += step
    if kept is not None:
        kept.unpersist()
    for c, (prefix, _) in open_.items():
        cuts[c] = prefix - 1
    return cuts


def below_cut(label: str, hash_col: str, cuts: dict) -> Column:
    """Whether a row is among the selected ones of its class."""
    out = F.lit(False)
    for c, cut in cuts.items():
        out = out | (F.col(label).eqNullSafe(F.lit(c)) & (F.col(hash_col) <= cut))
    return out


def stratified_test_counts(counts: dict, test_fraction: float) -> dict:
    """Test rows per class: ceil(fraction * n) in all; the training rows are
    shared out in proportion, what is left over goes to the largest remainders
    (of equal ones to the smaller class)."""
    import math
    n = sum(counts.values())
    n_train = n - math.ceil(test_fraction * n)
    train = {c: m * n_train // n for c, m in counts.items()}
    left = n_train - sum(train.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * n_train % n), str(c)))[:left]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def sample_per_class(df: DataFrame, label: str, id_col: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` rows of each class, those with the smallest hashes: all
    rows of smaller classes, a uniform sample of larger ones, the same however
    the data is dealt."""
    d = df.withColumn("_h", id_hash(id_col, seed))
    classes = [r[label] for r in df.select(label).distinct().collect()]
    return d.where(below_cut(label, "_h", smallest_hashes(d, label, "_h", {c: rows for c in classes}))).drop("_h")
