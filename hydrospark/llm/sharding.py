"""Sharding by a Feistel permutation of global row numbers.

Rows get their position in a stated order (``ordering.number_rows``). A Feistel
network over the smallest even number of bits that holds all positions permutes
them; a value beyond the last position is permuted again until it falls inside
(cycle walking), so the positions themselves are permuted. The permuted position
p gives shard ``p mod shards`` and slot ``p div shards``: shard sizes differ by
one row at most, slots have no gaps, and both can be computed from the row
number alone, as can the row number from (shard, slot).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.ordering import number_rows

ROUNDS = 6
_MIX = 0x45D9F3B
_M31 = (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    """Round keys of 31 bits from the seed."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") & _M31 for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of one half of the network's domain, the smallest 4**b >= n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _mix(x, key):
    """Round function on values below 2**31; products stay below 2**58."""
    x = (x ^ np.uint64(key)) & np.uint64(_M31)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(_MIX)) & np.uint64(_M31)
    return x ^ (x >> np.uint64(15))


def _network(x, bits, keys, back=False):
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> b, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << b) | right


def permute(rows, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permuted positions of ``rows`` (integers in 0 .. n-1, n up to 2**62),
    or with ``back`` the rows at these positions."""
    if n > 1 << 62:
        raise ValueError("at most 2**62 rows")
    bits, keys = half_bits(n), round_keys(seed)
    x = _network(np.asarray(rows, dtype=np.uint64), bits, keys, back)
    out = np.flatnonzero(x >= np.uint64(n))
    while len(out):
        x[out] = _network(x[out], bits, keys, back)
        out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def locate(rows, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slots, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Row numbers that stand at these slots of a shard."""
    return permute(np.asarray(slots, dtype=np.int64) * shards + shard, n, seed, back=True)


def shard_rows(df: DataFrame, order: list[str], shards: int = 8, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number`` (position sorted by ``order``, nulls first),
    ``shard`` and ``slot``.

    The result depends on the values in ``order`` and the seed alone, never on
    files or partitions; rows equal in all of ``order`` change places freely
    among themselves. Any number of rows is whole: null, empty and repeated
    values are ordinary, an empty table gives an empty result. Columns of ``df``
    called like the three results (in any letter case) are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    taken = {"row_number", "shard", "slot"}
    keep = [c for c in df.columns if c.lower() not in taken]
    if any(c not in keep for c in order):
        raise ValueError("order by columns other than row_number, shard and slot")
    numbered = number_rows(df.select(*[F.col(f"`{c}`") for c in keep]), *order)
    n = numbered.count()

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("_p", permuted("row_number"))
    return placed.withColumns({"shard": (F.col("_p") % shards).cast("int"),
                               "slot": F.expr(f"_p div {int(shards)}")}).drop("_p")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes shards as folders ``shard=k`` of Parquet files; a file holds at
    most ``rows_per_file`` slots in order, and runs of that many slots are dealt
    to tasks, so that no shard is one task."""
    run = F.expr(f"slot div {int(rows_per_file)}")
    files = sharded.repartition(F.col("shard"), run).sortWithinPartitions("shard", "slot")
    files.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
