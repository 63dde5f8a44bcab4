"""Positions and running values that put no key's rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.llm.common import cut_lineage


def number_rows(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """``df`` with the positions 0, 1, ... of its rows sorted by ``order``
    (nulls first). Rows are dealt by range, and rows equal in all of ``order``
    are dealt by a tie number, so a very frequent key is spread over many tasks;
    such rows are numbered in any order. A column called ``name`` is replaced. One count a partition reaches the
    driver. The sorted rows are checkpointed, so positions survive a lost
    executor. An empty table stays empty.
    """
    # The row in one struct, so that its columns may have any names.
    keys = [F.col("row").getField(c).asc_nulls_first() for c in order]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]).alias("row"),
                     F.monotonically_increasing_id().alias("tie"))
    placed = cut_lineage(rows.repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, F.col("tie"))
                         .select("row"))
    counts = sorted((r["part"], r["n"]) for r in
                    placed.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    # A row a partition: bounded by the number of partitions.
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, start long"))
    # The upper bits of the id are the partition, the lower 33 the place in it.
    at = placed.withColumn("place", F.monotonically_increasing_id())
    return (at.withColumn("part", F.shiftright("place", 33).cast("int")).join(start, "part")
            .select("row.*", (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)))


def running(df: DataFrame, key: str, pos: str, values: dict[str, tuple[Callable, Column, Callable]],
            block_rows: int = 4096) -> DataFrame:
    """``df`` with inclusive running aggregates per ``key`` in the order of the
    integer ``pos``: name -> (aggregate, column, combine of two partial values).

    Blocks of ``block_rows`` positions are the window partitions; what stands
    before a block is aggregated from one row a block, so a key that holds a
    third of all rows is no task of its own. Positions of a key must differ. A
    null key is a key of its own.
    """
    d = df.withColumn("_blk", F.floor(F.col(pos) / block_rows)).withColumns({f"_v_{n}": v[1] for n, v in values.items()})
    blocks = d.groupBy(key, "_blk").agg(*[v[0](f"_v_{n}").alias(f"_b_{n}") for n, v in values.items()])
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(F.col(key).alias("_ckey"), F.col("_blk").alias("_cblk"),
                          *[v[0](f"_b_{n}").over(before).alias(f"_c_{n}") for n, v in values.items()])
    inner = Window.partitionBy(key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    joined = d.join(carry, F.col(key).eqNullSafe(F.col("_ckey")) & (F.col("_blk") == F.col("_cblk")))
    out = {}
    for n, (agg, _, combine) in values.items():
        own = agg(f"_v_{n}").over(inner)
        out[n] = F.when(F.col(f"_c_{n}").isNull(), own).otherwise(combine(F.col(f"_c_{n}"), own))
    return joined.withColumns(out).select(*df.columns, *values)
