"""Ordered per-device computations that do not put a whole device in one task.

A naive ``Window.partitionBy("device_id").orderBy("ts")`` sends every row of a
device to one task; a device holding a third of the fleet's rows would then be
a third of the job in a single task. Instead, rows are cut into
``(device_id, time bucket)`` window partitions and the few facts that cross a
bucket boundary are carried separately:

* **Halo** (``with_halo``): for row-offset frames (lag *n*, rolling *n* rows)
  a carried count numbers the rows of a device, blocks of equal row counts
  become the window partitions, and the last *n* rows of a block are copied to
  the next one. After the window runs, the copies are dropped.
* **Carry** (``prefix``, ``with_carry``): for unbounded frames (running sums,
  last non-null value, small state machines) each bucket is summarised to one
  row, the summary is scanned per device (one row per bucket, so small) and the
  carried value is joined back.

The input is read twice, once for the narrow summary. A carry shuffles the big
side once on ``(keys, _bkt)``, a halo once more on the blocks. Summary joins are left to AQE, which broadcasts them only when their
measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BKT = "_bkt"
HALO = "_halo"

# Bucket width: a device's rows inside one bucket are processed by one task.
# At a 5 s reporting cadence an hour is 720 rows per device. ``"auto"`` picks
# the coarsest of day/hour/minute/second that keeps every bucket under
# ``Order.target_rows`` (one extra aggregate per ordered operator).
DEFAULT_BUCKET_UNIT = "hour"


@dataclass(frozen=True)
class Order:
    """How rows are ordered: per ``keys``, by ``order`` (ties already broken)."""

    keys: Sequence[str] = ("device_id",)
    order: Sequence[str] = ("ts", "reading_id")
    ts: str = "ts"
    unit: str = DEFAULT_BUCKET_UNIT
    # Custom bucket expression (must be monotone in ``order``), e.g. for a
    # reversed stream ordered by negated time.
    bucket_fn: Callable[[], Column] | None = None
    # unit="auto": largest number of rows one (key, bucket) may hold.
    target_rows: int = 2_000_000
    # Rows of a halo block: what one window partition of a halo operator holds.
    block_rows: int = 8192

    def window(self) -> Window:
        return Window.partitionBy(*self.keys, BKT).orderBy(*self.order)

    def window_desc(self) -> Window:
        return Window.partitionBy(*self.keys, BKT).orderBy(*[F.col(c).desc() for c in self.order])

    def bucket(self) -> Column:
        if self.bucket_fn is not None:
            return self.bucket_fn()
        return F.date_trunc(self.unit, F.col(self.ts))


DEVICE_ORDER = Order()


AUTO_UNITS = ("day", "hour", "minute", "second")


def resolve_unit(df: DataFrame, o: Order) -> str:
    """Coarsest bucket unit whose fullest (key, bucket) holds at most
    ``o.target_rows`` rows. One aggregate: rows per (key, minute), rolled up
    to hour and day maxima; only the three maxima reach the driver."""
    per_min = df.groupBy(*o.keys, F.date_trunc("minute", F.col(o.ts)).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    per_hour = per_min.groupBy(*o.keys, F.date_trunc("hour", "_m").alias("_h")).agg(
        F.sum("_n").alias("_n"), F.max("_n").alias("_max_min"))
    per_day = per_hour.groupBy(*o.keys, F.date_trunc("day", "_h")).agg(
        F.sum("_n").alias("_n"), F.max("_n").alias("_max_hour"), F.max("_max_min").alias("_max_min"))
    m = per_day.agg(F.max("_n").alias("day"), F.max("_max_hour").alias("hour"),
                    F.max("_max_min").alias("minute")).first()
    for unit in AUTO_UNITS[:3]:
        if (m[unit] or 0) <= o.target_rows:
            return unit
    return "second"


def with_bucket(df: DataFrame, o: Order = DEVICE_ORDER) -> DataFrame:
    if BKT in df.columns:
        return df
    if o.unit == "auto" and o.bucket_fn is None:
        return df.withColumn(BKT, F.date_trunc(resolve_unit(df, o), F.col(o.ts)))
    return df.withColumn(BKT, o.bucket())


def with_halo(df: DataFrame, n: int, o: Order = DEVICE_ORDER) -> DataFrame:
    """Rows in blocks plus, per block, copies of the ``n`` preceding rows.

    Every row gets its position in the device's order (one carried count), a
    block is a run of ``o.block_rows`` positions, at least ``16 * n``, and the
    last ``n`` rows of a block are dealt to the next one as well. So the copies
    are at most a sixteenth of the input whatever the density of the rows, and
    no join finds them. Adds ``_bkt`` (the block) and ``_halo`` (true on the
    copies); windows over ``o.window()`` see ``n`` rows of history at every
    block start.
    """
    if n <= 0:
        return with_bucket(df, o).withColumn(HALO, F.lit(False))
    size = max(o.block_rows, 16 * n)
    pos = prefix(df, o, sums={"_pos": F.lit(1).cast("long")}, inclusive=False).drop(BKT)
    block = F.floor(F.col("_pos") / size)
    own = F.struct(block.alias(BKT), F.lit(False).alias(HALO))
    after = F.struct((block + 1).alias(BKT), F.lit(True).alias(HALO))
    dealt = F.when(F.col("_pos") % size >= size - n, F.array(own, after)).otherwise(F.array(own))
    return pos.select(*[c for c in pos.columns if c != "_pos"], F.explode(dealt).alias("_b")) \
        .select("*", f"_b.{BKT}", f"_b.{HALO}").drop("_b")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO)


def prefix(df: DataFrame, o: Order = DEVICE_ORDER, sums: dict[str, Column] | None = None,
           lasts: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Running sums and last non-null values over each device's whole history.

    ``sums``/``lasts`` map an output name to a column expression. ``inclusive``
    chooses whether the current row counts (frame ends at the current row) or
    not (frame ends one row before). Adds ``_bkt``; no halo needed.
    """
    sums = sums or {}
    lasts = lasts or {}
    base = with_bucket(df, o)
    tmp = {f"_s_{k}": v for k, v in sums.items()}
    tmp.update({f"_l_{k}": v for k, v in lasts.items()})
    base = base.select("*", *[v.alias(k) for k, v in tmp.items()])
    order_struct = F.struct(*o.order)
    aggs = [F.sum(f"_s_{k}").alias(f"_bs_{k}") for k in sums]
    aggs += [F.max_by(F.col(f"_l_{k}"), F.when(F.col(f"_l_{k}").isNotNull(), order_struct)).alias(f"_bl_{k}")
             for k in lasts]
    summary = base.groupBy(*o.keys, BKT).agg(*aggs)
    ws = Window.partitionBy(*o.keys).orderBy(BKT).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *o.keys, BKT,
        *[F.coalesce(F.sum(f"_bs_{k}").over(ws), F.lit(0)).alias(f"_cs_{k}") for k in sums],
        *[F.last(f"_bl_{k}", ignorenulls=True).over(ws).alias(f"_cl_{k}") for k in lasts],
    )
    joined = base.join(carry, [*o.keys, BKT], "left")
    end = 0 if inclusive else -1
    w = o.window().rowsBetween(Window.unboundedPreceding, end)
    out = joined.select(
        *[c for c in base.columns if c not in tmp],
        *[(F.coalesce(F.sum(f"_s_{k}").over(w), F.lit(0)) + F.col(f"_cs_{k}")).alias(k) for k in sums],
        *[F.coalesce(F.last(f"_l_{k}", ignorenulls=True).over(w), F.col(f"_cl_{k}")).alias(k) for k in lasts],
    )
    return out


def with_carry(df: DataFrame, o: Order, local: Callable[[DataFrame, Window], DataFrame], summary: Sequence[Column],
               scan: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """Rows with in-bucket columns and the state that earlier buckets hand on.

    ``local(rows, window)`` adds columns that need the rows of one bucket only,
    ``summary`` aggregates them to one row per bucket, and ``scan(summaries,
    window)`` turns these, per key and by bucket, into the state before each
    bucket. The summary runs on the same partitioning as the in-bucket windows,
    so it needs no shuffle of its own. Adds ``_bkt``.
    """
    rows = local(with_bucket(df, o), o.window())
    totals = rows.groupBy(*o.keys, BKT).agg(*summary)
    carry = scan(totals, Window.partitionBy(*o.keys).orderBy(BKT))
    return rows.join(carry, [*o.keys, BKT], "left")
