"""Greedy cooldown ("keep an alert unless one was kept for the same key
less than ``cooldown`` ago").

The decision for each alert depends on the previously *kept* one, so it is
not a window frame. Sequential folding would put a continuously alerting key
in one task. Instead:

1. ``next(x)`` = first alert of the same key at or after ``ts(x) + cooldown``
   (an as-of forward lookup, done as a carried value over the key's stream in
   reverse order: bucketed, no range join).
2. The kept alerts are exactly ``first, next(first), next(next(first)), ...``.
   They are marked by pointer doubling: ``J0 = next``, ``J(k+1) = J(k) o J(k)``
   and ``S(k+1) = S(k) + J(k)(S(k))``, one equi-join per step, log2(chain
   length) steps, chains starting at every burst head (see ``throttle``).
   Every step is a hash join on (key, alert id), so no key is ever confined
   to one task. Lineage is cut with ``checkpoint()`` at every step (into
   ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.ordered import BKT, Order, prefix

_BUCKET_US = 3600 * 1_000_000


def _rev_order(keys) -> Order:
    # Reverse time order: negated microseconds, bucketed by hour.
    return Order(keys=tuple(keys), order=("_neg_us", "_kind", "_neg_seq"), ts="_neg_us",
                 bucket_fn=lambda: F.floor(F.col("_neg_us") / F.lit(_BUCKET_US)))


def next_after(alerts: DataFrame, keys) -> DataFrame:
    """(keys..., _seq, _nxt, _nxt_head): for each alert the first same-key
    alert at or after its ts + cooldown (null if none) and whether that alert
    starts a burst. ``alerts`` carries ``_seq`` (per-key position), ``_head`` and
    ``_cool`` (the key's cooldown in microseconds)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    a = alerts.select(*keys, "_seq", "_head", "_cool", us.alias("_us"))
    targets = a.select(*keys, (-F.col("_us")).alias("_neg_us"), F.lit(0).alias("_kind"),
                       (-F.col("_seq")).alias("_neg_seq"),
                       F.struct(F.col("_seq").alias("seq"), F.col("_head").alias("head")).alias("_tgt"),
                       F.lit(None).cast("long").alias("_probe"))
    probes = a.select(*keys, (-(F.col("_us") + F.col("_cool"))).alias("_neg_us"),
                      F.lit(1).alias("_kind"), (-F.col("_seq")).alias("_neg_seq"),
                      F.lit(None).cast("struct<seq:bigint,head:boolean>").alias("_tgt"),
                      F.col("_seq").alias("_probe"))
    s = prefix(targets.unionByName(probes), _rev_order(keys), lasts={"_nxt": F.col("_tgt")})
    return s.filter(F.col("_kind") == 1).select(*keys, F.col("_probe").alias("_seq"),
                                                F.col("_nxt.seq").alias("_nxt"), F.col("_nxt.head").alias("_nxt_head"))


def throttle(alerts: DataFrame, keys, cooldown_seconds: int | Column, order_cols=("ts",),
             sent: DataFrame | None = None) -> DataFrame:
    """Rows of ``alerts`` kept by the greedy cooldown, per ``keys``; a column as
    ``cooldown_seconds`` must have one value per key. ``sent``
    (keys, ts) holds the last alert kept before, at most as old as any row of its
    key; a later alert within its cooldown is not kept.

    ``order_cols`` (starting with ``ts``) break ties among equal timestamps,
    e.g. reading id and rule position.

    An alert at least ``cooldown`` after the previous alert of its key (a
    burst head) is always kept, whatever came before, and ``next`` of any
    alert is either in its own burst or the next burst's head. So chains start
    at every head and only jumps inside a burst are followed: the number of
    doubling rounds depends on the longest burst, not on the key's history.
    """
    from hydrospark.session import checkpoint_dir
    checkpoint_dir(alerts.sparkSession)  # the shared folder named by spark.checkpoint.dir
    keys = list(keys)
    if sent is not None:
        # The stored alert is the first row of its key, so a burst head and kept.
        earlier = sent.groupBy(*keys).agg(F.max("ts").alias("ts")).withColumn("_sent", F.lit(True))
        cool = cooldown_seconds if isinstance(cooldown_seconds, Column) else F.lit(cooldown_seconds)
        both = alerts.withColumns({"_sent": F.lit(False), "_seconds": cool}).unionByName(earlier, allowMissingColumns=True)
        if isinstance(cooldown_seconds, Column):
            # The stored row takes its key's cooldown.
            known = alerts.groupBy(*keys).agg(F.max(cool).alias("_of_key"))
            both = both.join(known, keys, "left").withColumn("_seconds", F.coalesce("_seconds", "_of_key", F.lit(0))) \
                .drop("_of_key")
            cooldown_seconds = F.col("_seconds")
        # Ties with an alert of the same time: the stored one first.
        both = both.withColumn("_after", F.when(F.col("_sent"), 0).otherwise(1))
        order_cols = (order_cols[0], "_after", *order_cols[1:])
        return throttle(both, keys, cooldown_seconds, order_cols).where("not _sent").drop("_sent", "_after", "_seconds")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cool = cooldown_seconds if isinstance(cooldown_seconds, Column) else F.lit(cooldown_seconds)
    # The carried count reads its input twice; what makes the alerts runs once.
    alerts = alerts.withColumn("_cool", cool.cast("long") * 1_000_000).checkpoint()
    numbered = prefix(alerts, Order(keys=tuple(keys), order=tuple(order_cols), ts="ts"),
                      sums={"_s0": F.lit(1).cast("long")}, lasts={"_prev_us": us}, inclusive=False).drop(BKT)
    numbered = numbered.withColumn("_seq", F.col("_s0") + 1) \
        .withColumn("_head", F.col("_prev_us").isNull()
                    | (us - F.col("_prev_us") >= F.col("_cool"))) \
        .drop("_s0", "_prev_us").checkpoint()
    nxt = next_after(numbered, keys)
    # Only rows that jump inside their burst; each round keeps fewer.
    jump = nxt.filter(~F.col("_nxt_head")).select(*keys, "_seq", F.col("_nxt").alias("_j")).checkpoint()
    kept = numbered.filter(F.col("_head")).select(*keys, "_seq")
    while not jump.isEmpty():
        # S(k+1) = S(k) + J(k)(S(k)); chains of different bursts are disjoint.
        reached = kept.join(jump, [*keys, "_seq"]).select(*keys, F.col("_j").alias("_seq"))
        kept = kept.unionByName(reached.checkpoint())  # only the newly reached rows are written
        # J(k+1)(x) = J(k)(J(k)(x))
        a, b = jump.alias("a"), jump.alias("b")
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._j") == F.col("b._seq")]
        jump = a.join(b, cond).select(*[F.col(f"a.{k}") for k in keys], F.col("a._seq"),
                                      F.col("b._j").alias("_j")).checkpoint()
    return numbered.join(kept, [*keys, "_seq"], "left_semi").drop("_seq", "_head", "_cool")
