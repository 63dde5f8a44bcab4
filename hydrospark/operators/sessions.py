"""W3 + A11 in one pass: watering sessions and plant figures from summaries that
merge in time order.

A bucket of a plant's rows is summarised by what its first OFF would close (an
opening before it, its duration), the sessions that begin and end behind that
OFF, and its last opening and last OFF. Whether a session is open when a bucket
begins follows from the last opening and the last OFF of the buckets before it,
so the rows are shuffled once, on (device, plant, bucket), and only summaries
meet per plant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.functions.columns import soil_value
from hydrospark.operators.ordered import BKT, Order, with_bucket
from hydrospark.operators.sequences import PLANT_ORDER, plant_rows

_KEYS = ("device_id", "plant")


def plant_summaries(readings: DataFrame, o: Order = PLANT_ORDER) -> DataFrame:
    """One row per (device, plant, bucket): the session summary described above,
    sums of soil numbers and ON seconds, and the bucket's newest climate."""
    dur = F.coalesce(F.col("pump_duration"), F.lit(0))
    p = plant_rows(readings).withColumns({
        "_open": F.coalesce((F.col("pump") == "ON") & (dur > 0), F.lit(False)),
        "_close": F.coalesce(F.col("pump") == "OFF", F.lit(False)), "_dur": dur, "_v": soil_value("soil").cast("double")})
    before = o.window().rowsBetween(Window.unboundedPreceding, -1)
    g = F.coalesce(F.sum(F.col("_close").cast("int")).over(before), F.lit(0))
    rows = with_bucket(p, o).withColumn("_g", g)
    at = F.struct(*o.order)
    # Same partitioning as the window, so neither aggregate shuffles.
    groups = rows.groupBy(*_KEYS, BKT, "_g").agg(
        F.max("_open").alias("opened"), F.max(F.when(F.col("_close"), F.col("_dur"))).alias("closed"),
        F.max(F.when(F.col("_open"), at)).alias("last_open"), F.max(F.when(F.col("_close"), at)).alias("last_close"),
        F.sum(F.when(F.col("_open"), F.col("_dur")).otherwise(0)).alias("on_seconds"),
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("v"), F.sum(F.col("_v") * F.col("_v")).alias("vv"),
        F.max_by(F.struct("temperature", "humidity"), at).alias("climate"), F.max(at).alias("newest"))
    first = F.col("_g") == 0
    inner = ~first & F.col("opened") & F.col("closed").isNotNull()
    return groups.groupBy(*_KEYS, BKT).agg(
        F.max(F.when(first, F.col("opened"))).alias("prefix_open"), F.max(F.when(first, F.col("closed"))).alias("first_closed"),
        F.count_if(inner).alias("events"), F.sum(F.when(inner, F.col("closed")).otherwise(0)).alias("duration"),
        F.max("last_open").alias("last_open"), F.max("last_close").alias("last_close"),
        F.sum("on_seconds").alias("on_seconds"), F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("vv").alias("vv"),
        F.max_by("climate", "newest").alias("climate"), F.max("newest").alias("newest"))


def merge_summaries(summaries: DataFrame, days: int) -> DataFrame:
    """A11 per (device, plant) from its summaries; a plant that only has rows
    without a bucket (``n`` null: known, no reading) gets null figures."""
    w = Window.partitionBy(*_KEYS).orderBy(BKT).rowsBetween(Window.unboundedPreceding, -1)
    opened, closed = F.max("last_open").over(w), F.max("last_close").over(w)
    s = summaries.withColumn("_in_open", F.coalesce(opened.isNotNull() & (closed.isNull() | (opened > closed)), F.lit(False)))
    ends = F.col("first_closed").isNotNull() & (F.coalesce("prefix_open", F.lit(False)) | F.col("_in_open"))
    t = s.groupBy(*_KEYS).agg(
        F.sum(F.col("events") + F.when(ends, 1).otherwise(0)).cast("long").alias("_events"),
        F.sum(F.col("duration") + F.when(ends, F.col("first_closed")).otherwise(0)).alias("_duration"),
        F.sum("on_seconds").cast("long").alias("total_water_time"), F.sum("n").cast("double").alias("_n"),
        F.sum("v").alias("_v"), F.sum("vv").alias("_vv"), F.max_by("climate", "newest").alias("_latest"))
    seen = F.col("_n").isNotNull()
    events = F.col("_events")
    return t.select(
        *_KEYS, (F.col("_v") / F.col("_n")).alias("avg_soil"),
        (F.sqrt(F.col("_n") * F.col("_vv") - F.col("_v") * F.col("_v")) / F.col("_n")).alias("soil_stability"),
        F.when(seen, events).alias("watering_events"), F.when(seen, events / F.lit(float(days))).alias("frequency"),
        F.when(seen, F.when(events > 0, F.col("_duration") / events).otherwise(F.lit(0.0))).alias("avg_duration"),
        F.when(seen, F.col("total_water_time")).alias("total_water_time"),
        F.col("_latest.temperature").alias("latest_temperature"), F.col("_latest.humidity").alias("latest_humidity"))


def plant_figures(window: DataFrame, days: int, known: DataFrame | None = None) -> DataFrame:
    """A11 of both plants of every device with readings in ``window`` and of the
    devices of ``known`` (column device_id, repeats allowed)."""
    s = plant_summaries(window)
    if known is not None:
        both = known.select("device_id").distinct().select("device_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("plant"))
        s = s.unionByName(both, allowMissingColumns=True)
    return merge_summaries(s, days)
