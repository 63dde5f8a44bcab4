"""Table maintenance expressed as DataFrame transformations.

Updates in place become "new version of the table" computations: upserts are
``union`` + last-write-wins per key, deletes are filters, acknowledgements
are a left join against an ack log. Writers overwrite (or replace
partitions) with the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.operators.ordered import Order, prefix


def settings_defaults(existing: DataFrame, defaults: DataFrame, keys=()) -> DataFrame:
    """K7: insert defaults only for keys that are absent (anti join + union).
    ``keys`` scopes settings, e.g. per device."""
    k = [*keys, "key"]
    missing = defaults.join(existing.select(*k), k, "left_anti")
    return existing.select(*k, "value").unionByName(missing.select(*k, "value"))


def settings_upsert(existing: DataFrame, updates: DataFrame, version_col: str = "version", keys=()) -> DataFrame:
    """K8: last write wins per key; values are stored as text.

    ``updates`` has (key, value, version); existing rows count as version -inf.
    """
    k = [*keys, "key"]
    old = existing.select(*k, F.col("value").cast("string").alias("value"),
                          F.lit(None).cast("long").alias(version_col))
    new = updates.select(*k, F.col("value").cast("string").alias("value"), F.col(version_col).cast("long"))
    both = old.unionByName(new).withColumn("_v", F.coalesce(F.col(version_col), F.lit(-(2 ** 62))))
    return both.groupBy(*k).agg(F.max_by("value", "_v").alias("value"))


def cooldown_upsert(cooldown: DataFrame, sent: DataFrame, keys=("alert_type",)) -> DataFrame:
    """K9: ``last_sent`` per alert key, newest wins."""
    return cooldown.select(*keys, "last_sent").unionByName(sent.select(*keys, "last_sent")) \
        .groupBy(*keys).agg(F.max("last_sent").alias("last_sent"))


def replace_schedule(new_rows: DataFrame, keys=("device_id",)) -> DataFrame:
    """Each key's submitted list replaces its old schedule; plant
    defaults to 'both', enabled to 1, ids renumbered in list order (``pos``)
    within the key. The numbers are a carried count over blocks of positions, so
    no key is one task."""
    order = Order(keys=tuple(keys), order=("pos",), bucket_fn=lambda: F.floor(F.col("pos") / 4096))
    numbered = prefix(new_rows, order, sums={"id": F.lit(1).cast("long")})
    return numbered.select(
        *keys, "id", "hour", "minute", "duration",
        F.coalesce("plant", F.lit("both")).alias("plant"),
        F.when(F.coalesce(F.col("enabled"), F.lit(True)), 1).otherwise(0).cast("int").alias("enabled"))


def stored_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows as stored: id from (reading, rule position), unresolved."""
    return alerts.select((F.col("reading_id") * 10 + F.col("rule_pos")).alias("id"), "device_id", "ts", "type",
                         "message", F.lit(0).cast("int").alias("resolved"))


def resolve_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply an acknowledgement log (device_id, ts, alert_id).

    ``alert_id`` set: resolve that alert (``resolve_alert``); null: resolve
    every alert of the device that existed at that time
    (``resolve_all_alerts``). Both are joins against small per-key
    aggregates; AQE broadcasts them only when they are measured small.
    """
    one = acks.filter(F.col("alert_id").isNotNull()).groupBy(F.col("alert_id").alias("id")) \
        .agg(F.max("ts").alias("_ack_one"))
    all_ = acks.filter(F.col("alert_id").isNull()).groupBy("device_id").agg(F.max("ts").alias("_ack_all"))
    j = alerts.join(one, "id", "left").join(all_, "device_id", "left")
    resolved = ((F.col("resolved") != 0) | F.coalesce(F.col("_ack_one") >= F.col("ts"), F.lit(False))
                | F.coalesce(F.col("_ack_all") >= F.col("ts"), F.lit(False)))
    return j.select("id", "device_id", "ts", "type", "message", F.when(resolved, 1).otherwise(0).cast("int")
                    .alias("resolved"))


def clear_history(tables: dict[str, DataFrame], keep=("settings", "pump_schedule")) -> dict[str, DataFrame]:
    """Empty everything except settings and schedule."""
    return {name: (df if name in keep else df.limit(0)) for name, df in tables.items()}


def retain_days(df: DataFrame, as_of, days: int = 7, ts: str = "ts") -> DataFrame:
    """K6: drop rows older than ``as_of - days`` (kept: ts >= as_of - days)."""
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
