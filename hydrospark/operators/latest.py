"""Latest-per-key, history, top-k and ordered listings.

"Latest" is a hash aggregate with ``max_by(row, (ts, id))``: partial
aggregation keeps one candidate per device per task before the shuffle, so a
hot device costs no more than a cold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.operators.filters import nonnull_pumps, nonnull_water, trailing_window
from hydrospark.operators.ordered import Order, prefix


def latest_by(df: DataFrame, keys=("device_id",), order=("ts", "reading_id"),
              cols: list[str] | None = None) -> DataFrame:
    """Newest row per key (ties broken by the later order columns)."""
    cols = cols or [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def latest_reading(readings: DataFrame) -> DataFrame:
    """Newest reading per device, all columns."""
    return latest_by(readings, cols=[c for c in readings.columns if c != "device_id"])


def pump_status(readings: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Newest row with both pumps set; ``auto_mode = not manual_override``.

    With ``devices`` given, devices without such a row get OFF/OFF, manual
    false, auto true and no last update.
    """
    latest = latest_by(nonnull_pumps(readings), cols=["pump1", "pump2", "manual_override", "ts"])
    out = latest.select(
        "device_id", F.col("pump1").alias("pump1_state"), F.col("pump2").alias("pump2_state"),
        (F.col("manual_override") != 0).alias("manual_override"),
        (F.col("manual_override") == 0).alias("auto_mode"), F.col("ts").alias("last_update"))
    if devices is not None:
        out = devices.select("device_id").join(out, "device_id", "left").select(
            "device_id", F.coalesce("pump1_state", F.lit("OFF")).alias("pump1_state"),
            F.coalesce("pump2_state", F.lit("OFF")).alias("pump2_state"),
            F.coalesce("manual_override", F.lit(False)).alias("manual_override"),
            F.coalesce("auto_mode", F.lit(True)).alias("auto_mode"), "last_update")
    return out


def latest_water(readings: DataFrame) -> DataFrame:
    """1 iff the newest non-null water state is AVAILABLE."""
    w = latest_by(nonnull_water(readings), cols=["water"])
    return w.select("device_id", F.when(F.col("water") == "AVAILABLE", 1).otherwise(0).alias("water_available"))


def latest_weather(weather: DataFrame, keys=()) -> DataFrame:
    """T4: newest weather row (optionally per location key)."""
    cols = [c for c in weather.columns if c not in keys]
    if not keys:
        return weather.agg(F.max_by(F.struct(*cols), F.struct("ts", "id")).alias("_row")).select("_row.*")
    return latest_by(weather, keys=keys, order=("ts", "id"), cols=cols)


def latest_location(location: DataFrame) -> DataFrame:
    """T5: newest stored location."""
    return location.agg(F.max_by(F.struct(*location.columns), F.struct("ts", "id")).alias("_row")).select("_row.*")


def top_k_per_key(df: DataFrame, k: int, keys=("device_id",), order: list[Column] | None = None,
                  rank_col: str | None = None, salts: int = 32) -> DataFrame:
    """Top-k rows per key, first per (key, salt), then per key.

    ``row_number <= k`` plans as ``WindowGroupLimit`` (partial limit before the
    shuffle), so at most k rows per key and task move. A hot key is in every
    task; the salted step spreads its candidates over ``salts`` tasks, and the
    last window sees ``salts`` * k rows of a key at most, however many tasks
    there were."""
    order = order or [F.col("ts").desc(), F.col("reading_id").desc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = [f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts))) \
        .withColumn("_rn", F.row_number().over(salted)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def history(readings: DataFrame, limit: int = 100, days: int | None = None, as_of: Column | None = None,
            per_device: bool = True) -> DataFrame:
    """Newest ``limit`` readings, optionally only the last ``days`` days."""
    df = readings
    if days:
        df = trailing_window(df, as_of, days)
    if per_device:
        return top_k_per_key(df, limit, rank_col="rank")
    return df.orderBy(F.col("ts").desc(), F.col("reading_id").desc()).limit(limit)


def list_alerts(alerts: DataFrame, unresolved_only: bool = False, limit: int = 50,
                per_device: bool = True) -> DataFrame:
    """Unresolved -> all of them newest first; otherwise newest ``limit``."""
    if unresolved_only:
        return alerts.filter(F.col("resolved") == 0).orderBy(F.col("ts").desc(), F.col("id").desc())
    order = [F.col("ts").desc(), F.col("id").desc()]
    if per_device:
        return top_k_per_key(alerts, limit, order=order, rank_col="rank")
    return alerts.orderBy(*order).limit(limit)


def training_log_recent(log: DataFrame, n: int = 7) -> DataFrame:
    """Newest ``n`` training attempts (7 for the forecast view, 20 for the log, 1 for debug)."""
    return log.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def schedule_ordered(schedule: DataFrame, keys=("device_id",)) -> DataFrame:
    """Schedule by hour, minute; ``enabled`` as boolean, plant default
    'both'; ``position`` is the rank within the key, a carried count over the
    minutes of the day (no global sort, no key in one task)."""
    order = Order(keys=tuple(keys), order=("hour", "minute", "id"),
                  bucket_fn=lambda: F.coalesce(F.col("hour") * 60 + F.col("minute"), F.col("hour") * 60, F.lit(-1)))
    placed = prefix(schedule, order, sums={"position": F.lit(1).cast("long")})
    return placed.select(*keys, "id", "hour", "minute", "duration",
                         F.coalesce("plant", F.lit("both")).alias("plant"),
                         (F.coalesce("enabled", F.lit(1)) != 0).alias("enabled"), F.col("position").cast("int").alias("position"))


def best_hour(hourly: Column) -> Column:
    """Hour with the highest probability; the earliest in list order wins ties."""
    indexed = F.transform(hourly, lambda e, i: F.struct(e["probability"].alias("p"), (-i).alias("neg_pos"),
                                                       e["hour"].alias("hour")))
    return F.array_max(indexed)["hour"]


def best_model(metrics: DataFrame, score: str = "r2", name: str = "name", pos: str = "pos") -> DataFrame:
    """Arg-max of ``score``; first in listing order on ties."""
    return metrics.agg(F.max_by(F.struct(*metrics.columns), F.struct(F.col(score), -F.col(pos))).alias("_b")) \
        .select("_b.*")


def rank_recommendations(recs: Column) -> Column:
    """Stable sort by priority high < medium < low (list position breaks ties)."""
    rank = lambda p: F.when(p == "high", 0).when(p == "medium", 1).otherwise(2)
    keyed = F.transform(recs, lambda r, i: F.struct(rank(r["priority"]).alias("_rank"), i.alias("_pos"),
                                                    r["priority"].alias("priority"), r["message"].alias("message"),
                                                    r["action"].alias("action")))
    return F.transform(F.array_sort(keyed), lambda r: F.struct(r["priority"].alias("priority"),
                                                               r["message"].alias("message"),
                                                               r["action"].alias("action")))


def first_n_chronological(readings: DataFrame, n: int = 500, per_device: bool = True) -> DataFrame:
    """First ``n`` rows by time (evaluation sample)."""
    if per_device:
        return top_k_per_key(readings, n, order=[F.col("ts"), F.col("reading_id")], rank_col="rank")
    return readings.orderBy("ts", "reading_id").limit(n)
