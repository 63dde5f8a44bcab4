"""Alert rules (R1-R6), settings join (J1) and enable switches.

Settings are a small key/value table pivoted to one typed row and
cross-joined with an explicit broadcast: the row count is fixed at one, so
the broadcast size is bounded regardless of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrospark.functions.columns import round_d, soil_value
from hydrospark.operators.sequences import pump_runs, minutes_between
from hydrospark.operators.throttle import throttle
from hydrospark.schemas import ALERT_ENABLE_KEYS, DEFAULT_SETTINGS, SETTINGS

# Typed settings used by the rules: name -> (spark type, default when missing
# or unparsable).
TYPED_SETTINGS = {
    "soil_dry_threshold1": ("int", 500),
    "soil_dry_threshold2": ("int", 500),
    "max_temperature": ("double", 35.0),
    "min_humidity": ("double", 30.0),
    "alert_dry_duration": ("int", 5),
    "email_cooldown_minutes": ("int", 10),
}


def settings_table(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """Defaults with ``overrides`` applied (K7 + K8 semantics, built locally
    because the table is a few dozen rows)."""
    d = dict(DEFAULT_SETTINGS)
    d.update({k: str(v) for k, v in (overrides or {}).items()})
    return spark.createDataFrame(sorted(d.items()), SETTINGS)


def settings_row(settings: DataFrame) -> DataFrame:
    """J1 (pivot): one row, typed columns with per-key defaults, plus the raw
    strings of the enable switches and e-mail settings. Of settings by device
    only those without a device count."""
    if "device_id" in settings.columns:
        settings = settings.where("device_id is null")
    return _pivot(settings)


def _pivot(settings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    def raw(k: str) -> Column:
        return F.max(F.when(F.col("key") == k, F.col("value")))
    aggs = [raw(k).alias(k) for k in TYPED_SETTINGS]
    switch_keys = sorted({v for _, v in ALERT_ENABLE_KEYS} | {"email_enabled", "email_recipient"})
    aggs += [raw(k).alias(k) for k in switch_keys]
    row = settings.groupBy(*keys).agg(*aggs)
    if keys:
        return row
    typed = [F.coalesce(F.col(k).try_cast(t), F.lit(d)).alias(k) for k, (t, d) in TYPED_SETTINGS.items()]
    return row.select(*typed, *switch_keys)


def with_settings(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Every row sees every setting (one-row broadcast cross join).

    Settings with a ``device_id`` column hold for their device and override
    those without a device, setting by setting; they grow with the devices, so
    they are a plain join on the device, split by the optimiser where skewed.
    Settings with a ``ts`` column are versions (see ``settings_as_of``)."""
    if "ts" in settings.columns:
        return settings_as_of(df, settings)
    out = df.crossJoin(F.broadcast(settings_row(settings)))
    if "device_id" not in settings.columns:
        return out
    own = _pivot(settings.where("device_id is not null"), ("device_id",))
    names = [c for c in own.columns if c != "device_id"]
    own = own.select(F.col("device_id").alias("_own_device"), *[F.col(c).alias(f"_own_{c}") for c in names])
    joined = out.join(own, out.device_id == own["_own_device"], "left")

    def value(c):
        mine = F.col(f"_own_{c}")
        return F.coalesce(mine.try_cast(TYPED_SETTINGS[c][0]) if c in TYPED_SETTINGS else mine, F.col(c)).alias(c)

    return joined.select(*[value(c) if c in names else F.col(c) for c in out.columns])


def _typed(c: Column, key: str) -> Column:
    return c.try_cast(TYPED_SETTINGS[key][0]) if key in TYPED_SETTINGS else c


def settings_as_of(df: DataFrame, versions: DataFrame) -> DataFrame:
    """J1 in time: every row sees the settings as they were at its ``ts``.

    ``versions`` (ts, key, value, optional device_id and version): a row holds
    from its ``ts`` on, of equal times the larger ``version`` counts. A device's
    own value overrides the general one, an unparsable value counts as absent.

    General versions: the state at the start of each hour is scanned over the
    hours (a calendar, not the data), the edits of an hour travel with it as a
    sorted array, and rows meet both in an equi-join on the hour. Versions of
    devices are merged into the rows' own order per device as carried last
    values. No range join, no row is multiplied.
    """
    from hydrospark.operators.ordered import BKT, Order, prefix

    names = [*TYPED_SETTINGS, *sorted({v for _, v in ALERT_ENABLE_KEYS} | {"email_enabled", "email_recipient"})]
    by_device = "device_id" in versions.columns
    v = versions.select(
        F.col("device_id") if by_device else F.lit(None).cast("long").alias("device_id"), F.col("ts"), "key", "value",
        (F.col("version") if "version" in versions.columns else F.lit(0)).cast("long").alias("_version"))
    v = v.where(F.col("key").isin(names))
    hour = F.date_trunc("hour", F.col("ts"))
    when = F.struct("ts", "_version")
    edits = v.where("device_id is null").groupBy(hour.alias("_hour")).agg(
        F.sort_array(F.collect_list(F.struct("ts", "_version", "key", "value"))).alias("_edits"),  # one hour's edits
        *[F.max_by("value", F.when(F.col("key") == k, when)).alias(f"_last_{k}") for k in names])
    hours = df.select(hour.alias("_hour")).distinct().join(edits, "_hour", "full_outer")
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_hour", "_edits", *[F.last(f"_last_{k}", ignorenulls=True).over(before).alias(f"_start_{k}")
                                              for k in names])
    rows = df.withColumn("_hour", hour).join(hours, "_hour")
    past = F.filter(F.coalesce("_edits", F.array().cast(dict(hours.dtypes)["_edits"])), lambda e: e["ts"] <= F.col("ts"))

    def general(k):
        mine = F.filter(F.col("_past"), lambda e: e["key"] == k)
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["value"], F.col(f"_start_{k}"))

    rows = rows.withColumn("_past", past).select(*df.columns, *[general(k).alias(f"_general_{k}") for k in names])
    own = {k: F.lit(None).cast("string") for k in names}
    if by_device:
        mine = v.where("device_id is not null").withColumns({"_src": F.lit(0), "_edit": F.lit(True)})
        both = rows.withColumns({"_src": F.lit(1), "_version": F.lit(0).cast("long")}).unionByName(
            mine, allowMissingColumns=True)
        order = Order(keys=("device_id",), order=("ts", "_src", "_version"))
        rows = prefix(both, order, lasts={f"_own_{k}": F.when(F.col("_edit") & (F.col("key") == k), F.col("value"))
                                          for k in names}).where("_src = 1").drop(BKT)
        own = {k: F.col(f"_own_{k}") for k in names}
    fixed = {k: F.lit(d) for k, (_, d) in TYPED_SETTINGS.items()}
    values = [F.coalesce(_typed(own[k], k), _typed(F.col(f"_general_{k}"), k), *([fixed[k]] if k in fixed else []))
              .alias(k) for k in names]
    return rows.select(*df.columns, *values)


def _alert(pos: int, type_: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(pos).alias("rule_pos"), F.lit(type_).alias("type"),
                    F.lit(severity).alias("severity"), message.alias("message"))


def _num_text(c: Column) -> Column:
    """Python ``str(float)`` for the values seen here (cast keeps the '.0')."""
    return c.cast("double").cast("string")


def reading_alerts(readings: DataFrame, settings: DataFrame) -> DataFrame:
    """R1-R4 per reading, one pass: soil dry (each plant), high temperature
    (strict >), low humidity (strict <), no water."""
    s = with_settings(readings, settings)
    rules = F.array(
        F.when(soil_value("soil1") > F.col("soil_dry_threshold1"), _alert(
            1, "soil_dry_plant1", "danger", F.format_string("Plant 1 soil is too dry! Current: %s (Threshold: %s)",
                                                            F.col("soil1"), F.col("soil_dry_threshold1")))),
        F.when(soil_value("soil2") > F.col("soil_dry_threshold2"), _alert(
            2, "soil_dry_plant2", "danger", F.format_string("Plant 2 soil is too dry! Current: %s (Threshold: %s)",
                                                            F.col("soil2"), F.col("soil_dry_threshold2")))),
        F.when(F.col("temperature") > F.col("max_temperature"), _alert(
            3, "high_temp", "warning", F.concat(F.lit("Temperature is high! "), _num_text(F.col("temperature")),
                                                F.lit("°C (Max: "), _num_text(F.col("max_temperature")),
                                                F.lit("°C)")))),
        F.when(F.col("humidity") < F.col("min_humidity"), _alert(
            4, "low_humidity", "warning", F.concat(F.lit("Humidity is low! "), _num_text(F.col("humidity")),
                                                   F.lit("% (Min: "), _num_text(F.col("min_humidity")),
                                                   F.lit("%)")))),
        F.when(F.col("water") == "NOT AVAILABLE", _alert(
            5, "no_water", "danger", F.lit("Water tank is empty! Refill immediately."))),
    )
    return s.select("device_id", "reading_id", "ts", F.inline(F.filter(rules, lambda r: r.isNotNull())))


def run_alerts(runs: DataFrame) -> DataFrame:
    """W4 + W5 as alert rows from ``pump_runs`` rows with settings: pump start
    (rule 6/7) and pump running while still dry for at least the device's
    ``alert_dry_duration`` minutes (rule 8/9). Rows of a stream with ``late`` set
    make one row of type ``late_reading`` instead."""
    streams = "late" in runs.columns
    late = F.col("late") if streams else F.lit(False)
    elapsed = minutes_between(F.col("run_start_ts"), F.col("ts"))
    plant = F.col("plant").cast("string")
    start = F.when(F.col("run_start") & ~late, F.struct(
        (F.lit(5) + F.col("plant")).alias("rule_pos"), F.concat(F.lit("pump"), plant, F.lit("_start")).alias("type"),
        F.lit("info").alias("severity"),
        F.concat(F.lit("Plant "), plant, F.lit(" pump started automatically at "),
                 F.date_format("ts", "HH:mm:ss")).alias("message")))
    dry = F.when(~late & (F.col("pump") == "ON") & (F.col("soil") == "DRY") & (elapsed >= F.col("alert_dry_duration")),
                 F.struct((F.lit(7) + F.col("plant")).alias("rule_pos"),
                          F.concat(F.lit("pump"), plant, F.lit("_still_dry")).alias("type"),
                          F.lit("warning").alias("severity"),
                          F.concat(F.lit("Plant "), plant, F.lit(" pump has been running for "),
                                   F.format_string("%.1f", round_d(elapsed, 1)),
                                   F.lit(" minutes but soil is still DRY! Check for issues.")).alias("message")))
    missed = F.when(late, F.struct(
        F.col("plant").alias("rule_pos"), F.lit("late_reading").alias("type"), F.lit("info").alias("severity"),
        F.concat(F.lit("Plant "), plant, F.lit(" reading arrived after a newer one")).alias("message")))
    found = F.array(start, dry, missed) if streams else F.array(start, dry)
    return runs.select("device_id", "reading_id", "ts", F.inline(F.filter(found, lambda r: r.isNotNull())),
                       *(["late"] if streams else []))


def pump_alerts(readings: DataFrame, settings: DataFrame) -> DataFrame:
    """W4 + W5 as alert rows."""
    return run_alerts(with_settings(pump_runs(readings), settings))


def alerts_all(readings: DataFrame, settings: DataFrame) -> DataFrame:
    """Every rule on every device-posted reading, in rule order. Manual
    rows never reach the rules. Stored without enable switch or cooldown."""
    device_rows = readings.filter(F.col("manual_override") == 0)
    return reading_alerts(device_rows, settings).unionByName(pump_alerts(readings, settings))


def alert_enabled(alerts: DataFrame, settings: DataFrame, key: str = "severity") -> DataFrame:
    """Keep alerts whose ``key`` value is switched on. A value with no
    switch is enabled; a switch that is missing from settings is off. With
    settings by device the device's own switch decides where it has one."""
    spark = alerts.sparkSession
    if "device_id" in settings.columns or "ts" in settings.columns:
        switch = F.create_map(*[x for k, v in ALERT_ENABLE_KEYS for x in (F.lit(k), F.col(v))])
        j = with_settings(alerts, settings)
        known = F.col(key).isin([k for k, _ in ALERT_ENABLE_KEYS])
        return j.filter(~known | F.coalesce(switch[F.col(key)] == "1", F.lit(False))).select(*alerts.columns)
    mapping = spark.createDataFrame(ALERT_ENABLE_KEYS, "alert_key string, setting_key string")
    sw = mapping.join(settings, mapping.setting_key == settings.key, "left") \
        .select("alert_key", F.coalesce(F.col("value") == "1", F.lit(False)).alias("_on"))
    j = alerts.join(F.broadcast(sw), alerts[key] == sw.alert_key, "left")  # <= 7 rows
    return j.filter(F.coalesce(F.col("_on"), F.lit(True))).drop("alert_key", "_on")


def mail_gate(alerts: DataFrame, settings: DataFrame, key: str = "severity") -> DataFrame:
    """Alerts that may be mailed: e-mail enabled with a recipient, then J4 on
    ``key``. Adds ``_cooldown`` in seconds. Settings by device decide for their
    device, the general ones for all others."""
    mailed = with_settings(alert_enabled(alerts, settings, key), settings).where(
        (F.col("email_enabled") == "1") & (F.coalesce(F.length("email_recipient"), F.lit(0)) > 0))
    return mailed.select(*alerts.columns, (F.col("email_cooldown_minutes") * 60).alias("_cooldown"))


def notifications(alerts: DataFrame, settings: DataFrame, key: str = "severity",
                  stored: DataFrame | None = None) -> DataFrame:
    """Alerts that would be e-mailed. The mail gate, then the greedy cooldown
    (W6) per (device, key) with ``email_cooldown_minutes``, the device's own
    where it has one (one value per device: settings without versions).
    ``stored`` is the cooldown table (device_id, alert_type, last_sent) of what
    was sent before; no alert of ``alerts`` may be older than its entry."""
    if "ts" in settings.columns:
        raise ValueError("notifications take one cooldown per device; give the settings in force")
    sent = None
    if stored is not None:
        sent = stored.select("device_id", F.col("alert_type").alias(key), F.col("last_sent").alias("ts"))
    kept = throttle(mail_gate(alerts, settings, key), ["device_id", key], F.col("_cooldown"),
                    order_cols=("ts", "reading_id", "rule_pos"), sent=sent)
    return kept.select(*alerts.columns)
