"""Window, sequence and session operators.

All ordering is per device by ``(ts, reading_id)``; every window here runs
on ``(device, bucket)`` partitions through ``operators.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.operators.ordered import (
    BKT, DEVICE_ORDER, Order, drop_halo, prefix, with_carry, with_halo)
from hydrospark.operators.reshape import unpivot_plants

PLANT_ORDER = Order(keys=("device_id", "plant"))


# W1 / W2 -------------------------------------------------------------------

def lag_features(df: DataFrame, cols: dict[str, str | Column], lags=(1, 2, 3),
                 o: Order = DEVICE_ORDER) -> DataFrame:
    """``{name}_lag_{n}`` = value ``n`` rows earlier on the same device."""
    return sequence_features(df, cols, lags=lags, windows=(), o=o)


def rolling_means(df: DataFrame, cols: dict[str, str | Column], windows=(3, 6),
                  o: Order = DEVICE_ORDER) -> DataFrame:
    """``{name}_ma_{n}`` = mean of the last ``n`` rows, null until ``n`` exist."""
    return sequence_features(df, cols, lags=(), windows=windows, o=o)


def sequence_features(df: DataFrame, cols: dict[str, str | Column], lags=(1, 2, 3), windows=(3, 6),
                      o: Order = DEVICE_ORDER, lag_names: dict[str, str] | None = None,
                      ma_names: dict[str, str] | None = None) -> DataFrame:
    """W1 + W2 from one sort: lags and trailing row means share one window spec.

    ``cols`` maps a feature stem to a column. Needs at most ``max(lags,
    windows-1)`` halo rows per block.
    """
    lag_names = lag_names or {}
    ma_names = ma_names or {}
    stems = {k: (F.col(v) if isinstance(v, str) else v) for k, v in cols.items()}
    tmp = df.select("*", *[v.alias(f"_v_{k}") for k, v in stems.items()])
    need = max([*lags, *[w - 1 for w in windows], 0])
    h = with_halo(tmp, need, o)
    w = o.window()
    out = []
    for k in stems:
        v = F.col(f"_v_{k}")
        for n in lags:
            out.append(F.lag(v, n).over(w).alias(lag_names.get(k, k) + f"_lag_{n}"))
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            out.append(F.when(F.count(v).over(frame) == n, F.avg(v).over(frame))
                       .alias(ma_names.get(k, k) + f"_ma_{n}"))
    res = h.select("*", *out)
    res = drop_halo(res).drop(BKT)
    return res.drop(*[f"_v_{k}" for k in stems])


# W3 ------------------------------------------------------------------------

def plant_rows(readings: DataFrame) -> DataFrame:
    """S9 on readings, keeping what the session/alert rules need."""
    return unpivot_plants(readings, keep=["reading_id", "device_id", "ts", "temperature",
                                          "humidity", "water", "manual_override"])


def watering_sessions(readings: DataFrame) -> DataFrame:
    """Per (device, plant), ON with duration > 0 opens a session (first
    such row is the start), the next OFF closes it with the OFF row's own
    duration. ON with zero duration is ignored; an unclosed session is not
    reported. Null durations count as 0.

    Gaps and islands: ``g`` = number of OFF rows strictly before the row. A
    session is the rows of one ``g`` group that has both an opening ON and its
    closing OFF; one hash aggregate on (device, plant, g) finishes it
    (partial aggregation absorbs long sessions).
    """
    p = plant_rows(readings)
    dur = F.coalesce(F.col("pump_duration"), F.lit(0))
    p = p.withColumn("_open", (F.col("pump") == "ON") & (dur > 0)) \
         .withColumn("_close", F.col("pump") == "OFF")
    p = prefix(p, PLANT_ORDER, sums={"_g": F.col("_close").cast("long")}, inclusive=False)
    sess = p.groupBy("device_id", "plant", "_g").agg(
        F.min(F.when(F.col("_open"), F.col("ts"))).alias("start_ts"),
        F.max(F.when(F.col("_close"), F.col("ts"))).alias("end_ts"),
        F.max(F.when(F.col("_close"), F.coalesce(F.col("pump_duration"), F.lit(0)))).alias("duration"),
        F.sum(F.when(F.col("_open"), dur)).cast("long").alias("on_seconds"),
    )
    return sess.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()) \
        .select("device_id", "plant", "start_ts", "end_ts", F.col("duration").cast("int").alias("duration"),
                "on_seconds")


# W4 / W5 -------------------------------------------------------------------

def pump_runs(readings: DataFrame) -> DataFrame:
    """Device-posted plant rows with ``run_start`` (rising edge) and the ts of
    the current ON run's first row (``run_start_ts``; null while OFF).

    Manual rows never pass the alert code path, so they are excluded first.
    """
    p = plant_rows(readings.filter(F.col("manual_override") == 0))
    known = F.col("pump").isNotNull()

    def starts(prev: Column) -> Column:
        # A run only ends on an explicit OFF: the previous state is the last
        # non-null value before the row.
        return (F.col("pump") == "ON") & (prev.isNull() | (prev != "ON"))

    def local(rows, w):
        rows = rows.withColumn("_lp", F.last("pump", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)))
        # Starts that the bucket can tell alone; its first known row waits for the carry.
        return rows.withColumn("_ls", F.when(F.col("_lp").isNotNull() & starts(F.col("_lp")), F.col("ts")))

    order = F.when(known, F.struct(*PLANT_ORDER.order))
    summary = [F.max_by("pump", order).alias("_out"), F.min_by("pump", order).alias("_first"),
               F.min(F.when(known, F.col("ts"))).alias("_first_ts"), F.max("_ls").alias("_start")]

    def scan(totals, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("_cp", F.last("_out", ignorenulls=True).over(before))
        opens = (F.col("_first") == "ON") & (F.col("_cp").isNull() | (F.col("_cp") != "ON"))
        start = F.coalesce("_start", F.when(opens, F.col("_first_ts")))
        return totals.withColumn("_bs", start).select(
            *PLANT_ORDER.keys, BKT, "_cp", F.last("_bs", ignorenulls=True).over(before).alias("_cs"))

    r = with_carry(p, PLANT_ORDER, local, summary, scan)
    r = r.withColumn("run_start", starts(F.coalesce("_lp", "_cp")))
    w = PLANT_ORDER.window().rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_rs", F.coalesce(F.last(F.when(F.col("run_start"), F.col("ts")), ignorenulls=True).over(w),
                                       F.col("_cs")))
    return r.withColumn("run_start_ts", F.when(F.col("pump") == "ON", F.col("_rs"))) \
        .drop(BKT, "_lp", "_ls", "_cp", "_cs", "_rs")


def pump_starts(readings: DataFrame) -> DataFrame:
    """One row per OFF/none -> ON edge per pump."""
    return pump_runs(readings).filter("run_start") \
        .select("device_id", "plant", "reading_id", "ts")


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60e6)


def pump_still_dry(readings: DataFrame, dry_minutes: Column | float = 5.0) -> DataFrame:
    """Pump ON, soil DRY and at least ``dry_minutes`` since the run's first ON."""
    thr = dry_minutes if isinstance(dry_minutes, Column) else F.lit(float(dry_minutes))
    r = pump_runs(readings).withColumn("elapsed_min", minutes_between(F.col("run_start_ts"), F.col("ts")))
    return r.filter((F.col("pump") == "ON") & (F.col("soil") == "DRY") & (F.col("elapsed_min") >= thr)) \
        .select("device_id", "plant", "reading_id", "ts", "run_start_ts", "elapsed_min")


# W7 ------------------------------------------------------------------------

def valid_commands(commands: DataFrame) -> DataFrame:
    """Normalise and drop invalid commands (pump1/pump2; ON/OFF/TOGGLE)."""
    c = commands.withColumn("pump", F.lower("pump")).withColumn("action", F.upper("action"))
    return c.filter(F.col("pump").isin("pump1", "pump2") & F.col("action").isin("ON", "OFF", "TOGGLE"))


def event_stream(readings: DataFrame, commands: DataFrame) -> DataFrame:
    """Telemetry rows (rank 0) and commands (rank 1) in one per-device stream."""
    tel = readings.select(
        "device_id", "ts", F.lit(0).alias("src"), F.col("reading_id").alias("event_id"),
        F.col("pump1").alias("e1"), F.col("pump2").alias("e2"),
        F.lit(0).alias("t1"), F.lit(0).alias("t2"),
        "temperature", "humidity", "soil1", "soil2", "water",
        F.lit(None).cast("string").alias("pump"), F.lit(None).cast("string").alias("action"))
    c = valid_commands(commands)
    explicit = F.col("action").isin("ON", "OFF")
    cmd = c.select(
        "device_id", "ts", F.lit(1).alias("src"), F.col("command_id").alias("event_id"),
        F.when((F.col("pump") == "pump1") & explicit, F.col("action")).alias("e1"),
        F.when((F.col("pump") == "pump2") & explicit, F.col("action")).alias("e2"),
        F.when((F.col("pump") == "pump1") & (F.col("action") == "TOGGLE"), 1).otherwise(0).alias("t1"),
        F.when((F.col("pump") == "pump2") & (F.col("action") == "TOGGLE"), 1).otherwise(0).alias("t2"),
        F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("double").alias("humidity"),
        F.lit(None).cast("string").alias("soil1"), F.lit(None).cast("string").alias("soil2"),
        F.lit(None).cast("string").alias("water"), "pump", "action")
    return tel.unionByName(cmd)


EVENT_ORDER = Order(keys=("device_id",), order=("ts", "src", "event_id"))


def _flip(state: Column, odd: Column) -> Column:
    """ON <-> OFF when ``odd``; null stays null."""
    return F.when(odd & state.isNotNull(), F.when(state == "ON", "OFF").otherwise("ON")).otherwise(state)


def _odd(c: str) -> Column:
    return (F.col(c) % 2) == 1


def _timeline(ev: DataFrame, keep_commanded: bool = False) -> DataFrame:
    """Carry pump states over an event stream with explicit values e1/e2 and
    toggle flags t1/t2. State = last explicit value flipped by the parity of
    toggles since it (initial OFF).

    With ``keep_commanded`` a telemetry row right after a command sets nothing;
    ``manual_override`` marks these rows. One carry holds toggle counts, last
    values and the last event's source: an explicit value is kept normalised by
    the toggle parity at its own row, first within its bucket, then, by the
    parity before the bucket, within the device.
    """
    pumps = ("1", "2")
    order = F.struct(*EVENT_ORDER.order)

    def local(rows, w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select("*", *[F.sum(f"t{i}").over(upto).alias(f"_c{i}") for i in pumps],
                           F.lag("src", 1).over(w).alias("_ps"))
        sets = F.lit(True)
        if keep_commanded:  # the first row of a bucket waits for the carry
            sets = F.col("_ps").isNotNull() & ~((F.col("src") == 0) & (F.col("_ps") == 1))
        rows = rows.select("*", *[_flip(F.col(f"e{i}"), _odd(f"_c{i}")).alias(f"_v{i}") for i in pumps])
        return rows.select("*", *[F.last(F.when(sets, F.col(f"_v{i}")), ignorenulls=True).over(upto).alias(f"_l{i}")
                                  for i in pumps])

    summary = [F.max_by("src", order).alias("_last_src"), F.min_by("src", order).alias("_first_src")]
    for i in pumps:
        summary += [F.sum(f"t{i}").alias(f"_t{i}"), F.max_by(f"_l{i}", order).alias(f"_n{i}"),
                    F.min_by(f"_v{i}", order).alias(f"_f{i}")]

    def scan(totals, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("*", F.lag("_last_src", 1).over(w).alias("_cps"), *[
            F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_ct{i}") for i in pumps])
        held = (F.col("_first_src") == 0) & F.coalesce(F.col("_cps") == 1, F.lit(False))
        # What the first row sets, and the last value set in the bucket, normalised within the device.
        totals = totals.select("*", *[_flip(F.when(~held, F.col(f"_f{i}")), _odd(f"_ct{i}")).alias(f"_e{i}")
                                      for i in pumps])
        totals = totals.select("*", *[F.coalesce(_flip(F.col(f"_n{i}"), _odd(f"_ct{i}")), F.col(f"_e{i}"))
                                      .alias(f"_b{i}") for i in pumps])
        return totals.select(*EVENT_ORDER.keys, BKT, "_cps", *[x for i in pumps for x in (
            f"_ct{i}", f"_e{i}", F.last(f"_b{i}", ignorenulls=True).over(before).alias(f"_cn{i}"))])

    r = with_carry(ev, EVENT_ORDER, local, summary, scan)
    states = []
    for i in pumps:
        value = F.coalesce(_flip(F.col(f"_l{i}"), _odd(f"_ct{i}")), F.col(f"_e{i}"), F.col(f"_cn{i}"), F.lit("OFF"))
        total = F.coalesce(f"_ct{i}", F.lit(0)) + F.col(f"_c{i}")
        states.append(_flip(value, (total % 2) == 1).alias(f"pump{i}_state"))
    after_command = F.coalesce(F.coalesce("_ps", "_cps") == 1, F.lit(False))
    return r.select(*ev.columns, *states, ((F.col("src") == 0) & after_command).alias("manual_override"))


def pump_state_timeline(readings: DataFrame, commands: DataFrame) -> DataFrame:
    """Pump states after every telemetry row and every command.

    Telemetry overwrites both states, ON/OFF commands set one, TOGGLE flips
    one; invalid commands are dropped; initial state OFF.
    """
    ev = _timeline(event_stream(readings, commands))
    return ev.select("device_id", "ts", F.when(F.col("src") == 0, "telemetry").otherwise("command").alias("source"),
                     "event_id", "pump", "action", "pump1_state", "pump2_state")


# J2 ------------------------------------------------------------------------

def command_context(readings: DataFrame, commands: DataFrame) -> DataFrame:
    """As-of backward join. Each valid command takes temperature,
    humidity, soils and water of the device's newest reading at or before it,
    nulls included; without such a reading 25.0, 60.0, DRY, DRY, AVAILABLE. Done as a carried last value on
    the merged stream (no range join).
    """
    ev = event_stream(readings, commands)
    ctx = F.when(F.col("src") == 0, F.struct("temperature", "humidity", "soil1", "soil2", "water"))
    ev = prefix(ev, EVENT_ORDER, lasts={"ctx": ctx}).drop(BKT)
    cmd = ev.filter(F.col("src") == 1)
    return cmd.select(
        "device_id", "ts", F.col("event_id").alias("command_id"), "pump", "action",
        F.when(F.col("ctx").isNull(), 25.0).otherwise(F.col("ctx.temperature")).alias("temperature"),
        F.when(F.col("ctx").isNull(), 60.0).otherwise(F.col("ctx.humidity")).alias("humidity"),
        F.when(F.col("ctx").isNull(), "DRY").otherwise(F.col("ctx.soil1")).alias("soil1"),
        F.when(F.col("ctx").isNull(), "DRY").otherwise(F.col("ctx.soil2")).alias("soil2"),
        F.when(F.col("ctx").isNull(), "AVAILABLE").otherwise(F.col("ctx.water")).alias("water"),
    )


def manual_rows(readings: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows a manual command appends: context values, pump states after the
    command, 60 s duration when ON, ``manual_override = 1``."""
    ctx = command_context(readings, commands)
    tl = pump_state_timeline(readings, commands).filter(F.col("source") == "command") \
        .select("device_id", F.col("event_id").alias("command_id"), "pump1_state", "pump2_state")
    j = ctx.join(tl, ["device_id", "command_id"])
    return j.select(
        F.col("command_id").alias("reading_id"), "device_id", "ts", "temperature", "humidity", "soil1", "soil2",
        "water", F.col("pump1_state").alias("pump1"), F.col("pump2_state").alias("pump2"),
        F.when(F.col("pump1_state") == "ON", 60).otherwise(0).cast("int").alias("pump1_duration"),
        F.when(F.col("pump2_state") == "ON", 60).otherwise(0).cast("int").alias("pump2_duration"),
        F.lit(1).cast("int").alias("manual_override"))


# J5 ------------------------------------------------------------------------

def decision_events(samples: DataFrame, commands: DataFrame, water_threshold: int = 250) -> DataFrame:
    """Samples, with what the device rule would set, and commands as one event
    stream. Samples with NaN/null temperature or humidity are dropped."""
    ok = samples.filter(F.col("temperature").isNotNull() & F.col("humidity").isNotNull()
                        & ~F.isnan("temperature") & ~F.isnan("humidity"))
    water_ok = F.col("water_raw") >= water_threshold
    as_readings = ok.select(
        "reading_id", "device_id", "ts", "temperature", "humidity",
        F.when(F.col("soil1_dry"), "DRY").otherwise("WET").alias("soil1"),
        F.when(F.col("soil2_dry"), "DRY").otherwise("WET").alias("soil2"),
        F.when(water_ok, "AVAILABLE").otherwise("NOT AVAILABLE").alias("water"),
        F.when(F.col("soil1_dry") & water_ok, "ON").otherwise("OFF").alias("pump1"),
        F.when(F.col("soil2_dry") & water_ok, "ON").otherwise("OFF").alias("pump2"))
    return event_stream(as_readings, commands)


def auto_pump_decision(samples: DataFrame, commands: DataFrame, water_threshold: int = 250) -> DataFrame:
    """The device rule. A sample with NaN/null temperature or humidity is
    dropped. If a manual command arrived since the previous sample, the pumps
    keep the commanded states; otherwise pump = soil dry and water level at or
    above ``water_threshold``, and that decision becomes the new state.

    ``samples``: device_id, ts, reading_id, temperature, humidity, soil1_dry,
    soil2_dry (boolean), water_raw (int).
    """
    # An overridden sample does not overwrite the commanded states.
    events = decision_events(samples, commands, water_threshold)
    out = _timeline(events, keep_commanded=True).filter(F.col("src") == 0)
    return out.select("device_id", "ts", F.col("event_id").alias("reading_id"), "manual_override",
                      F.col("pump1_state").alias("pump1"), F.col("pump2_state").alias("pump2"))
