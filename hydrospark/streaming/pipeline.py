"""Structured Streaming wiring for the ⟳ operators.

* Stateless parts (S1/S2 ingest, R1-R4 rules, J1 settings, alert texts) are the
  batch functions applied to a streaming DataFrame.
* Ordered parts (W4/W5 pump runs, W6 cooldown, W7 states, J5 decisions) are
  folds per device of ``ordered_fold``: each device is judged by its own clock,
  there is no global watermark, and a row that comes too late to be folded in
  order leaves the same query with ``late`` set, for a batch replay.
* S8 joins the two landed weather feeds with a bound on their distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators.alerts import mail_gate, reading_alerts, run_alerts, with_settings
from hydrospark.operators.sequences import decision_events, event_stream, plant_rows
from hydrospark.sources.ingest import ingest
from hydrospark.sources.weather import join_feeds
from hydrospark.streaming.ordered_fold import fold_stream, from_micros, micros

ALERT_SCHEMA = ("device_id long, reading_id long, ts timestamp_ntz, rule_pos int, type string, "
                "severity string, message string")
_RUN = ("plant int, reading_id long, ts long, soil string, pump string, run_start boolean, run_start_ts long")


def payload_stream(spark: SparkSession, folder: str, schema, max_bytes: int = 8 << 30,
                   max_files: int | None = None) -> DataFrame:
    """Posted payloads landed as Parquet files. The bound (in bytes, or in files
    if given) holds for a backfill too: a micro-batch never takes in more than
    this, so no task holds more of a device than its share of it."""
    bound = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    return spark.readStream.schema(schema).option(*bound).parquet(folder)


def ingest_stream(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1/S2 on a stream of ``payload`` rows: (accepted, rejects)."""
    return ingest(raw)


def _run_step():
    def step(state, row):
        last, start = state or (None, None)
        pump, rises = row.get("pump"), False
        if pump == "ON":
            rises = last != "ON"
            if rises:
                start = row["ts"]
        elif pump == "OFF":  # only an explicit OFF ends a run
            start = None
        if pump is not None:
            last = pump
        made = {**row, "run_start": rises, "run_start_ts": start if pump == "ON" else None}
        return [last, start], [made]
    return step


def pump_runs_stream(readings: DataFrame, wait_seconds: float = 0, idle_seconds: float | None = None) -> DataFrame:
    """``operators.sequences.pump_runs`` on a stream: every device-posted plant
    row once, with ``run_start`` and ``run_start_ts``, or with ``late`` set and
    not folded."""
    p = plant_rows(readings.filter(F.col("manual_override") == 0)).select(
        "device_id", F.col("plant").cast("int").alias("plant"), "reading_id", "ts", "soil", "pump")
    out = fold_stream(p, ["device_id", "plant"], [micros(F.col("ts")), F.col("reading_id")], _run_step(), _RUN,
                      wait_seconds, idle_seconds)

    def of(c):
        return F.coalesce(F.col(f"out.{c}"), F.col(f"row.{c}"))
    return out.select("device_id", "plant", of("reading_id").alias("reading_id"), from_micros(of("ts")).alias("ts"),
                      of("soil").alias("soil"), of("pump").alias("pump"),
                      F.coalesce(F.col("out.run_start"), F.lit(False)).alias("run_start"),
                      from_micros(F.col("out.run_start_ts")).alias("run_start_ts"), "late")


def pump_alert_stream(readings: DataFrame, settings: DataFrame, wait_seconds: float = 0,
                      idle_seconds: float | None = None) -> DataFrame:
    """W4 + W5 on a stream of readings (device posts only) with the dry duration
    of each device; late readings are rows of type ``late_reading`` with
    ``late`` set and the plant as ``rule_pos``."""
    runs = pump_runs_stream(readings, wait_seconds, idle_seconds)
    return run_alerts(with_settings(runs, settings))


def late_readings_stream(readings: DataFrame) -> DataFrame:
    """The readings that W4 and W5 could not fold, as (device_id, plant,
    reading_id, ts). A query of its own has batches of its own: to keep what this
    leaves out as well, write both from one query (``alert_stream``)."""
    return pump_runs_stream(readings).filter("late").select("device_id", "plant", "reading_id", "ts")


def alert_stream(readings: DataFrame, settings: DataFrame, wait_seconds: float = 0,
                 idle_seconds: float | None = None) -> DataFrame:
    """R5 on a stream: alert rows and, with ``late`` set, the readings that the
    pump rules could not fold, from one query over one state."""
    device_rows = readings.filter(F.col("manual_override") == 0)
    stateless = reading_alerts(device_rows, settings).select(
        "device_id", "reading_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "rule_pos", "type", "severity",
        "message", F.lit(False).alias("late"))
    return stateless.unionByName(pump_alert_stream(readings, settings, wait_seconds, idle_seconds))


def _throttle_step():
    def step(last, row):
        if last is None or row["ts"] - last >= row["_cooldown"] * 1_000_000:
            return row["ts"], [row]
        return last, []
    return step


def notification_stream(alerts: DataFrame, settings: DataFrame, key: str = "severity",
                        stored: DataFrame | None = None, wait_seconds: float = 0,
                        idle_seconds: float | None = None) -> DataFrame:
    """R6 on a stream: the mail gate with the enable switches (J4), then the
    greedy cooldown (W6) per (device, key), by the settings of the device where
    it has its own. Kept alerts, and alerts that came too late to be judged in
    order with ``late`` set.

    ``stored`` is the cooldown table (device_id, alert_type, last_sent) of what
    was sent before; a new query starts from it, and
    ``operators.maintenance.cooldown_upsert`` over the kept alerts makes the
    table for the next batch job or query."""
    columns = [f.split()[0] for f in ALERT_SCHEMA.split(", ")]
    enabled = mail_gate(alerts.select(*columns), settings, key)
    initial = None
    if stored is not None:
        initial = stored.groupBy("device_id", F.col("alert_type").alias(key)).agg(
            F.max(micros(F.col("last_sent"))).cast("string").alias("state_text"))
    out = fold_stream(enabled, ["device_id", key], [micros(F.col("ts")), F.col("reading_id"), F.col("rule_pos")],
                      _throttle_step(), ALERT_SCHEMA.replace("timestamp_ntz", "long") + ", _cooldown int", wait_seconds,
                      idle_seconds, initial)
    row = out.select(F.coalesce("out", "row").alias("r"), "late").select("r.*", "late")
    return row.withColumn("ts", from_micros(F.col("ts"))).select(*columns, "late")


def late_alerts_stream(alerts: DataFrame, settings: DataFrame, key: str = "severity") -> DataFrame:
    """Alerts that the cooldown could not judge in order (see
    ``late_readings_stream``)."""
    return notification_stream(alerts, settings, key).filter("late").drop("late")


def _state_step(keep_commanded: bool):
    def step(state, row):
        pumps, after_command = state or (["OFF", "OFF"], False)
        pumps = list(pumps)
        if row["src"] == 0:
            held = after_command
            if not (keep_commanded and held):
                pumps = [row.get("e1") or pumps[0], row.get("e2") or pumps[1]]
        else:
            held = False
            for i in (0, 1):
                if row.get(f"t{i + 1}"):
                    pumps[i] = "OFF" if pumps[i] == "ON" else "ON"
                pumps[i] = row.get(f"e{i + 1}") or pumps[i]
        made = {"ts": row["ts"], "src": row["src"], "event_id": row["event_id"], "pump": row.get("pump"),
                "action": row.get("action"), "pump1_state": pumps[0], "pump2_state": pumps[1], "manual_override": held}
        return [pumps, row["src"] == 1], [made]
    return step


def _states(events: DataFrame, keep_commanded: bool, wait_seconds: float, idle_seconds: float | None) -> DataFrame:
    narrow = events.select("device_id", "ts", "src", "event_id", "e1", "e2", "t1", "t2", "pump", "action")
    out = fold_stream(narrow, ["device_id"], [micros(F.col("ts")), F.col("src"), F.col("event_id")],
                      _state_step(keep_commanded),
                      "ts long, src int, event_id long, pump string, action string, pump1_state string, "
                      "pump2_state string, manual_override boolean", wait_seconds, idle_seconds)

    def of(c):
        return F.coalesce(F.col(f"out.{c}"), F.col(f"row.{c}")).alias(c)
    return out.select("device_id", from_micros(of("ts")).alias("ts"), of("src"), of("event_id"), of("pump"),
                      of("action"), "out.pump1_state", "out.pump2_state", "out.manual_override", "late")


def pump_state_stream(readings: DataFrame, commands: DataFrame, wait_seconds: float = 0,
                      idle_seconds: float | None = None) -> DataFrame:
    """W7 on streams of readings and commands: ``pump_state_timeline`` with
    ``late``; late rows have no states."""
    r = _states(event_stream(readings, commands), False, wait_seconds, idle_seconds)
    return r.select("device_id", "ts", F.when(F.col("src") == 0, "telemetry").otherwise("command").alias("source"),
                    "event_id", "pump", "action", "pump1_state", "pump2_state", "late")


def auto_pump_stream(samples: DataFrame, commands: DataFrame, water_threshold: int = 250, wait_seconds: float = 0,
                     idle_seconds: float | None = None) -> DataFrame:
    """J5 on streams of samples and commands, one state per device over both:
    pump states and whether the last row was a command. Samples with their
    decision, and late samples and commands (``source``) without one."""
    r = _states(decision_events(samples, commands, water_threshold), True, wait_seconds, idle_seconds)
    return r.where((F.col("src") == 0) | F.col("late")).select(
        "device_id", "ts", F.when(F.col("src") == 0, "sample").otherwise("command").alias("source"),
        F.col("event_id").alias("reading_id"), "manual_override", F.col("pump1_state").alias("pump1"),
        F.col("pump2_state").alias("pump2"), "late")


def weather_stream(current: DataFrame, forecast: DataFrame, bound_minutes: int = 5,
                   delay: str = "1 hour") -> DataFrame:
    """S8 on streams of the two landed feeds (see ``sources.weather.join_feeds``):
    rows leave when matched, or unmatched once the watermark ``delay`` behind the
    newest feed row has passed the bound."""
    def marked(df):
        return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = join_feeds(marked(current), marked(forecast), bound_minutes)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "forecast_ts")})


def run_available_now(df: DataFrame, name: str, checkpoint: str, timeout_s: int = 600):
    """Drain everything available into a memory table (tests, backfills).
    Raises if the query fails or does not finish within ``timeout_s``."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append") \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finished = q.awaitTermination(timeout_s)
    if not finished:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s: {q.exception()}")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def start_ingest_job(raw: DataFrame, settings: DataFrame, out_dir: str, checkpoint_dir: str,
                     trigger: dict | None = None, key: str = "severity", stored: DataFrame | None = None,
                     wait_seconds: float = 0, idle_seconds: float | None = None) -> dict:
    """The ingest flow as streaming queries: posted payloads -> accepted
    readings (Parquet partitioned by date, K1) and rejects; readings -> alert
    rows (R5); alerts -> notifications (R6). ``alerts`` and ``notifications``
    are partitioned by ``late``: what could not be folded in order stands in
    ``late=1`` of the same table, written by the same query, so each reading
    and each alert is in one of the two. Bound a trigger through the source
    (``payload_stream``).

    Two stateful steps cannot share one streaming query, so the flow is
    multi-hop: the notifications query streams from the alerts sink folder.
    Every sink is a file sink with its own checkpoint folder (exactly-once,
    restartable); ``checkpoint_dir`` must be shared storage. With an
    ``availableNow`` trigger the second hop starts once the first is drained.
    Returns the started queries by name."""
    trig = trigger or {"availableNow": True}
    drain = "availableNow" in trig or "once" in trig
    ok, bad = ingest(raw)

    def sink(df, name, partition=None):
        w = df.writeStream.format("parquet").option("path", f"{out_dir}/{name}") \
            .option("checkpointLocation", f"{checkpoint_dir}/{name}").outputMode("append").queryName(name)
        if partition:
            w = w.partitionBy(partition)
        return w.trigger(**trig).start()

    def flagged(df):  # folders late=0 and late=1
        return df.withColumn("late", F.col("late").cast("int"))

    queries = {
        "readings": sink(ok.withColumn("date", F.to_date("ts")), "readings", "date"),
        "rejects": sink(bad, "rejects"),
        "alerts": sink(flagged(alert_stream(ok, settings, wait_seconds, idle_seconds)), "alerts", "late"),
    }
    if drain:
        queries["alerts"].awaitTermination()
    alert_rows = raw.sparkSession.readStream.schema(ALERT_SCHEMA + ", late int").parquet(f"{out_dir}/alerts")
    sent = notification_stream(alert_rows.where("late = 0").drop("late"), settings, key, stored, wait_seconds, idle_seconds)
    queries["notifications"] = sink(flagged(sent), "notifications", "late")
    return queries
