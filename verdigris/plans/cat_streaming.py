"""Registered checks: streaming twins of batch operators (SRC-06, STR-01..07).

Each check runs a real Structured Streaming query with an ``availableNow``
trigger over the events file, writes every micro-batch to its own folder
(idempotent by batch id), and reads back the newest row per key, which is
what an update-mode consumer materialises.  The SQL twin is the batch
answer on the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.tables import scratch_path
from verdigris.plans import logical as L
from verdigris.plans.cat_timeseries import STATS_SQL, stats_sql
from verdigris.plans.catalog import register
from verdigris.plans.rounding import r, sql_r
from verdigris.streaming import ingest as S


def _events_stream(spark, d):
    schema = L.table(spark, d, "events").schema
    return S.read_stream(spark, d, schema, "parquet", pathGlobFilter="events.parquet")


def _events_in_parts(spark, d, late: bool = False):
    """The events as a stream of four micro-batches by time; with ``late`` a
    fifth brings rows of the first day again.  One scan deals them to parts;
    each part is then landed as as many files as the table's scan has
    partitions, and a micro-batch reads so many."""
    e, path, staged = L.table(spark, d, "events"), scratch_path(spark, "event-files"), scratch_path(spark, "event-parts")
    files = max(1, e.rdd.getNumPartitions())
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    first, span = low.timestamp(), high.timestamp() - low.timestamp() + 1
    part = F.greatest(F.lit(0), F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - first) * 4 / span)).cast("int")
    e.withColumn("_part", part).write.partitionBy("_part").parquet(staged)
    parts = spark.read.schema(e.withColumn("_part", part).schema).parquet(staged)
    for n in range(4):
        parts.where(F.col("_part") == n).drop("_part").repartition(files).write.mode("append").parquet(path)
    if late:  # the first day lies in the first part, or goes on into the next
        again = parts.where(F.to_date("ts") == F.lit(low.date())).drop("_part")
        again.repartition(files).write.mode("append").parquet(path)
    return S.read_stream(spark, path, e.schema, "parquet", max_files_per_trigger=files)


def _run_batches(spark, df: DataFrame, mode: str, name: str) -> DataFrame:
    out = scratch_path(spark, f"stream-{name}")
    S.run_available_now(df, scratch_path(spark, f"ckpt-{name}"), mode=mode,
                        foreach_batch=S.idempotent_parquet_sink(out))
    return spark.read.parquet(out)


def _latest_per_key(df: DataFrame, keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "batch_id")


def _feed(stream):
    return stream.select(F.col("event_id").alias("reading_id"), "ts", F.col("user_id").alias("sensor_id"),
                         F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
                         F.col("event_type").alias("kind"))


@register("str01_src06_stream_ingest", "STR-01", L.with_ctes("""
SELECT reading_id, sensor_id, value FROM sf WHERE value IS NOT NULL""", sf=L.SENSOR_FEED_SQL))
def str01(spark, d):
    from verdigris.operators.validate import required_present
    tagged = S.validated(_feed(_events_stream(spark, d)), required_present(["value"]))
    valid = tagged.filter(F.size("failed_rules") == 0).drop("failed_rules")
    got = _run_batches(spark, valid, "append", "ingest")
    return got.select("reading_id", "sensor_id", "value")


@register("str03_live_overload_alerts", "STR-03", L.with_ctes("""
SELECT ts, facility_id, kwh AS power FROM eu WHERE kwh > 40.0""", eu=L.ENERGY_USAGE_SQL))
def str03(spark, d):
    from verdigris.operators.anomaly import overload_alerts
    s = _events_stream(spark, d).filter(F.col("event_type").isin("click", "view")).select(
        "ts", F.col("user_id").alias("facility_id"), F.col("value").alias("power"))
    got = _run_batches(spark, overload_alerts(s, 40.0), "append", "alerts")
    return got.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "facility_id", "power")


@register("str04_tumbling_daily_totals", "STR-04", L.with_ctes(f"""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, facility_id, {sql_r('sum(co2_kg)')} AS total, count(*) AS n
FROM em GROUP BY 1, 2""", em=L.EMISSION_METRICS_SQL))
def str04(spark, d):
    s = _events_in_parts(spark, d).select("ts", F.col("user_id").alias("facility_id"), F.col("value").alias("co2_kg"))
    agg = S.tumbling_totals(s, "co2_kg", "1 day", "1 hour")
    got = _latest_per_key(_run_batches(spark, agg, "update", "tumbling"), ["bucket", "facility_id"])
    return got.select("bucket", "facility_id", r("total").alias("total"), "n")


@register("str04_closed_buckets_late_rows", "STR-04", L.with_ctes(f"""
SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS bucket, facility_id, {sql_r('sum(co2_kg)')} AS total, count(*) AS n
FROM em GROUP BY 1, 2 HAVING CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM em)""",
    em=L.EMISSION_METRICS_SQL))
def str04_closed(spark, d):
    """Append mode: a bucket comes out once, when the watermark has passed its
    end; the rows that a fifth file brings too late change nothing."""
    s = _events_in_parts(spark, d, late=True).select("ts", F.col("user_id").alias("facility_id"), F.col("value").alias("co2_kg"))
    got = _run_batches(spark, S.tumbling_totals(s, "co2_kg", "1 week", "1 hour"), "append", "closed")
    return got.select("bucket", "facility_id", r("total").alias("total"), "n")


@register("str05_dedupe_sensor_minute", "STR-05", L.with_ctes("""
SELECT DISTINCT sensor_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS slot FROM sf""", sf=L.SENSOR_FEED_SQL))
def str05(spark, d):
    s = _feed(_events_stream(spark, d))
    got = _run_batches(spark, S.deduplicate(s, "sensor_id", "minute"), "append", "dedupe")
    return got.select("sensor_id", F.col("_slot").cast("timestamp_ntz").alias("slot"))


@register("str06_keyed_pulse_state", "STR-06", L.with_ctes(f"""
SELECT sensor_id, count(*) AS pulses, {sql_r('count(*) * 0.00225')} AS total_litres, max(ts) AS last_ts
FROM sf WHERE kind = 'click' GROUP BY sensor_id""", sf=L.SENSOR_FEED_SQL))
def str06(spark, d):
    s = _feed(_events_in_parts(spark, d)).filter(F.col("kind") == "click")
    return _pulses(spark, s)


@register("str07_stream_static_flags", "STR-07", L.with_ctes(f"""
SELECT e.ts, e.facility_id, {sql_r('abs(e.co2_kg - s.median_co2) / nullif(s.mad_co2, 0)')} AS z_score
FROM em e JOIN stats s USING (facility_id)
WHERE abs(e.co2_kg - s.median_co2) / nullif(s.mad_co2, 0) > 3""", em=L.EMISSION_METRICS_SQL, stats=STATS_SQL))
def str07(spark, d):
    from verdigris.operators.anomaly import facility_stats
    stats = facility_stats(L.emission_metrics(spark, d), days=7)
    stats_path = scratch_path(spark, "stats")
    stats.write.parquet(stats_path)                      # the stored, slowly changing table
    s = _events_stream(spark, d).select("ts", F.col("user_id").alias("facility_id"), F.col("value").alias("co2_kg"))
    got = _run_batches(spark, S.flag_against_stats(s, spark.read.parquet(stats_path)), "append", "flags")
    return got.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "facility_id", r("z_score").alias("z_score"))


@register("str02_stream_scoring", "STR-02")
def str02(spark, d):
    from verdigris.operators import features as FE
    from verdigris.operators import forecast as FC
    cols = ["hour_sin", "hour_cos", "anomaly_score"]

    def prep(df):
        return FE.cyclical_hour(df.select("ts", F.col("user_id").alias("facility_id"), F.col("value").alias("co2_kg"),
                                          (F.get_json_object("props", "$.k").cast("double") / 100).alias("anomaly_score")))
    batch = prep(L.table(spark, d, "events"))
    res = FC.train_forecaster(batch, cols, "co2_kg", "linear", split="random")
    scored = S.score_stream(prep(_events_stream(spark, d)), res["model"], cols)
    got = _run_batches(spark, scored, "append", "scoring")
    return got.select("facility_id", "co2_kg", "prediction", "error")


@register("str06_last30_buffer", "STR-06", L.with_ctes("""
SELECT ts, facility_id, kwh FROM (
  SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts DESC) AS rn FROM eu) WHERE rn <= 30""",
    eu=L.ENERGY_USAGE_SQL))
def str06b(spark, d):
    s = _events_stream(spark, d).filter(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").alias("facility_id"), "ts", F.col("value").alias("kwh"))
    got = _run_batches(spark, S.last_n_buffer(s, 30), "update", "buffer")
    # the newest emitted buffer of each facility is its current panel
    last = got.withColumn("_m", F.max("batch_id").over(Window.partitionBy("facility_id"))) \
              .filter(F.col("batch_id") == F.col("_m"))
    return last.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "facility_id", "kwh")


@register("str06_pulse_state_batched", "STR-06", L.with_ctes(f"""
SELECT sensor_id, count(*) AS pulses, {sql_r('count(*) * 0.00225')} AS total_litres, max(ts) AS last_ts
FROM sf WHERE kind = 'click' GROUP BY sensor_id""", sf=L.SENSOR_FEED_SQL))
def str06c(spark, d):
    s = _feed(_events_stream(spark, d)).filter(F.col("kind") == "click")
    return _pulses(spark, s)


def _pulses(spark, s):
    state, out = scratch_path(spark, "pulse-state"), scratch_path(spark, "pulse-out")
    S.run_available_now(s, scratch_path(spark, "ckpt-pulse-batched"), mode="append",
                        foreach_batch=S.pulse_state_batched(state, out))
    got = _latest_per_key(spark.read.parquet(out), ["sensor_id"])
    return got.select("sensor_id", "pulses", r("total_litres").alias("total_litres"), "last_ts")


@register("src06_json_sensor_messages", "SRC-06", L.with_ctes("""
SELECT ts, value, unit, 'ok' AS status FROM (SELECT ts, value, event_type AS unit FROM events)"""))
def src06_json(spark, d):
    """JSON sensor messages, one object a line, over several files."""
    e, path = L.table(spark, d, "events"), scratch_path(spark, "messages")
    (e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("value").cast("string").alias("value"),
              F.col("event_type").alias("unit")).repartition(3).write.json(path))
    got = _run_batches(spark, S.read_sensor_messages(spark, path, max_files_per_trigger=1), "append", "messages")
    return got.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "unit", "status")


@register("str07_versioned_flags", "STR-07", L.with_ctes(f"""
SELECT e.ts, e.facility_id, s.valid_from, {sql_r('abs(e.co2_kg - s.median_co2) / nullif(s.mad_co2, 0)')} AS z_score
FROM em e ASOF JOIN versions s ON e.facility_id = s.facility_id AND e.ts >= s.valid_from
WHERE abs(e.co2_kg - s.median_co2) / nullif(s.mad_co2, 0) > 3""", em=L.EMISSION_METRICS_SQL,
    half="SELECT min(ts) AS low, date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) AS middle FROM em",
    one=stats_sql("SELECT * FROM em WHERE ts < (SELECT middle FROM half)"), two=stats_sql("SELECT * FROM em"),
    versions="SELECT one.*, date_trunc('day', low) + INTERVAL 1 DAY AS valid_from FROM one, half UNION ALL SELECT two.*, middle FROM two, half"))
def str07_versions(spark, d):
    """A version of the statistics is there before the stream starts; after
    two of four files the second one is published, valid from the middle of
    the time on, and the stream goes on from its checkpoint."""
    from verdigris.operators.anomaly import facility_stats
    em = L.emission_metrics(spark, d)
    low, high = em.agg(F.min("ts"), F.max("ts")).first()
    middle = (low + (high - low) / 2).replace(hour=0, minute=0, second=0, microsecond=0)
    root, out, ckpt = (scratch_path(spark, n) for n in ("stats-versions", "versioned-flags", "ckpt-versions"))
    days = (high - low).days + 2
    first_day = low.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=1)
    S.publish_stats(facility_stats(em.where(F.col("ts") < F.lit(middle)), middle, days), root, first_day, "1")
    e, path = L.table(spark, d, "events"), scratch_path(spark, "event-halves")
    for n, late in enumerate((False, True)):  # files of early rows, then files of late ones with some early rows among them
        half = e.where((F.col("ts") >= F.lit(middle)) | (F.col("event_id") % 5 == 0) if late else
                       (F.col("ts") < F.lit(middle)) & (F.col("event_id") % 5 != 0))
        half.repartition(2).write.mode("append").parquet(path)
        if late:
            S.publish_stats(facility_stats(em, high, days), root, middle, "2")
        s = S.read_stream(spark, path, e.schema, "parquet", max_files_per_trigger=1).select(
            "ts", F.col("user_id").alias("facility_id"), F.col("value").alias("co2_kg"))
        S.run_available_now(s, ckpt, foreach_batch=S.flag_by_version(root, f"{out}/run={n}"))
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    return got.select("ts", "facility_id", "valid_from", r("z_score").alias("z_score"))


@register("str06_last30_text_ids", "STR-06", L.with_ctes("""
SELECT ts, 'meter-' || CAST(facility_id AS VARCHAR) AS meter, kwh FROM (
  SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts DESC) AS rn FROM eu) WHERE rn <= 30""", eu=L.ENERGY_USAGE_SQL))
def str06_text(spark, d):
    """The last 30 readings of meters with text ids over three files, with a
    restart after the first."""
    e, path = L.table(spark, d, "events"), scratch_path(spark, "meter-files")
    out, ckpt = scratch_path(spark, "last-readings"), scratch_path(spark, "ckpt-last-readings")
    for n in range(3):
        e.where(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(path)
        if n == 1:
            continue
        s = S.read_stream(spark, path, e.schema, "parquet", max_files_per_trigger=1).filter(F.col("event_type").isin("click", "view"))
        s = s.select(F.concat(F.lit("meter-"), "user_id").alias("meter"), "ts", F.col("value").alias("kwh"))
        S.run_available_now(S.last_n_readings(s, 30, "meter"), ckpt, mode="update", foreach_batch=S.idempotent_parquet_sink(out),
                            rocksdb=True)
    got = spark.read.parquet(out)
    last = got.withColumn("_m", F.max("batch_id").over(Window.partitionBy("meter"))).filter(F.col("batch_id") == F.col("_m"))
    return last.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "meter", "kwh")


@register("str01_ingest_over_files", "STR-01", L.with_ctes("""
SELECT reading_id, sensor_id, value, 'valid' AS part FROM sf WHERE value IS NOT NULL
UNION ALL SELECT reading_id, sensor_id, value, 'rejected' FROM sf WHERE value IS NULL""", sf=L.SENSOR_FEED_SQL))
def str01_files(spark, d):
    """Valid rows and rejects over four micro-batches, each to its own sink."""
    from verdigris.operators.validate import required_present
    out, ckpt = scratch_path(spark, "ingest-parts"), scratch_path(spark, "ckpt-ingest-parts")
    tagged = S.validated(_feed(_events_in_parts(spark, d)), required_present(["value"]))
    sinks = {p: S.idempotent_parquet_sink(f"{out}/{p}") for p in ("valid", "rejected")}

    def write(batch, batch_id):
        sinks["valid"](batch.filter(F.size("failed_rules") == 0).drop("failed_rules"), batch_id)
        sinks["rejected"](batch.filter(F.size("failed_rules") > 0).drop("failed_rules"), batch_id)
    S.run_available_now(tagged, ckpt, foreach_batch=write)
    parts = [spark.read.parquet(f"{out}/{p}").select("reading_id", "sensor_id", "value", F.lit(p).alias("part")) for p in sinks]
    return parts[0].unionByName(parts[1])


@register("str02_scoring_errors", "STR-02", L.with_ctes(f"""
SELECT reading_id, value, CASE WHEN value IS NOT NULL THEN {sql_r('2 * value + 1')} END AS prediction,
       CASE WHEN value IS NULL THEN 'missing feature' END AS error FROM sf""", sf=L.SENSOR_FEED_SQL))
def str02_errors(spark, d):
    """A model that is known, over four micro-batches; failed readings have no
    feature and get an error row each."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    known = L.sensor_feed(spark, d).where("value is not null").withColumn("label", 2 * F.col("value") + 1)
    model = Pipeline(stages=[VectorAssembler(inputCols=["value"], outputCol="features"), LinearRegression(labelCol="label")]).fit(known)
    scored = S.score_stream(_feed(_events_in_parts(spark, d)), model, ["value"])
    got = _run_batches(spark, scored, "append", "scoring-errors")
    return got.select("reading_id", "value", r("prediction").alias("prediction"), "error")


@register("str03_live_leak_alerts", "STR-03", L.with_ctes("""
SELECT reading_id, facility_id, flow_rate FROM (
  SELECT event_id AS reading_id, user_id AS facility_id, event_type = 'purchase' AS valve_open, value / 100 AS flow_rate
  FROM events WHERE event_type IN ('purchase', 'signup')) WHERE NOT valve_open AND flow_rate > 0.1"""))
def str03_leaks(spark, d):
    from verdigris.operators.anomaly import leak_alerts
    s = _events_in_parts(spark, d).filter(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("reading_id"), F.col("user_id").alias("facility_id"), (F.col("event_type") == "purchase").alias("valve_open"),
        (F.col("value") / 100).alias("flow_rate"))
    return _run_batches(spark, leak_alerts(s), "append", "leaks").select("reading_id", "facility_id", "flow_rate")


@register("str05_dedupe_over_files", "STR-05", L.with_ctes("""
SELECT sensor_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS slot, count(*) AS n FROM (
  SELECT DISTINCT sensor_id, date_trunc('day', ts) AS ts FROM sf) GROUP BY 1, 2""", sf=L.SENSOR_FEED_SQL))
def str05_files(spark, d):
    """Duplicates of a sensor and day that lie in three files, each a
    micro-batch: one row of them all passes."""
    e, path = L.table(spark, d, "events"), scratch_path(spark, "dedupe-files")
    for n in range(3):
        e.where(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(path)
    s = _feed(S.read_stream(spark, path, e.schema, "parquet", max_files_per_trigger=1))
    got = _run_batches(spark, S.deduplicate(s, "sensor_id", "day", "400 days"), "append", "dedupe-files")
    return got.groupBy("sensor_id", F.col("_slot").cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"))
