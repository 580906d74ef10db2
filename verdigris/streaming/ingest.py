"""Structured Streaming operators (SRC-06, STR-01..07).

Streams read landed files (or Kafka, by format option) with a declared
schema; event time is cast to ``timestamp`` because streaming watermarks
reject ``timestamp_ntz``.  Sinks are idempotent per micro-batch id, and all
state lives in the checkpoint folder under the cluster's shared
``spark.checkpoint.dir``, so a lost executor or a restarted driver resumes
where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from verdigris.functions.time import bucket_step
from verdigris.operators.intervals import interval_lookup, version_intervals
from verdigris.operators.validate import Rule, tag_failures
from verdigris.session import hadoop_path
from verdigris.sources.sensors import normalise_messages


def read_stream(spark: SparkSession, path: str | None, schema: T.StructType, fmt: str = "parquet",
                ts: str = "ts", max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """SRC-06: a file stream with an explicit schema, or, with ``fmt='kafka'``
    (no path; ``subscribe`` and the like as options), the JSON objects of its
    messages by that schema; event time cast to ``timestamp`` for
    watermarking."""
    r = spark.readStream.format(fmt)
    for k, v in options.items():
        r = r.option(k, v)
    if fmt == "kafka":  # a fixed schema of its own, the message in ``value``
        df = json_messages(r.load(), schema)
    else:
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        df = r.schema(schema).load(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts in df.columns else df


def json_messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of JSON objects in the binary or text column ``value``;
    messages that aren't such objects give NULLs."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("_m")).select("_m.*")


def read_sensor_messages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-06 for JSON sensor messages, one object a line: landed lines
    normalised (PRJ-04); a line that isn't such an object gives NULLs."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    out = normalise_messages(r.load(path).withColumnRenamed("value", "payload"), "payload")
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent_parquet_sink(path: str, partition_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """STR-01 sink: each micro-batch is written to its own ``batch_id=N``
    folder with overwrite, so a replayed batch replaces, never duplicates."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def validated(stream: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """STR-01: tag rule failures; the sink keeps valid rows, rejects can go to
    their own sink from the same column."""
    return tag_failures(stream, rules)


def score_stream(stream: DataFrame, model, feature_cols: Sequence[str]) -> DataFrame:
    """STR-02: per-message scoring; rows missing a feature get an ``error``
    and no prediction instead of failing the stream.  All rows pass the model
    once, with 0 for a missing feature, whose prediction is then dropped."""
    known = F.lit(True)
    for c in feature_cols:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    inputs = {c: F.col(c) for c in feature_cols}
    filled = stream.withColumn("_given", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(feature_cols)]))
    filled = filled.withColumn("_known", known).withColumns({c: F.when(F.col("_known"), v).otherwise(F.lit(0)) for c, v in inputs.items()})
    out = model.transform(filled)
    given = {c: F.col(f"_given._{i}").alias(c) for i, c in enumerate(feature_cols)}
    return out.select(*[given.get(c, F.col(c)) for c in stream.columns],
                      F.when(F.col("_known"), F.col("prediction")).alias("prediction"),
                      F.when(~F.col("_known"), F.lit("missing feature")).alias("error"))


def tumbling_totals(stream: DataFrame, value: str, width: str = "1 day", delay: str = "1 hour",
                    keys: Sequence[str] = ("facility_id",), ts: str = "ts") -> DataFrame:
    """STR-04: watermarked tumbling buckets, aligned as the batch roll-ups'
    (weeks start on Mondays).  They group by Spark's own window over the
    event time, so late rows are dropped, append mode emits a bucket once the
    watermark has passed its end, and its state is freed then."""
    step = bucket_step(width)
    # windows count from 1970-01-01, a Thursday; multiples of days from 2000-01-03, a Monday
    days = int(step.split()[0]) if "day" in step else 0
    start = f"{(10959 % days)} days" if days > 1 else None
    window = F.window(ts, step, step, start) if start else F.window(ts, step)
    return (stream.withWatermark(ts, delay).groupBy(window.alias("_w"), *keys)
                  .agg(F.sum(value).alias("total"), F.count("*").alias("n"))
                  .select(F.col("_w.start").cast("timestamp_ntz").alias("bucket"), *keys, "total", "n"))


def deduplicate(stream: DataFrame, key: str = "sensor_id", unit: str = "minute", delay: str = "10 minutes",
                ts: str = "ts") -> DataFrame:
    """STR-05: one reading per sensor and interval within the watermark."""
    return (stream.withColumn("_slot", F.date_trunc(unit, ts)).withWatermark(ts, delay)
                  .dropDuplicatesWithinWatermark([key, "_slot"]))


def flag_against_stats(stream: DataFrame, stats: DataFrame, threshold: float = 3.0, value: str = "co2_kg",
                       key: str = "facility_id") -> DataFrame:
    """STR-07: stream-static join with a stored per-facility median/MAD table
    (AGG-05), flagging robust z-scores above the threshold."""
    z = F.try_divide(F.abs(F.col(value) - F.col("median_co2")), F.col("mad_co2"))
    return stream.join(stats, key).withColumn("z_score", z).filter(F.col("z_score") > threshold)


def publish_stats(stats: DataFrame, root: str, valid_from, version: str) -> None:
    """STR-07: adds a version of a per-key statistics table, valid from a time
    on, below ``root``.  A version is written once and never changed; a retry
    overwrites its own folder."""
    stats.withColumn("valid_from", F.lit(valid_from).cast("timestamp_ntz")).write.mode("overwrite").parquet(
        f"{root.rstrip('/')}/version={version}")


def flag_by_version(stats_root: str, out_root: str, threshold: float = 3.0, value: str = "co2_kg", key: str = "facility_id",
                    ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """STR-07 with statistics that change: a ``foreachBatch`` sink that gives
    each row the newest version of its key's statistics that isn't after the
    row (event time), whenever the row arrives.  The versions are read anew
    for each micro-batch, so published ones take effect without a restart;
    rows before a key's first version aren't flagged.  The as-of join is an
    interval join dealt by key and day."""
    def run(batch: DataFrame, batch_id: int) -> None:
        versions = version_intervals(batch.sparkSession.read.parquet(stats_root).drop("version"), key)
        rows = batch.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
        found = interval_lookup(rows, versions, key, key, ["median_co2", "mad_co2", "valid_from"], ts, "valid_from", "valid_to")
        z = F.try_divide(F.abs(F.col(value) - F.col("median_co2")), F.col("mad_co2"))
        found.withColumn("z_score", z).filter(F.col("z_score") > threshold).write.mode("overwrite").parquet(
            f"{out_root.rstrip('/')}/batch_id={batch_id}")
    return run


def run_available_now(query_df: DataFrame, checkpoint: str, mode: str = "append",
                      sink: str = "memory", name: str | None = None, foreach_batch=None,
                      path: str | None = None, timeout_s: float = 600, rocksdb: bool = False):
    """Drive a stream to completion over the data present now (tests, batch
    back-fills); the same query runs continuously with another trigger.  With
    ``rocksdb`` its state is kept in the RocksDB store; the setting holds for
    the start of this query and stays in its checkpoint."""
    conf = query_df.sparkSession.conf
    before = conf.get(STATE_STORE)
    if rocksdb:
        conf.set(STATE_STORE, ROCKSDB)
    try:
        return _drive(query_df, checkpoint, mode, sink, name, foreach_batch, path, timeout_s)
    finally:
        conf.set(STATE_STORE, before)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drive(query_df: DataFrame, checkpoint: str, mode: str, sink: str, name: str | None, foreach_batch, path: str | None,
           timeout_s: float):
    w = query_df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    elif sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink).option("path", path)
    q = w.start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    return q


BUFFER_STATE = "ts array<timestamp>, value array<double>"


def last_n_buffer(stream: DataFrame, n: int = 30, key: str = "facility_id", ts: str = "ts",
                  value: str = "kwh") -> DataFrame:
    """STR-06: keyed state holding the last ``n`` readings per facility (the
    live-metrics panel); each trigger emits the current buffer of the keys it
    touched.  State is at most ``n`` values per key, for keys of any type; see
    ``last_n_readings`` for state that idle keys give back."""
    out = f"{key} {stream.schema[key].dataType.simpleString()}, {ts} timestamp, {value} double"

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            old_ts, old_v = state.get
            buf = pd.DataFrame({ts: list(old_ts), value: list(old_v)})
        else:
            buf = pd.DataFrame({ts: pd.Series([], dtype="datetime64[us]"), value: pd.Series([], dtype="float64")})
        for pdf in pdfs:
            buf = pd.concat([buf, pdf[[ts, value]]], ignore_index=True)
        buf = buf.sort_values(ts, kind="stable").tail(n)
        state.update((buf[ts].tolist(), buf[value].tolist()))
        yield pd.DataFrame({key: k[0], ts: buf[ts].tolist(), value: buf[value].tolist()})
    return stream.groupBy(key).applyInPandasWithState(step, out, BUFFER_STATE, "update",
                                                      GroupStateTimeout.NoTimeout)


class LastReadings(StatefulProcessor):
    """The last ``n`` readings of a key as list state; with ``idle_ms`` a timer
    in event time deletes the state of a key without newer readings."""

    def __init__(self, n: int, key: str, ts: str, value: str, idle_ms: int | None):
        self.n, self.key, self.ts, self.value, self.idle_ms = n, key, ts, value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", "ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [(pd.Timestamp(r[0]), r[1]) for r in self.readings.get()]
        for pdf in rows:
            pdf = pdf[pdf[self.ts].notna()].nlargest(self.n, self.ts, keep="last")
            kept = sorted([*kept, *zip(pdf[self.ts], pdf[self.value], strict=True)], key=lambda x: x[0])[-self.n:]
        if not kept:
            return
        self.readings.put([(t.to_pydatetime(), v) for t, v in kept])
        if self.idle_ms is not None:
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(kept[-1][0].timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame({self.key: key[0], self.ts: [t for t, _ in kept], self.value: [v for _, v in kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.readings.clear()
        yield from ()

    def close(self) -> None:
        pass


def last_n_readings(stream: DataFrame, n: int = 30, key: str = "facility_id", ts: str = "ts", value: str = "kwh",
                    idle: str | None = None, delay: str = "1 hour") -> DataFrame:
    """STR-06 by ``transformWithState``: the last ``n`` readings per key, kept
    as list state in the RocksDB store (``run_available_now`` with
    ``rocksdb=True``), so state need not fit in memory; each trigger emits the
    buffers of the keys that it touched.  Keys may have any type.  With
    ``idle`` (an interval, e.g. '2 days') the state of a key is given back when
    the watermark, ``delay`` behind the newest reading of all, has passed its
    newest reading by so much; a later reading starts anew."""
    out = f"{key} {stream.schema[key].dataType.simpleString()}, {ts} timestamp, {value} double"
    rows = stream.select(key, ts, F.col(value).cast("double").alias(value))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    if idle:
        rows = rows.withWatermark(ts, delay)
    return rows.groupBy(key).transformWithStateInPandas(LastReadings(n, key, ts, value, idle_ms), out, "Update",
                                                        "EventTime" if idle else "None")


def pulse_state_batched(state_root: str, out_root: str, key: str = "sensor_id", ts: str = "ts",
                        litres_per_pulse: float = 0.00225) -> Callable[[DataFrame, int], None]:
    """STR-06 without per-key Python: a ``foreachBatch`` sink that keeps the
    pulse state (count, last two pulse times) in a versioned state table.

    Each micro-batch is first counted per sensor and time with partial
    aggregates, and of these counts the two newest per sensor are kept (a
    group limit before the shuffle), so pulses themselves are never shuffled;
    the reduced rows are merged with the newest earlier state version and
    written as version ``batch_id``.  A replayed batch reads the same earlier
    version and overwrites its own folder, so the state is exactly-once.
    Sensor ids may have any type."""
    def top2(*cands):
        arr = F.sort_array(F.filter(F.array(*cands), lambda x: x.isNotNull()), asc=False)
        return F.get(arr, 0), F.get(arr, 1)          # NULL when fewer than two pulses

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        b = batch.select(key, F.col(ts).cast("timestamp_ntz").alias("_t"))
        times = b.groupBy(key, "_t").agg(F.count(F.lit(1)).alias("_c"))
        newest = times.where(F.col("_t").isNotNull()).withColumn(
            "_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_t")))).where(F.col("_rn") <= 2)
        two = newest.groupBy(key).agg(F.max("_t").alias("_t1"), F.min("_t").alias("_lt"), F.count("*").alias("_times"),
                                      F.max(F.when(F.col("_rn") == 1, F.col("_c"))).alias("_c1"))
        second = F.when(F.col("_c1") >= 2, F.col("_t1")).when(F.col("_times") == 2, F.col("_lt"))
        summ = (times.groupBy(key).agg(F.sum("_c").alias("_n")).join(two, key, "left")
                .select(key, "_n", "_t1", second.alias("_t2")))
        versions = state_versions(spark, state_root)
        older = [v for v in versions if v < batch_id]
        prev = spark.read.parquet(f"{state_root}/batch_id={max(older)}") if older else None
        if prev is None:
            kind = batch.schema[key].dataType.simpleString()
            prev = spark.createDataFrame([], f"{key} {kind}, pulses long, last_ts timestamp_ntz, second_ts timestamp_ntz")
        m = summ.join(prev, key, "full")
        t1, t2 = top2(F.col("_t1"), F.col("_t2"), F.col("last_ts"), F.col("second_ts"))
        state = m.select(key, (F.coalesce("_n", F.lit(0)) + F.coalesce("pulses", F.lit(0))).alias("pulses"),
                         t1.alias("last_ts"), t2.alias("second_ts"))
        state.write.mode("overwrite").parquet(f"{state_root}/batch_id={batch_id}")
        saved = spark.read.parquet(f"{state_root}/batch_id={batch_id}")
        gap = F.timestamp_diff("MICROSECOND", F.col("second_ts"), F.col("last_ts")) / 1_000_000
        out = saved.join(summ.select(key), key, "left_semi").select(
            key, "pulses", (F.col("pulses") * litres_per_pulse).alias("total_litres"), "last_ts",
            F.try_divide(F.lit(litres_per_pulse), gap).alias("_f"))
        out = out.withColumn("last_flow_lpm", F.col("_f") * 60).drop("_f")
        out.write.mode("overwrite").parquet(f"{out_root}/batch_id={batch_id}")
        for v in older:  # a replay needs the version before this one, none earlier
            if v < max(older):
                _remove(spark, f"{state_root}/batch_id={v}")
    return run


def state_versions(spark: SparkSession, root: str) -> list[int]:
    """Batch ids of the state versions below ``root`` (two at most are kept),
    from the folder's listing; none before the first batch.  Errors fail the
    batch instead of starting anew."""
    p, fs = hadoop_path(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)
