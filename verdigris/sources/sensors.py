"""Sensor payloads: normalisation, calibration, bulk reads (SRC-06/07/08,
PRJ-04..07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.time import try_parse_ntz

# Generic sensor message (ts, value, unit, optional status and metadata).
MESSAGE_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("unit", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

# Simulated energy / water readings; a failed sensor sends only ``error``.
READING_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("sensor_id", T.StringType()),
    T.StructField("voltage", T.DoubleType()), T.StructField("current", T.DoubleType()),
    T.StructField("power", T.DoubleType()), T.StructField("energy", T.DoubleType()),
    T.StructField("power_factor", T.DoubleType()), T.StructField("flow_rate", T.DoubleType()),
    T.StructField("volume", T.DoubleType()), T.StructField("pressure", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("error", T.StringType()),
])


def normalise_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """PRJ-04: parse a JSON message, cast the value, default status 'ok' and
    an empty metadata map.  Unparseable values become NULL (reject later)."""
    m = F.from_json(F.col(payload), MESSAGE_SCHEMA)
    return (df.withColumn("_m", m)
              .withColumn("ts", try_parse_ntz(F.col("_m.ts")))
              .withColumn("value", F.col("_m.value").try_cast("double"))
              .withColumn("unit", F.col("_m.unit"))
              .withColumn("status", F.coalesce(F.col("_m.status"), F.lit("ok")))
              .withColumn("meta", F.coalesce(F.col("_m.meta"), F.create_map().cast("map<string,string>")))
              .drop("_m"))


def normalize_reading(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-05: keep kWh as a double, drop voltage and unknown fields."""
    return raw.select(*keep, F.col("kwh").try_cast("double").alias("kwh"))


def calibrate_baseline(df: DataFrame, value: str, key: str = "sensor_id", n: int = 10, ts: str = "ts",
                       tiebreak: str | None = None, out: str = "calibrated") -> DataFrame:
    """PRJ-06 / PRJ-07: subtract the mean of the first ``n`` readings of each
    sensor.  ``row_number() <= n`` is planned as a per-partition group limit
    before the shuffle, so a busy sensor ships only n rows per map task."""
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    first = (df.filter(F.col(value).isNotNull()).select(key, value, *[c for c in (ts, tiebreak) if c])
               .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n))
    base = first.groupBy(key).agg(F.avg(value).alias("_baseline"))
    return df.join(base, key).withColumn(out, F.col(value) - F.col("_baseline")).drop("_baseline")


def split_failed_readings(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """SRC-08 / SRC-07: good readings and failed ones (``error`` set)."""
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull())


def read_sensor_batches(spark, paths: Sequence[str], schema: T.StructType = READING_SCHEMA) -> DataFrame:
    """SRC-07 / SRC-08: the landed reading files of all sensors, one
    multi-path read with the union schema (no inference)."""
    return spark.read.schema(schema).json(list(paths))


def bulk_read(batch: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """SRC-07: one batch over all sensors; failed readings are removed from
    the result and returned separately."""
    ok = F.coalesce(F.col(status), F.lit("ok")) == "ok"
    return batch.filter(ok), batch.filter(~ok)
