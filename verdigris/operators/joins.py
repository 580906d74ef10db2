"""Lookup and latest-reading joins (JOIN-02/03/04, WIN-07).

Dimension lookups do not force a broadcast: a facility or user table is
small in practice but not provably so, so Spark's size estimate (and AQE's
runtime statistics) decide between broadcast and shuffled hash/sort-merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.timeseries import newest

DIMENSION_MAX_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows
    (a bounded ``limit(max_rows + 1).count()``); otherwise return it
    unchanged so the caller takes its shuffle-based path."""
    n = df.limit(max_rows + 1).count()
    return (F.broadcast(df), True) if n <= max_rows else (df, False)


def one_row(df: DataFrame):
    """The single row of a one-row frame (e.g. fitted statistics) as a
    struct-valued scalar subquery Column: attached to other rows without a
    join, computed once."""
    return df.select(F.struct(*df.columns).alias("_s")).scalar()


def latest_energy_water(energy: DataFrame, water: DataFrame, per_facility: bool = True) -> DataFrame:
    """JOIN-02.  ``per_facility=False`` is the literal reading: one newest
    row per table, joined on facility (empty unless they share it)."""
    if per_facility:
        e = energy.groupBy("facility_id").agg(F.max_by("kwh", F.struct("ts", "kwh")).alias("kwh"), F.max("ts").alias("ts"))
        w = water.groupBy("facility_id").agg(F.max_by("cubic_meters", F.struct("ts", "cubic_meters")).alias("cubic_meters"),
                                             F.max("ts").alias("ts"))
    else:
        e = newest(energy.select("facility_id", "kwh", "ts"))
        w = newest(water.select("facility_id", "cubic_meters", "ts"))
    return (e.alias("e").join(w.alias("w"), "facility_id")
             .select("facility_id", F.col("e.kwh").alias("last_energy"),
                     F.col("w.cubic_meters").alias("last_water"),
                     F.greatest("e.ts", "w.ts").alias("last_reading")))


def current_readings(energy: DataFrame, water: DataFrame, metrics: DataFrame) -> DataFrame:
    """WIN-07: current time, energy, water and CO2 per facility.  Each input
    is reduced to one row per facility by a partial aggregate before the
    (full outer) joins, so the joins see one row per key."""
    e = energy.groupBy("facility_id").agg(F.max_by("kwh", F.struct("ts", "kwh")).alias("last_energy"), F.max("ts").alias("e_ts"))
    w = water.groupBy("facility_id").agg(F.max_by("cubic_meters", F.struct("ts", "cubic_meters")).alias("last_water"),
                                         F.max("ts").alias("w_ts"))
    m = metrics.groupBy("facility_id").agg(F.max_by("co2_kg", F.struct("ts", "co2_kg")).alias("last_co2"), F.max("ts").alias("m_ts"))
    j = e.join(w, "facility_id", "full").join(m, "facility_id", "full")
    return j.select("facility_id", "last_energy", "last_water", "last_co2",
                    F.greatest("e_ts", "w_ts", "m_ts").alias("last_reading"))


def with_owner(records: DataFrame, owners: DataFrame, users: DataFrame) -> DataFrame:
    """JOIN-03: record -> creating user (name, role)."""
    return (records.join(owners, "order_key", "left")
                   .join(users.select(F.col("user_id").alias("created_by"), F.col("name").alias("owner_name"),
                                      F.col("role").alias("owner_role")), "created_by", "left"))


def with_facility(usage: DataFrame, facilities: DataFrame) -> DataFrame:
    """JOIN-03: usage -> facility (inner: FK guaranteed by VAL-15)."""
    return usage.join(facilities, "facility_id")


def combined_metrics(energy: DataFrame, water: DataFrame, metrics: DataFrame,
                     width: str = "1 day") -> DataFrame:
    """JOIN-04: ``combined_metrics`` view.  Each source is pre-aggregated to
    (facility, bucket) so the full outer join never fans out."""
    from verdigris.functions.time import time_bucket
    e = energy.groupBy("facility_id", time_bucket(width, "ts").alias("bucket")).agg(
        F.sum("kwh").alias("energy_kwh"))
    w = water.groupBy("facility_id", time_bucket(width, "ts").alias("bucket")).agg(
        F.sum("cubic_meters").alias("water_m3"))
    m = metrics.groupBy("facility_id", time_bucket(width, "ts").alias("bucket")).agg(
        F.sum("co2_kg").alias("co2_kg"), F.avg("anomaly_score").alias("anomaly_score"))
    return (e.join(w, ["facility_id", "bucket"], "full")
             .join(m, ["facility_id", "bucket"], "full"))
