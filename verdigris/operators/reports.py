"""ESG reports (AGG-06, AGG-07, AGG-19, SNK-12) on top of the
``combined_metrics`` join (JOIN-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.time import time_bucket
from verdigris.operators.joins import combined_metrics
from verdigris.operators.timeseries import prune_chunks, resolve_as_of


def esg_daily(energy: DataFrame, water: DataFrame, metrics: DataFrame, facility_id, start, end) -> DataFrame:
    """AGG-06: one facility's daily totals between two dates, in bucket
    order.  The facility and date predicates are applied to each source
    before the pre-aggregation, so they reach the parquet scans."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")

    def keep(df):
        return df.filter((F.col("facility_id") == F.lit(facility_id)) & F.col("ts").between(s, e))
    cm = combined_metrics(keep(energy), keep(water), keep(metrics))
    return (cm.groupBy("bucket").agg(F.sum("energy_kwh").alias("energy"), F.sum("water_m3").alias("water"),
                                     F.sum("co2_kg").alias("emissions"), F.avg("anomaly_score").alias("anomaly"))
              .orderBy("bucket"))


def esg_period_totals(energy: DataFrame, water: DataFrame, metrics: DataFrame, period: str = "week",
                      as_of=None) -> DataFrame:
    """AGG-07: totals over the trailing period (month = 30 days, else 7)."""
    days = 30 if period == "month" else 7
    a = resolve_as_of(metrics, as_of)
    start = a - F.expr(f"INTERVAL {days} DAYS")

    def keep(df):
        return df.filter(F.col("ts").between(start, a))
    from verdigris.operators.joins import one_row
    m = one_row(keep(metrics).agg(F.sum("co2_kg").alias("e"), F.avg("anomaly_score").alias("a")))
    return metrics.sparkSession.range(1).select(
        keep(energy).agg(F.sum("kwh")).scalar().alias("total_energy"),
        keep(water).agg(F.sum("cubic_meters")).scalar().alias("total_water"),
        m["e"].alias("total_emissions"), m["a"].alias("avg_anomaly"),
        start.cast("timestamp_ntz").alias("period_start"), a.alias("period_end"))


def nightly_rollup(metrics: DataFrame, path: str | None = None, as_of=None, days: int = 30) -> DataFrame:
    """AGG-19 as a recomputation: the AGG-01 roll-up per facility and day of
    the whole days that the trailing window touches, from the day in which it
    begins.  With ``path`` it is written with dynamic partition overwrite on
    the day; every written day is whole, so a nightly re-run never cuts an
    earlier one.  ``operators.rollups`` recomputes only the days that changed."""
    start = time_bucket("1 day", resolve_as_of(metrics, as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    recent = prune_chunks(metrics, start).filter(F.col("ts") >= start)
    out = (recent.groupBy(time_bucket("1 day", "ts").alias("bucket"), "facility_id")
           .agg(F.sum("co2_kg").alias("total_co2"), F.avg("anomaly_score").alias("avg_anomaly")))
    if path:
        (out.withColumn("day", F.to_date("bucket")).hint("rebalance", "day").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    return out
