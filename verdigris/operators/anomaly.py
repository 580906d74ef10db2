"""Robust statistics and alert screens (AGG-05, WIN-01, JOIN-01, FLT-07..09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.quantiles import DEFAULT_ACCURACY, exact_quantiles, median_and_mad
from verdigris.operators.timeseries import resolve_as_of, trailing


def facility_stats(metrics: DataFrame, as_of=None, days: int = 7, value: str = "co2_kg",
                   key: str = "facility_id", accuracy: int = DEFAULT_ACCURACY,
                   approximate: bool = False) -> DataFrame:
    """AGG-05: per-facility median and unscaled MAD over ``ts > as_of - days``.

    Exact, and safe for a facility holding a large share of rows (see
    ``functions.quantiles``)."""
    recent = trailing(metrics, days, as_of)
    return median_and_mad(recent, [key], value, "median_co2", "mad_co2", accuracy, approximate)


def robust_anomalies(metrics: DataFrame, as_of=None, stats_days: int = 7, recent_days: int = 1,
                     threshold: float = 3.0, value: str = "co2_kg", key: str = "facility_id", stats: DataFrame | None = None) -> DataFrame:
    """WIN-01: |x - median| / MAD > threshold for rows of the last
    ``recent_days``, against ``stats_days`` statistics, or ``stats`` that are
    there already (``daysketch.trailing_stats``, which reads no old day in
    full).  MAD = 0 gives a NULL score (no anomaly) instead of a division
    error."""
    a = resolve_as_of(metrics, as_of)
    if stats is None:
        stats = facility_stats(metrics, a, stats_days, value, key)
    recent = trailing(metrics, recent_days, a)
    z = F.try_divide(F.abs(F.col(value) - F.col("median_co2")), F.col("mad_co2"))
    return (recent.join(stats, key)                       # JOIN-01
                  .withColumn("z_score", z)
                  .filter(F.col("z_score") > threshold)
                  .select("ts", key, value, "z_score"))


def anomaly_scores(metrics: DataFrame, stats: DataFrame, value: str = "co2_kg",
                   key: str = "facility_id") -> DataFrame:
    """JOIN-01 on its own: every fact row with its facility's score."""
    z = F.try_divide(F.abs(F.col(value) - F.col("median_co2")), F.col("mad_co2"))
    return metrics.join(stats, key).withColumn("z_score", z)


def overload_alerts(readings: DataFrame, rated_power: float, power: str = "power") -> DataFrame:
    """FLT-07: power strictly above the rated power."""
    return (readings.filter(F.col(power) > F.lit(float(rated_power)))
                    .withColumn("alert", F.lit("overload")))


def leak_alerts(readings: DataFrame, flow: str = "flow_rate", valve_open: str = "valve_open",
                threshold: float = 0.1) -> DataFrame:
    """FLT-08: valve closed but flow above ``threshold`` L/min."""
    return (readings.filter(~F.col(valve_open) & (F.col(flow) > F.lit(float(threshold))))
                    .withColumn("alert", F.lit("leak")))


def iqr_bounds(df: DataFrame, value: str, keys=(), k: float = 1.5,
               accuracy: int = DEFAULT_ACCURACY, approximate: bool = False) -> DataFrame:
    """q1, q3 and the Tukey fences per group (exact, linear interpolation;
    ``approximate=True`` uses the sketch alone)."""
    q = exact_quantiles(df, list(keys), value, {"q1": 0.25, "q3": 0.75}, accuracy, approximate).drop("_n")
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)


def iqr_filter(df: DataFrame, value: str, keys=(), k: float = 1.5) -> DataFrame:
    """FLT-09: drop missing values and values outside the Tukey fences."""
    keys = list(keys)
    b = iqr_bounds(df, value, keys, k).select(*keys, "lower", "upper")
    if not keys:                                   # one row: a scalar, no join
        from verdigris.operators.joins import one_row
        s = one_row(b)
        return df.filter(F.col(value).isNotNull() & F.col(value).between(s["lower"], s["upper"]))
    j = df.join(b, keys)
    return (j.filter(F.col(value).isNotNull() & F.col(value).between(F.col("lower"), F.col("upper")))
             .drop("lower", "upper"))
