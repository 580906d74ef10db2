"""Model monitoring aggregates (AGG-09, 10, 13..17).

All are single-pass aggregates (partial on the map side, one small final
merge); histograms are counted per bin, never collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_summary(preds: DataFrame, value: str = "co2e_kg") -> DataFrame:
    """AGG-09: mean, population std, total, min, max of values already
    rounded to 2 places, each rounded to 2."""
    v = F.round(F.col(value), 2)
    return preds.agg(F.round(F.avg(v), 2).alias("mean"), F.round(F.stddev_pop(v), 2).alias("std_dev"),
                     F.round(F.sum(v), 2).alias("total"), F.round(F.min(v), 2).alias("min"),
                     F.round(F.max(v), 2).alias("max"))


def processed_failed(preds: DataFrame, value: str = "co2e_kg") -> DataFrame:
    """AGG-10: rows scored vs rows that failed (no prediction)."""
    return preds.agg(F.count_if(F.col(value).isNotNull()).alias("processed"),
                     F.count_if(F.col(value).isNull()).alias("failed"))


def forecast_accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """AGG-13: max(0, 100 - 100 * mean |actual - predicted|) to one decimal;
    0 for an empty input."""
    mean_err = F.avg(F.abs(F.col(actual) - F.col(predicted)))
    acc = F.greatest(F.lit(0.0), F.lit(100.0) - mean_err * 100)
    return df.agg(F.coalesce(F.round(acc, 1), F.lit(0.0)).alias("accuracy"))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       keys: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """AGG-14 (AGG-15 with ``keys``): MAE, MSE, RMSE and R^2 = 1 - SSres/SStot
    with SStot = n var_pop(actual); R^2 is NULL when SStot = 0."""
    e = F.col(actual) - F.col(predicted)
    ss_tot = F.var_pop(actual) * F.count(actual)
    aggs = [F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (F.lit(1.0) - F.try_divide(F.sum(e * e), F.when(ss_tot != 0, ss_tot))).alias("r2"),
            F.count("*").alias("n"), *more]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def metrics_by_version(preds: DataFrame, as_of=None, days: int = 30, ts: str = "ts",
                       actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """AGG-15: per model version over the trailing window, plus the time of
    the latest prediction."""
    from verdigris.operators.timeseries import trailing
    recent = trailing(preds, days, as_of, ts)
    return regression_metrics(recent, actual, predicted, ["model_version"], [F.max(ts).alias("last_prediction")])


def _binned(df: DataFrame, value: str, lo, hi, bins: int) -> DataFrame:
    """Bin index 1..bins with the last bin closed; zero range -> bin 1."""
    width = hi - lo
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.greatest(F.lit(1), F.floor((F.col(value) - lo) / width * bins).cast("int") + 1)))
    return df.filter(F.col(value).isNotNull()).select(b.alias("bin"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """AGG-08: equal-width histogram over [min, max] (numpy-style: last bin
    closed).  All bins are returned, empty ones with count 0."""
    from verdigris.operators.joins import one_row
    rng = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    lo, hi = rng["lo"], rng["hi"]
    counts = _binned(df, value, lo, hi, bins).groupBy("bin").agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    w = (hi - lo) / bins
    return (spine.join(counts, "bin", "left")                     # at most `bins` rows each side
                 .select("bin", (lo + (F.col("bin") - 1) * w).alias("lower"), (lo + F.col("bin") * w).alias("upper"),
                         F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def drift(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, threshold: float = 0.15,
          aligned: bool = True, eps: float = 1e-6) -> DataFrame:
    """AGG-16: KL(reference || current) over 10-bin histograms; p = 0 terms
    dropped; drift when > threshold.

    ``aligned=True`` (default): both samples binned on the reference's
    edges (current values outside are clamped into the end bins), bin masses,
    empty current bins smoothed to ``eps``.  ``aligned=False`` reproduces the
    source: each sample on its own range, densities (count / (n width))."""
    from verdigris.operators.joins import one_row

    def dist(df, rng, tag):
        lo, hi = rng["lo"], rng["hi"]
        c = _binned(df, value, lo, hi, bins).groupBy("bin").agg(F.count("*").alias("c"))
        n = F.sum("c").over(Window.partitionBy())        # over at most `bins` rows
        share = (F.col("c") / n) if aligned else F.try_divide(F.col("c"), n * ((hi - lo) / bins))
        return c.select("bin", share.alias(tag))
    ref_rng = one_row(reference.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    cur_rng = ref_rng if aligned else one_row(current.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    p = dist(reference, ref_rng, "p")
    q = dist(current, cur_rng, "q")
    j = p.join(q, "bin", "full")
    qv = F.greatest(F.coalesce(F.col("q"), F.lit(0.0)), F.lit(eps)) if aligned else F.col("q")
    term = F.when(F.coalesce(F.col("p"), F.lit(0.0)) != 0, F.col("p") * F.ln(F.try_divide(F.col("p"), qv)))
    out = j.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("kl_divergence"))
    return out.withColumn("drift_detected", F.col("kl_divergence") > threshold)


def feature_importance(contributions: DataFrame, feature: str = "feature",
                       contribution: str = "contribution") -> DataFrame:
    """AGG-17: mean absolute attribution per feature (long format input)."""
    return contributions.groupBy(feature).agg(F.avg(F.abs(contribution)).alias("importance"))
