"""AGG-05 / WIN-01 from stored daily sketches.

A day's rows are read once, when the day ends.  What is kept below ``root``:

* ``sketch/day=D``: for each facility the exact number, least and greatest
  value of the rows in each of its bins (bins grow by ``GROWTH``, so a facility
  has at most a few thousand, whatever its rows);
* ``values/day=D``: the values alone, clustered by facility and bin, so that a
  reader of few bins skips the rest of the files.

Sketches are mergeable by adding counts.  For a trailing window those of its
whole days are merged (rows of the day in which it begins are read), and say
exactly which bins can hold the order statistics that a median needs: the r-th
smallest value lies between the r-th smallest of the bins' least and of their
greatest values, and bins beyond these bounds are counted, not read.  Only the
values of the bins between are read, from which the rank is exact.  The median
absolute deviation goes the same way: with the median known, a bin's least and
greatest value bound its rows' deviations.

Null and NaN values count nowhere; rows without a time belong to no day; a null
facility is a facility of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.quantiles import stored
from verdigris.functions.time import time_bucket

#: Ratio of the edges of a bin, and what is added to its logarithm to make it positive for every double.
GROWTH, ABOVE = 1.02, 40_000


def bin_of(value: Column) -> Column:
    """The bin of a value, in the order of values; 0 for 0."""
    size = F.floor(F.log(F.abs(value)) / F.lit(math.log(GROWTH))).cast("int") + ABOVE
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0)


def _binned(rows: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    v = F.col(value).cast("double")
    kept = rows.where(F.col(ts).isNotNull() & v.isNotNull() & ~F.isnan(v))
    return kept.select(F.to_date(ts).alias("day"), F.col(key).alias("k"), bin_of(v).alias("bin"), v.alias("v"))


def _counted(binned: DataFrame, *by: str) -> DataFrame:
    return binned.groupBy(*by, "k", "bin").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def sketch_days(rows: DataFrame, root: str, key: str = "facility_id", value: str = "co2_kg", ts: str = "ts") -> None:
    """Keeps the sketch and the values of the days of ``rows``, which must be
    whole days; a day that is there already is replaced."""
    binned = _binned(rows, key, value, ts)
    for name, table in (("sketch", _counted(binned, "day")), ("values", binned)):
        (table.hint("rebalance", "day").sortWithinPartitions("day", "k", "bin").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root.rstrip('/')}/{name}"))


def _medians(bins: DataFrame, values: DataFrame, deviation: bool) -> DataFrame:
    """Per k the median m of the values, or with ``deviation`` of their
    distance from the given ``m``: bins (k, bin, c, low, high[, m]) bound the
    statistic of their rows; ``values`` are (k, bin, v)."""
    more = ["m"] if deviation else []
    total = Window.partitionBy("k")
    upto = [Window.partitionBy("k").orderBy(c).rangeBetween(Window.unboundedPreceding, 0) for c in ("low", "high")]
    x = (bins.withColumn("n", F.sum("c").over(total)).withColumn("r0", F.floor((F.col("n") - 1) / 2))
         .withColumn("r1", F.ceil((F.col("n") - 1) / 2))
         .withColumn("upto_low", F.sum("c").over(upto[0])).withColumn("upto_high", F.sum("c").over(upto[1])))
    x = (x.withColumn("from", F.min(F.when(F.col("upto_low") > F.col("r0"), F.col("low"))).over(total))
         .withColumn("to", F.min(F.when(F.col("upto_high") > F.col("r1"), F.col("high"))).over(total)))
    x = x.withColumn("below", F.sum(F.when(F.col("high") < F.col("from"), F.col("c")).otherwise(0)).over(total))
    wanted = x.where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to"))).select("k", "bin", "r0", "r1", "below", *more)
    a, b = values.alias("a"), wanted.alias("b")
    near = a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.bin") == F.col("b.bin")))
    d = F.abs(F.col("v") - F.col("m")) if deviation else F.col("v")
    counted = near.groupBy("b.k", "r0", "r1", "below", *more, d.alias("d")).agg(F.count("*").alias("c"))
    end = F.sum("c").over(Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    placed = counted.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    at = [F.max(F.when((F.col("start") <= F.col(r)) & (F.col(r) < F.col("end")), F.col("d"))) for r in ("r0", "r1")]
    half = F.when(F.first("r0") == F.first("r1"), at[0]).otherwise(at[0] + 0.5 * (at[1] - at[0]))
    return placed.groupBy("k", *more).agg(half.alias("mad" if deviation else "m"))


def trailing_stats(spark: SparkSession, root: str, rows: DataFrame, as_of, days: int = 7, key: str = "facility_id",
                   value: str = "co2_kg", ts: str = "ts") -> DataFrame:
    """AGG-05: per facility median and unscaled MAD over ``ts > as_of - days``,
    equal to ``anomaly.facility_stats``.  ``rows`` are the raw rows, of which
    only the day in which the window begins is read; all later days must have
    been kept by ``sketch_days``."""
    root, t = root.rstrip("/"), F.lit(as_of).cast("timestamp_ntz")
    start = t - F.expr(f"INTERVAL {int(days)} DAYS")
    edge = F.to_date(start)
    first = rows.where((F.col(ts) > start) & (F.col(ts) < time_bucket("1 day", start) + F.expr("INTERVAL 1 DAY")))
    first = stored(_binned(first, key, value, ts), "sketch-edge")
    later = spark.read.parquet(f"{root}/sketch").where((F.col("day") > edge) & (F.col("day") <= F.to_date(t)))
    parts = _counted(first).unionByName(later.select("k", "bin", "c", "least", "greatest"))
    bins = stored(parts.groupBy("k", "bin").agg(F.sum("c").alias("c"), F.min("least").alias("least"),
                                                F.max("greatest").alias("greatest")), "sketch-merged")
    values = (spark.read.parquet(f"{root}/values").where((F.col("day") > edge) & (F.col("day") <= F.to_date(t)))
              .select("k", "bin", "v").unionByName(first.select("k", "bin", "v")))
    median = stored(_medians(bins.withColumnsRenamed({"least": "low", "greatest": "high"}), values, False), "sketch-median")
    b, m = bins.alias("b"), median.alias("m")
    apart = b.join(m, F.col("b.k").eqNullSafe(F.col("m.k"))).select("b.*", "m.m")
    far = F.greatest(F.abs(F.col("least") - F.col("m")), F.abs(F.col("greatest") - F.col("m")))
    near = F.when(F.col("m").between(F.col("least"), F.col("greatest")), F.lit(0.0)).otherwise(
        F.least(F.abs(F.col("least") - F.col("m")), F.abs(F.col("greatest") - F.col("m"))))
    out = _medians(apart.withColumn("low", near).withColumn("high", far), values, True)
    return out.select(F.col("k").alias(key), F.col("m").alias("median_co2"), F.col("mad").alias("mad_co2"))
