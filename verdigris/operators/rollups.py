"""AGG-19 / AGG-01 kept up to date: mergeable daily states and a change log.

Rows arrive in runs, late rows of old days among them.  Below ``root``:

* ``arrivals/run_id=R/day=D``: one partial state (sum, count, least and
  greatest value) per facility and day of the rows that run R brought;
* ``changes/run_id=R``: the days that run R touched;
* ``rollup/day=D``: the roll-up, one row per facility;
* ``done/run_id=R``: the runs that the nightly run R has rolled up;
* ``base/version=N/day=D``: the merged states of many runs, and
  ``bases/version=N``: those runs, whose arrivals no longer count.

A nightly run takes the days of all runs that no earlier night has rolled up,
merges the states of just those days, of all runs, and overwrites those days.
So a day is always written whole, whenever in the day the night's cut falls,
and raw rows are read once, when they arrive.  Each folder belongs to one run or
day and is overwritten: a retried arrival or night leaves the same table, and a
night that fails before its ``done`` entry is taken up by the next one.

``compact`` merges the arrivals of all runs into a new base, so a day doesn't
keep one state for each run that ever touched it.  The base counts once its
list of runs is written; what it replaces is deleted after that, by a retry if
need be.  An arrival of a compacted run that is retried counts no second time.
A compaction and a night must not run at once.

Rows without a time belong to no day and are left out; a null facility is a
facility of its own; null values count in no sum (a day without any has NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.time import time_bucket
from verdigris.session import hadoop_path

_DAY, _DONE = "day date", "consumed string"


def partial_states(rows: DataFrame, width: str = "1 day", value: str = "co2_kg", score: str = "anomaly_score",
                   key: str = "facility_id", ts: str = "ts") -> DataFrame:
    """Mergeable state per bucket and facility."""
    return (rows.where(F.col(ts).isNotNull()).groupBy(time_bucket(width, ts).alias("bucket"), key)
            .agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_n"), F.min(value).alias("value_min"),
                 F.max(value).alias("value_max"), F.sum(score).alias("score_sum"), F.count(score).alias("score_n"),
                 F.count("*").alias("n")))


def merged(states: DataFrame, key: str = "facility_id") -> DataFrame:
    """States of the same bucket and facility as one."""
    sums = [F.sum(c).alias(c) for c in ("value_sum", "value_n", "score_sum", "score_n", "n")]
    return states.groupBy("bucket", key).agg(*sums, F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"))


def record_arrivals(rows: DataFrame, root: str, run_id: str, width: str = "1 day", **columns) -> None:
    """One run's rows as partial states, and the days that they touch.  The
    days are logged before the states are written: a night between the two
    recomputes a day in vain, but forgets none."""
    spark, root = rows.sparkSession, root.rstrip("/")
    ts = columns.get("ts", "ts")
    days = rows.where(F.col(ts).isNotNull()).select(F.to_date(time_bucket(width, ts)).alias("day")).distinct()
    days.write.mode("overwrite").parquet(f"{root}/changes/run_id={run_id}")
    states = partial_states(rows, width, **columns).withColumn("day", F.to_date("bucket"))
    states.write.mode("overwrite").partitionBy("day").parquet(f"{root}/arrivals/run_id={run_id}")
    _log(spark, f"{root}/ready/run_id={run_id}", [run_id])


def _log(spark: SparkSession, path: str, runs: list[str]) -> None:
    spark.createDataFrame([(r,) for r in runs], _DONE).coalesce(1).write.mode("overwrite").parquet(path)


def _runs(spark: SparkSession, path: str) -> set[str]:
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return set()
    return {r.consumed for r in spark.read.schema(_DONE).parquet(path).collect()}  # one name for each run


def _folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _base(spark: SparkSession, root: str) -> tuple[int, set[str]]:
    """The newest base (0: none) and the runs in it."""
    for version in sorted((int(f.split("=")[1]) for f in _folders(spark, f"{root}/bases")), reverse=True):
        p, fs = hadoop_path(spark, f"{root}/bases/version={version}/_SUCCESS")
        if fs.exists(p):
            return version, _runs(spark, f"{root}/bases/version={version}")
    return 0, set()


def _states(spark: SparkSession, root: str) -> DataFrame | None:
    """States of the base and of the complete arrivals that came after it."""
    version, consumed = _base(spark, root)
    ready = _runs(spark, f"{root}/ready")
    arrivals = [f"{root}/arrivals/{f}" for f in _folders(spark, f"{root}/arrivals") if f.removeprefix("run_id=") in ready - consumed]
    arrivals = [a for a in arrivals if any(f.startswith("day=") for f in _folders(spark, a))]  # a run may have no rows
    parts = []
    if arrivals:
        parts.append(spark.read.option("basePath", f"{root}/arrivals").parquet(*arrivals).drop("run_id"))
    if _folders(spark, f"{root}/base/version={version}"):
        parts.append(spark.read.parquet(f"{root}/base/version={version}"))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None


def compact(spark: SparkSession, root: str, key: str = "facility_id") -> int:
    """Merges the arrivals of all runs into a new base; returns its version."""
    root = root.rstrip("/")
    version, consumed = _base(spark, root)
    ready = _runs(spark, f"{root}/ready")
    states = _states(spark, root)
    if ready - consumed and states is not None:
        version += 1
        (merged(states, key).withColumn("day", F.to_date("bucket")).hint("rebalance", "day")
         .write.mode("overwrite").partitionBy("day").parquet(f"{root}/base/version={version}"))
        consumed |= ready
        _log(spark, f"{root}/bases/version={version}", sorted(consumed))
    for kept, folder in ((set(), "arrivals"), ({version}, "base"), ({version}, "bases")):
        for f in _folders(spark, f"{root}/{folder}"):
            name = f.split("=", 1)[1]
            if name in consumed if folder == "arrivals" else int(name) not in kept:
                p, fs = hadoop_path(spark, f"{root}/{folder}/{f}")
                fs.delete(p, True)
    return version


def roll_up_changes(spark: SparkSession, root: str, run_id: str, key: str = "facility_id") -> list:
    """The nightly run: recomputes the days touched since the last one and
    returns them."""
    root = root.rstrip("/")
    open_runs = sorted(_runs(spark, f"{root}/ready") - _runs(spark, f"{root}/done"))
    if not open_runs:
        return []
    changes = spark.read.schema(_DAY).parquet(*[f"{root}/changes/run_id={r}" for r in open_runs])
    days = sorted(r.day for r in changes.distinct().collect())  # one date for each touched day
    if days:
        states = _states(spark, root).where(F.col("day").isin(days))  # prunes folders
        out = merged(states, key).withColumn("day", F.to_date("bucket"))
        # by day, but a large day goes to several tasks
        (out.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day").parquet(f"{root}/rollup"))
    _log(spark, f"{root}/done/run_id={run_id}", open_runs)
    return days


def rolled_up(spark: SparkSession, root: str, start=None, end=None, key: str = "facility_id") -> DataFrame:
    """The roll-up's rows (AGG-01's columns and the state's counts, least and
    greatest value) of the days from ``start`` to ``end``, both included."""
    out = spark.read.parquet(f"{root.rstrip('/')}/rollup")
    if start is not None:
        out = out.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("day") <= F.lit(end).cast("date"))
    return out.select("bucket", key, F.col("value_sum").alias("total_co2"),
                      F.try_divide("score_sum", F.nullif("score_n", F.lit(0))).alias("avg_anomaly"),
                      "n", "value_min", "value_max", "day")
