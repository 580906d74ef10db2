"""Row-wise carbon projections over DataFrames (PRJ-01/02/13/14/15/19/20,
JOIN-05, JOIN-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import carbon as C
from verdigris.operators.intervals import interval_lookup


def with_co2e(records: DataFrame, gwp_ch4: float = C.GWP_CH4, gwp_n2o: float = C.GWP_N2O) -> DataFrame:
    """PRJ-01 + PRJ-02: add ``co2e_kg`` and ``carbon_intensity``."""
    return (records.withColumn("co2e_kg", C.co2e_kg("co2_kg", "ch4_g", "n2o_g", gwp_ch4, gwp_n2o))
                   .withColumn("carbon_intensity", C.carbon_intensity("co2e_kg", "energy_kwh")))


def factor_lookup(records: DataFrame, categories: DataFrame, ts: str = "ts",
                  key: str = "source_type", max_broadcast_rows: int | None = None) -> DataFrame:
    """JOIN-05: validity-dated factor: effective_from <= ts < effective_to
    (NULL = open), left outer, with any number of versions per category
    (``operators.intervals``): dealt by category and day, so a category with
    all records and daily versions spreads over as many tasks as it has days.
    ``max_broadcast_rows`` is accepted for older callers and has no effect:
    one plan serves every size."""
    return interval_lookup(records, categories, key, "category_code", ["co2e_factor"], ts)


#: Scenarios that the base cases pass by at once, the bytes that a block of them may have, and the scenarios from which
#: base cases are dealt out first (a few rows in one task would meet all of them there).
BLOCK_SCENARIOS, MAX_BLOCK_BYTES, DEAL_FROM = 100_000, 64 << 20, 1_000


def _stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    from verdigris.operators.tables import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scenario_passes(base: DataFrame, scenarios, block_scenarios: int) -> list[DataFrame]:
    """The base cases adjusted by each block of scenarios.  With
    more blocks than one each pass is stored before the next begins, so the
    driver and the executors need one block at a time."""
    spark = base.sparkSession
    if not isinstance(scenarios, DataFrame):
        scenarios = spark.createDataFrame([(n, float(e), float(r)) for n, e, r in scenarios],
                                          "name string, efficiency double, renewable double")
    sc = scenarios.select(F.col("name").alias("_name"), F.col("efficiency").cast("double").alias("_efficiency"),
                          F.col("renewable").cast("double").alias("_renewable"))
    n_bytes = F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("_name").cast("string")), F.lit(0)) + 64), F.lit(0))
    n, size = sc.agg(F.count("*"), n_bytes).first()
    blocks = max(1, -(-n // block_scenarios), -(-2 * size // MAX_BLOCK_BYTES))
    if n >= DEAL_FROM:
        base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = [sc]
    if blocks > 1:
        # dealt by a row number that the write fixes, so repeated scenarios are spread too
        dealt = sc.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
        dealt = _stored(_stored(dealt, "scenarios").repartition("_block"), "scenario-blocks", "_block")
        size = dealt.groupBy("_block").agg(n_bytes.alias("b")).agg(F.max("b")).first()[0]
        parts = [dealt.where(F.col("_block") == b).drop("_block") for b in range(blocks)]
        base = _stored(base, "base-cases")
    if size > MAX_BLOCK_BYTES:
        raise ValueError(f"{size} bytes of scenarios exceed the broadcast bound of {MAX_BLOCK_BYTES}")
    keep = [c for c in base.columns if c not in ("energy_usage", "water_usage")]
    done = []
    for part in parts:
        out = base.crossJoin(F.broadcast(part)).select(
            *keep, F.col("_name").alias("scenario"),
            C.scenario_energy("energy_usage", "_efficiency", "_renewable").alias("energy_usage"),
            C.scenario_water("water_usage", "_efficiency").alias("water_usage"))
        done.append(_stored(out, "scenario-pass") if blocks > 1 else out)
    return done


def scenario_analysis(base: DataFrame, scenarios, block_scenarios: int = BLOCK_SCENARIOS) -> DataFrame:
    """JOIN-06 + PRJ-13 + SET-02: each base case unchanged (scenario
    'base') plus every base case adjusted by every scenario.

    Scenarios are (name, efficiency, renewable) tuples or a DataFrame of
    them, any number: a stated query set, dealt by hash into blocks that are
    broadcast (through the driver, size-checked); the base cases pass by each.
    The result has a row for each base case and scenario; for totals of many
    scenarios use ``scenario_totals``, which doesn't keep these rows."""
    out = base.withColumn("scenario", F.lit("base"))
    for rows in _scenario_passes(base, scenarios, block_scenarios):
        out = out.unionByName(rows)
    return out


def scenario_totals(base: DataFrame, scenarios, block_scenarios: int | None = None) -> DataFrame:
    """``scenario_analysis`` as one row per scenario: n, energy_usage and
    water_usage.  Scenarios scale usage, so their totals are those of the base
    scaled: the base cases are summed once, and each scenario reads the one
    row of sums (a scalar).  ``block_scenarios`` is accepted for older callers
    and has no effect."""
    from verdigris.operators.joins import one_row
    spark, sums = base.sparkSession, [F.sum(c).alias(c) for c in ("energy_usage", "water_usage")]
    if not isinstance(scenarios, DataFrame):
        scenarios = spark.createDataFrame([(n, float(e), float(r)) for n, e, r in scenarios],
                                          "name string, efficiency double, renewable double")
    total = base.agg(F.count("*").alias("n"), *sums)
    t = one_row(total)
    efficiency, renewable = F.col("efficiency").cast("double"), F.col("renewable").cast("double")
    each = scenarios.select(F.col("name").alias("scenario"), t["n"].alias("n"),
                            C.scenario_energy(t["energy_usage"], efficiency, renewable).alias("energy_usage"),
                            C.scenario_water(t["water_usage"], efficiency).alias("water_usage"))
    out = total.select(F.lit("base").alias("scenario"), "n", "energy_usage", "water_usage").unionByName(each).where(F.col("n") > 0)
    return out.groupBy("scenario").agg(F.sum("n").alias("n"), *sums)  # a name may be there several times


def with_interval(df: DataFrame, pred: str = "prediction", sigma: str = "sigma", z: float = 1.96) -> DataFrame:
    """PRJ-14: 95 % interval rounded to 2."""
    lo, hi = C.interval_bounds(pred, sigma, z)
    return df.withColumn("lower_bound", lo).withColumn("upper_bound", hi)


def abs_error(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """PRJ-19."""
    return df.withColumn("abs_error", F.abs(F.col(actual) - F.col(predicted)))


def prediction_ids(df: DataFrame, key_cols: list[str], prefix: str = "pred") -> DataFrame:
    """PRJ-20: deterministic id from a prefix and the row's key (not the
    wall clock, so a retried task writes the same id)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return df.withColumn("prediction_id", F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, 16)))
