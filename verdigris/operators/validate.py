"""Validation: split rows into valid and rejected, with the failed rule
names carried on each reject (VAL-01..17).

A rule is ``(name, predicate)``; the predicate is True for a good row.  A
NULL predicate (e.g. a NULL required field) counts as a failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.time import epoch_micros, interval

Rule = tuple[str, Column]


def tag_failures(df: DataFrame, rules: Sequence[Rule], out: str = "failed_rules") -> DataFrame:
    """Add ``failed_rules: array<string>`` (empty when the row is valid)."""
    checks = [F.when(~F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in rules]
    return df.withColumn(out, F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``failed_rules``).  Both come from
    one tagged plan; persist ``df`` upstream if both are consumed."""
    tagged = tag_failures(df, rules)
    valid = tagged.filter(F.size("failed_rules") == 0).drop("failed_rules")
    rejects = tagged.filter(F.size("failed_rules") > 0)
    return valid, rejects


def failure_counts(tagged: DataFrame, rule_names: Sequence[str], col: str = "failed_rules") -> DataFrame:
    """One row per rule with its failure count (0 included)."""
    return tagged.agg(*[F.count_if(F.array_contains(col, n)).alias(n) for n in rule_names]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("n_failed"))
                           for n in rule_names])))


# ---------------------------------------------------------------- rule sets
def non_negative(*cols: str, required: bool = True) -> list[Rule]:
    out = []
    for c in cols:
        pred = F.col(c) >= 0
        if not required:
            pred = F.col(c).isNull() | pred
        out.append((f"{c}_non_negative", pred))
    return out


def length_between(c: str, lo: int, hi: int, required: bool = True) -> Rule:
    pred = F.length(F.col(c)).between(lo, hi)
    if not required:
        pred = F.col(c).isNull() | pred
    return (f"{c}_length", pred)


def emission_create_rules() -> list[Rule]:
    """VAL-01: six measures >= 0 (CH4/N2O may be absent: default 0),
    source_type length 2..50, device_id length 5..50."""
    rules = non_negative("co2_kg", "energy_kwh", "water_l")
    rules += [("ch4_g_non_negative", F.coalesce(F.col("ch4_g"), F.lit(0.0)) >= 0),
              ("n2o_g_non_negative", F.coalesce(F.col("n2o_g"), F.lit(0.0)) >= 0)]
    rules += [length_between("source_type", 2, 50), length_between("device_id", 5, 50),
              ("ts_present", F.col("ts").isNotNull())]
    return rules


def not_future(as_of, ts: str = "ts", tolerance: str = "5 MINUTES") -> Rule:
    """VAL-02: reject timestamps beyond ``as_of`` + tolerance."""
    a = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return ("timestamp_not_future", F.col(ts) <= a + interval(tolerance))


def emission_update_rules() -> list[Rule]:
    """VAL-03: optional measures >= 0, notes at most 500 characters."""
    return non_negative("co2_kg", "energy_kwh", "water_l", required=False) + [
        length_between("notes", 0, 500, required=False)]


# Materials accepted by the prediction input.
ALLOWED_MATERIALS = ("steel", "plastic", "aluminum", "concrete")


def prediction_input_rules() -> list[Rule]:
    """VAL-04 (material compared lower-cased)."""
    return [("energy_usage_non_negative", F.col("energy_usage") >= 0),
            ("water_usage_non_negative", F.col("water_usage") >= 0),
            ("machines_active_non_negative", F.col("machines_active") >= 0),
            ("duration_positive", F.col("duration_hours") > 0),
            ("material_length", F.length("material_type") >= 2),
            ("material_allowed", F.lower("material_type").isin(*ALLOWED_MATERIALS))]


def scenario_rules() -> list[Rule]:
    """VAL-05: both ratios within [0, 1] (on top of VAL-04)."""
    return prediction_input_rules() + [
        ("efficiency_in_unit", F.col("efficiency_gain").between(0, 1)),
        ("renewable_in_unit", F.col("renewable_ratio").between(0, 1))]


def normalise_material(df: DataFrame) -> DataFrame:
    return df.withColumn("material_type", F.lower("material_type"))


def sensor_bounds_rules(min_energy: float = 0, max_energy: float = 10000,
                        allowed_sources: Sequence[str] = ("solar", "grid"),
                        energy: str = "energy", source: str = "source") -> list[Rule]:
    """VAL-11 (VAL-12 is the lower bound alone)."""
    return [("energy_in_range", F.col(energy).between(min_energy, max_energy)),
            ("source_allowed", F.col(source).isin(*allowed_sources))]


def transfer_rules() -> list[Rule]:
    """VAL-16: 42-character hex address, amount > 0, note <= 500."""
    return [("recipient_length", F.length("recipient") == 42),
            ("recipient_format", F.col("recipient").rlike("^0x[0-9a-fA-F]{40}$")),
            ("amount_positive", F.col("amount") > 0),
            length_between("note", 0, 500, required=False)]


def parse_raw_reading(raw: DataFrame, ts_format: str = "yyyy-MM-dd'T'HH:mm:ss'Z'",
                      ts: str = "timestamp", kwh: str = "kwh") -> DataFrame:
    """VAL-13 input side: typed columns from strings, NULL when unparseable
    (the raw strings are kept so rejects can be reported)."""
    from verdigris.functions.time import try_parse_ntz
    return (raw.withColumn("ts_parsed", try_parse_ntz(ts, ts_format))
               .withColumn("kwh_parsed", F.col(kwh).try_cast("double")))


def malformed_rules() -> list[Rule]:
    """VAL-13: the record is rejected whole when any field fails to parse."""
    return [("timestamp_parses", F.col("ts_parsed").isNotNull()),
            ("kwh_numeric", F.col("kwh_parsed").isNotNull())]


def required_present(cols: Sequence[str]) -> list[Rule]:
    """VAL-14: a row lacking a required column is rejected."""
    return [(f"{c}_present", F.col(c).isNotNull()) for c in cols]


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """VAL-15: child rows whose foreign key has no parent (left anti)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(p, child[child_key] == p["_pk"], "left_anti")


def batch_cap(df: DataFrame, batch: str, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """VAL-17: batches over ``cap`` rows are rejected whole.

    Batch sizes come from a partial aggregate joined back by key, not from a
    window, so one huge batch does not land in a single task; the size table
    is broadcast when its row count is proven small (few batches would
    otherwise mean a shuffle into few tasks).  Rows without a batch id are one
    batch."""
    from verdigris.operators.joins import broadcast_if_small
    sizes, _ = broadcast_if_small(df.groupBy(F.col(batch).alias("_batch")).agg(F.count("*").alias("_batch_rows")))
    j = df.join(sizes, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    ok = j.filter(F.col("_batch_rows") <= cap).drop("_batch_rows")
    bad = j.filter(F.col("_batch_rows") > cap)
    return ok, bad


# ---------------------------------------------------------------- frame checks
def missing_share(df: DataFrame, cols: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """VAL-06 / AGG-18: share of missing values per column; fails only when
    greater than ``threshold``.  NaN counts as missing."""
    def miss(c):
        x = F.col(c)
        isnan = F.isnan(x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
        return F.avg((x.isNull() | isnan).cast("double"))
    agg = df.agg(*[miss(c).alias(c) for c in cols])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_share"),
                 (F.col(c) <= threshold).alias("passed")) for c in cols])))


def range_check(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """VAL-07: every value within [min, max]; a missing value fails."""
    agg = df.agg(*[F.bool_and(F.coalesce(F.col(c).between(lo, hi), F.lit(False))).alias(c)
                   for c, (lo, hi) in ranges.items()])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(True)).alias("passed"))
        for c in ranges])))


def dtype_check(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """VAL-08: declared vs actual type per column and the number of values of
    that type, one aggregate over the rows; a missing column has no type and
    no values, and fails."""
    known = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [c for c in expected if c in known]
    counts = df.agg(*[F.count(c).alias(c) for c in present]) if present else df.agg(F.count("*").alias("_n"))
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(t).alias("expected"), F.lit(known.get(c)).cast("string").alias("actual"),
        F.lit(known.get(c) == t).alias("passed"), (F.col(c) if c in known else F.lit(0).cast("long")).alias("n_values"))
        for c, t in expected.items()])))


def successive_steps(df: DataFrame, ts: str = "ts", keys: Sequence[str] = (),
                     bucket: str = "hour") -> DataFrame:
    """Microseconds between successive timestamps of each series.

    A window partitioned only by the series key would put a whole series (or
    with no key, the whole table) into one task.  Instead the lag runs inside
    (key, time-bucket) partitions, and the step across a bucket boundary is
    taken from a per-bucket min/max table (one row per non-empty bucket),
    which is small and is itself windowed per key.
    """
    from pyspark.sql import Window
    keys = list(keys)
    us = epoch_micros(ts)
    b = F.date_trunc(bucket, ts)
    base = df.select(*keys, us.alias("_t"), b.alias("_b")).filter(F.col("_t").isNotNull())
    w_in = Window.partitionBy(*keys, "_b").orderBy("_t")
    inner = base.select((F.col("_t") - F.lag("_t").over(w_in)).alias("_us")).filter(F.col("_us").isNotNull())
    edges = base.groupBy(*keys, "_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    w_b = Window.partitionBy(*keys).orderBy("_b")
    cross = edges.select((F.col("_lo") - F.lag("_hi").over(w_b)).alias("_us")).filter(F.col("_us").isNotNull())
    return inner.unionByName(cross)


def step_mode(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """VAL-09 / AGG-18: the most common step (seconds) between successive
    timestamps per series (event-time order); ties go to the smallest step."""
    counts = successive_steps(df, ts, keys).groupBy("_us").agg(F.count("*").alias("n"))
    return (counts.orderBy(F.desc("n"), F.asc("_us")).limit(1)
                  .select((F.col("_us") / 1_000_000).alias("step_seconds"), F.col("n").alias("step_count")))


def step_check(df: DataFrame, expected_seconds: float = 3600.0, ts: str = "ts",
               keys: Sequence[str] = ()) -> DataFrame:
    m = step_mode(df, ts, keys)
    return m.withColumn("passed", F.col("step_seconds") == F.lit(float(expected_seconds)))


def overall_verdict(missing: DataFrame, ranges: DataFrame, dtypes: DataFrame, steps: DataFrame) -> DataFrame:
    """VAL-10: AND of the four checks, one row.  Each input is already a
    tiny aggregate, so the cross join is of one-row frames."""
    parts = {"missing_ok": missing.agg(F.bool_and("passed")).scalar(),
             "ranges_ok": ranges.agg(F.bool_and("passed")).scalar(),
             "dtypes_ok": dtypes.agg(F.bool_and("passed")).scalar(),
             "steps_ok": steps.agg(F.coalesce(F.bool_and("passed"), F.lit(False))).scalar()}
    out = missing.sparkSession.range(1).select(*[v.alias(k) for k, v in parts.items()])
    return out.withColumn("valid", F.col("missing_ok") & F.col("ranges_ok")
                          & F.col("dtypes_ok") & F.col("steps_ok"))
