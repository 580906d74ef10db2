"""Feature construction: calendar features, lags, rolling statistics,
interpolation, training windows and fitted scalers.

Series features are ordered by event time (plus a tie-breaker) within the
series key.  They run through ``operators.series``: each series is cut into
time buckets (``bucket``, default one day) and every bucket gets the few
neighbouring rows its frames need, so a very long or very hot series is
spread over many tasks and the result is still exactly that of the unsplit
window.  ``bucket=None`` gives the plain per-series window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.quantiles import DEFAULT_ACCURACY, exact_quantiles
from verdigris.functions.ranking import numbered
from verdigris.functions.time import epoch_hours, epoch_micros
from verdigris.operators import series as S
from verdigris.operators.series import DEFAULT_BUCKET


def _order(ts: str, tiebreak: str | None) -> list[Column]:
    return [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])


def series_window(key, ts: str = "ts", tiebreak: str | None = None):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*_order(ts, tiebreak))


# ---------------------------------------------------------------- PRJ-08..12
def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """PRJ-08: hour, weekday (Monday = 0), day of month, month, weekend flag."""
    return (df.withColumn("hour", F.hour(ts)).withColumn("day_of_week", F.weekday(ts))
              .withColumn("day", F.dayofmonth(ts)).withColumn("month", F.month(ts))
              .withColumn("is_weekend", F.weekday(ts) >= 5))


def holiday_flag(df: DataFrame, holidays: DataFrame, country: str, ts: str = "ts") -> DataFrame:
    """PRJ-09: left join to a (country, date) holiday table.  The table is a
    calendar (a few rows per country-year), so its broadcast is bounded."""
    from verdigris.operators.joins import broadcast_if_small
    h = (holidays.filter(F.col("country") == country)
                 .select(F.col("date").alias("_hd")).distinct().withColumn("is_holiday", F.lit(True)))
    h, _ = broadcast_if_small(h)           # a calendar: broadcast once its size is proven
    return (df.join(h, F.to_date(F.col(ts)) == F.col("_hd"), "left")
              .withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False))).drop("_hd"))


def cyclical_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """PRJ-10: sin/cos of 2 pi hour / 24."""
    h = F.hour(ts).cast("double")
    return (df.withColumn("hour_sin", F.sin(2 * math.pi * h / 24))
              .withColumn("hour_cos", F.cos(2 * math.pi * h / 24)))


def log1p_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-11."""
    for c in cols:
        df = df.withColumn(c, F.log1p(c))
    return df


def fourier_features(df: DataFrame, ts: str = "ts", periods: Sequence[float] = (24, 168),
                     order: int = 3) -> DataFrame:
    """PRJ-12: sin/cos(2 pi k t / P), t = hours since epoch."""
    t = epoch_hours(ts)
    for p in periods:
        for k in range(1, order + 1):
            arg = 2 * math.pi * k * t / p
            df = (df.withColumn(f"fourier_sin_{int(p)}_{k}", F.sin(arg))
                    .withColumn(f"fourier_cos_{int(p)}_{k}", F.cos(arg)))
    return df


# ---------------------------------------------------------------- WIN-02/03
def lag_features(df: DataFrame, lags: Mapping[str, Sequence[int]], key: str = "facility_id",
                 ts: str = "ts", tiebreak: str | None = None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-02: ``{col}_lag_{k}`` per series."""
    back = max(k for ks in lags.values() for k in ks)
    return S.apply_framed(
        df, key, _order(ts, tiebreak),
        lambda w: [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c, ks in lags.items() for k in ks],
        back=back, bucket=bucket, ts=ts)


def rolling_features(df: DataFrame, value: str, means: Sequence[int] = (6, 24, 168),
                     stds: Sequence[int] = (24, 168), key: str = "facility_id", ts: str = "ts",
                     tiebreak: str | None = None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-03: rolling mean / sample std over the last n rows, NULL until the
    window holds n values."""
    def build(base):
        cols = []
        for n in means:
            w = base.rowsBetween(-(n - 1), 0)
            cols.append(F.when(F.count(value).over(w) == n, F.avg(value).over(w)).alias(f"{value}_roll_mean_{n}"))
        for n in stds:
            w = base.rowsBetween(-(n - 1), 0)
            cols.append(F.when(F.count(value).over(w) == n, F.stddev_samp(value).over(w))
                        .alias(f"{value}_roll_std_{n}"))
        return cols
    back = max(list(means) + list(stds)) - 1
    return S.apply_framed(df, key, _order(ts, tiebreak), build, back=back, bucket=bucket, ts=ts)


def meter_deltas(df: DataFrame, value: str, key: str = "sensor_id", ts: str = "ts",
                 tiebreak: str | None = None, out: str = "delta", bucket=DEFAULT_BUCKET) -> DataFrame:
    """Difference to the previous reading of the same series."""
    return S.apply_framed(df, key, _order(ts, tiebreak),
                          lambda w: [(F.col(value) - F.lag(value).over(w)).alias(out)],
                          back=1, bucket=bucket, ts=ts)


# ---------------------------------------------------------------- WIN-04/05
PULSE_LITRES = 0.00225  # fixed value: litres per flow-meter pulse


def pulse_flow(pulses: DataFrame, key: str = "sensor_id", ts: str = "ts", tiebreak: str | None = None,
               litres_per_pulse: float = PULSE_LITRES, bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-04 flow rate (L/min) from the gap to the previous pulse (NULL for
    the first pulse or a zero gap) and WIN-05 running volume (the pulse's
    position in the series times the litres per pulse)."""
    def build(w):
        dt = (epoch_micros(ts)
              - epoch_micros(F.lag(ts).over(w))) / 1_000_000
        return [(F.try_divide(F.lit(litres_per_pulse), dt) * 60).alias("flow_lpm")]
    if bucket is None:
        w = series_window(key, ts, tiebreak)
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return pulses.select("*", *build(w), (F.count(F.lit(1)).over(running) * litres_per_pulse)
                             .alias("total_litres"))
    out = S.apply_framed(pulses, key, _order(ts, tiebreak), build, back=1, bucket=bucket, ts=ts,
                         keep_positions=True)
    return out.withColumn("total_litres", (F.col("_i") + 1) * litres_per_pulse).drop("_i", "_n")


# ---------------------------------------------------------------- WIN-08
def interpolate_linear(df: DataFrame, value: str, key=None, ts: str = "ts", tiebreak: str | None = None,
                       out: str | None = None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-08: time-linear interpolation between the previous and next known
    values; leading/trailing gaps stay NULL.  The nearest known values are
    found across buckets through a per-bucket summary, so a long gap costs
    nothing extra."""
    out = out or value
    if key is None:
        df = df.withColumn("_series", F.lit(0))
        key = "_series"
    t = epoch_micros(ts).cast("double")
    payload = F.struct(t.alias("t"), F.col(value).alias("v"))
    x = S.carry_known(df, key, _order(ts, tiebreak), value, payload, bucket=bucket, ts=ts)
    pv, pt, nv, nt = F.col("_prev.v"), F.col("_prev.t"), F.col("_next.v"), F.col("_next.t")
    frac = F.try_divide(t - pt, nt - pt)
    interp = F.when(F.col(value).isNotNull(), F.col(value)).when(
        F.col("_prev").isNotNull() & F.col("_next").isNotNull(),
        F.when(nt == pt, pv).otherwise(pv + (nv - pv) * frac))
    res = x.withColumn(out, interp).drop("_prev", "_next")
    return res.drop("_series") if key == "_series" else res


# ---------------------------------------------------------------- WIN-09..12
#: Rows of a block of ``dense_series``.
DENSE_ROWS = 128


def dense_series(df: DataFrame, features: Sequence[str], target: str, ahead: int, key: str = "facility_id", ts: str = "ts",
                 tiebreak: str | None = None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """One row per series and block of consecutive rows with the block's rows,
    and the ``ahead`` rows after it, as arrays in series order: ``t`` times,
    ``x`` features, ``y`` targets; ``own`` of them are the block's, ``i`` is the
    series position of the first and ``n`` the series length.  A block has
    ``DENSE_ROWS`` rows (four times ``ahead`` if that is more), so that a row of
    arrays is as small in a crowded hour as elsewhere; ``bucket`` says how the
    positions are found.  Rows are shuffled once with their neighbours' few,
    whatever the length of the windows that are cut from them."""
    src = df.select(key, ts, *([tiebreak] if tiebreak else []), *sorted({*features, target} - {key, ts, tiebreak}))
    framed = S.in_blocks(src, key, _order(ts, tiebreak), bucket, max(DENSE_ROWS, 4 * ahead), ahead, ts)
    row = F.struct("_i", F.col(ts).alias("t"), F.struct(*features).alias("x"), F.col(target).alias("y"))
    return (framed.groupBy(key, "_home").agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.count_if(~F.col("_halo")).alias("own"),
                                             F.max("_n").alias("n"))
            .select(key, F.col("_rows.t").alias("t"), F.col("_rows.x").alias("x"), F.col("_rows.y").alias("y"),
                    F.col("own").cast("int").alias("own"), F.col("_rows")[0]["_i"].alias("i"), "n"))


def training_windows(df: DataFrame, features: Sequence[str], target: str, window: int, horizon: int,
                     key: str = "facility_id", ts: str = "ts", tiebreak: str | None = None,
                     drop_last: bool = False, bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-09 / WIN-10: for each start row, ``window`` rows of features and the
    next ``horizon`` targets; only complete windows are kept (``window``
    feature rows and ``horizon`` known targets), giving n - window - horizon + 1
    samples per series (one fewer with ``drop_last``).

    Windows are slices of ``dense_series``: rows aren't copied before a window
    is used.  ``bucket=None`` finds positions by one sort of each series."""
    d = dense_series(df, features, target, window + horizon - 1, key, ts, tiebreak, bucket)
    complete = F.least("own", F.size("x") - (window + horizon - 1))
    starts = F.when(complete > 0, F.sequence(F.lit(0), complete - 1)).otherwise(F.array().cast("array<int>"))

    def wanted(j):
        known = F.forall(F.slice("y", j + 1 + window, horizon), lambda v: v.isNotNull())
        return known & (F.col("i") + j + 1 < F.col("n") - window - horizon + 1) if drop_last else known
    d = d.withColumn("_starts", F.filter(starts, wanted))  # before the rows are made, which then are plain slices
    return (d.select(key, "t", "x", "y", F.explode("_starts").alias("_j"))
            .select(key, F.get("t", "_j").alias("window_start"), F.slice("x", F.col("_j") + 1, F.lit(window)).alias("x"),
                    F.slice("y", F.col("_j") + 1 + window, F.lit(horizon)).alias("y")))


def multi_horizon_targets(df: DataFrame, target: str, window: int, horizons: Sequence[int] = (1, 6, 24),
                          key: str = "facility_id", ts: str = "ts", tiebreak: str | None = None,
                          bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-11: target h steps after the window's last row, for each h."""
    src = df.select(key, ts, *([tiebreak] if tiebreak else []), target)
    out = S.apply_framed(
        src, key, _order(ts, tiebreak),
        lambda w: [F.lead(target, window - 1 + h).over(w).alias(f"y_h{h}") for h in horizons],
        ahead=window - 1 + max(horizons), bucket=bucket, ts=ts)
    out = out.select(key, F.col(ts).alias("window_start"), *[f"y_h{h}" for h in horizons])
    return out.filter(F.col(f"y_h{max(horizons)}").isNotNull())


def chronological_split(df: DataFrame, window: int, test_size: float = 0.2, key: str = "facility_id",
                        ts: str = "ts", tiebreak: str | None = None, horizon: int = 1,
                        bucket=DEFAULT_BUCKET) -> DataFrame:
    """WIN-12: per series, samples = n - window - horizon + 1,
    s = int(samples (1 - test_size)); train rows [0, s + window), test rows
    [s, n).  Rows in the overlap carry both flags.  Positions come from
    bucket-local row numbers plus prefix counts, not a series-wide sort."""
    x = S.positions(df, key, _order(ts, tiebreak), bucket, ts)
    s = F.floor((F.col("_n") - window - horizon + 1) * (1 - test_size))
    return (x.withColumn("_s", s)
             .withColumn("in_train", F.col("_i") < F.col("_s") + window)
             .withColumn("in_test", F.col("_i") >= F.col("_s"))
             .drop("_i", "_n", "_s"))


# ---------------------------------------------------------------- ML-01..04
def fit_iqr_caps(df: DataFrame, cols: Sequence[str], k: float = 1.5,
                 accuracy: int = DEFAULT_ACCURACY, approximate: bool = False) -> DataFrame:
    """ML-01 fit: one row per column with lower/upper caps (exact quantiles;
    ``approximate=True`` for the sketch alone)."""
    q = exact_quantiles(_stacked(df, cols), ["column"], "_x", {"q1": 0.25, "q3": 0.75}, accuracy, approximate)
    return q.select("column", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                    (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))


def _stacked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) rows for all ``cols``: one grouped pass fits every
    column instead of one pass per column."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x"))
                                        for c in cols])))


def _wide(stats: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn per-column stat rows into one row with ``{col}__{field}``."""
    return stats.agg(*[F.max(F.when(F.col("column") == c, F.col(f))).alias(f"{c}__{f}")
                       for c in cols for f in fields])


def apply_iqr_caps(df: DataFrame, caps: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-01 transform: clip to the fitted caps (a one-row scalar, no join);
    missing values stay missing."""
    from verdigris.operators.joins import one_row
    s = one_row(_wide(caps, cols, ["lower", "upper"]))
    for c in cols:
        df = df.withColumn(c, clipped(F.col(c), s[f"{c}__lower"], s[f"{c}__upper"]))
    return df


def clipped(value: Column, low: Column, high: Column) -> Column:
    """The value within bounds; NULL for NULL, which least and greatest skip."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def fit_robust(df: DataFrame, cols: Sequence[str], accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """ML-02 fit: median for imputation, then median and IQR of the
    imputed column (imputation fills the median, so the median is the same
    and the IQR is recomputed on the imputed values)."""
    stacked = _stacked(df, cols)
    med = exact_quantiles(stacked, ["column"], "_x", {"fill": 0.5}, accuracy).select("column", "fill")
    med = F.broadcast(med)                               # one row per fitted column
    imputed = stacked.join(med, "column").select("column", F.coalesce("_x", "fill").alias("_x"))
    q = exact_quantiles(imputed, ["column"], "_x", {"q1": 0.25, "m2": 0.5, "q3": 0.75}, accuracy)
    iqr = F.col("q3") - F.col("q1")
    return q.join(med, "column").select(
        "column", "fill", F.col("m2").alias("center"), F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def apply_robust(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    from verdigris.operators.joins import one_row
    s = one_row(_wide(stats, cols, ["fill", "center", "scale"]))
    for c in cols:
        df = df.withColumn(c, (F.coalesce(F.col(c), s[f"{c}__fill"]) - s[f"{c}__center"]) / s[f"{c}__scale"])
    return df


def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("missing"))


def category_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-03 fit: the vocabulary as a table (column, category, index), the
    index in the categories' order ('missing' for NULL).  It stays on the
    executors, whatever its size: distinct categories are range-partitioned
    and numbered from the sizes of the partitions, so no task ranks a column."""
    found = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _category(c).alias("category")) for c in cols]))).distinct()
    placed = numbered(found, [F.col("column"), F.col("category")])
    first = placed.groupBy("column").agg(F.min("_pos").alias("_first"))
    return placed.join(F.broadcast(first), "column").select("column", "category", (F.col("_pos") - F.col("_first")).alias("index"))


def category_index(df: DataFrame, table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-03 transform, sparse: ``{col}_index``, the place of the 1 in the
    one-hot row; NULL (all zeros) for an unseen category."""
    for c in cols:
        part = table.filter(F.col("column") == c).select(F.col("category").alias("_c"), F.col("index").alias(f"{c}_index"))
        df = df.withColumn("_c", _category(c)).join(part, "_c", "left").drop("_c")
    return df


#: Columns that the wide one-hot form may have.
MAX_WIDE = 10_000


def fit_categories(df: DataFrame, cols: Sequence[str], max_wide: int = MAX_WIDE) -> dict[str, list[str]]:
    """ML-03 fit for the wide form: the sorted categories of each column.  They
    name the columns of the result, so the driver needs them, and more than
    ``max_wide`` raise; ``category_table`` takes any number."""
    rows = category_table(df, cols).orderBy("column", "index").limit(max_wide + 1).collect()
    if len(rows) > max_wide:
        raise ValueError(f"more than {max_wide} categories for the wide form; use category_table and category_index")
    return {c: [r["category"] for r in rows if r["column"] == c] for c in cols}


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str]], drop: bool = True) -> DataFrame:
    """ML-03 transform: one 0/1 column per fitted category (``col_value``);
    unseen categories give all zeros."""
    out = df
    for c, cats in vocab.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        out = out.select("*", *[(v == F.lit(k)).cast("double").alias(f"{c}_{k}") for k in cats])
        if drop:
            out = out.drop(c)
    return out


def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-04 fit: mean and population std per column, one row."""
    return df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                  *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])


def apply_standard(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    from verdigris.operators.joins import one_row
    s = one_row(stats)
    for c in cols:
        sd = s[f"{c}__std"]
        df = df.withColumn(c, (F.col(c) - s[f"{c}__mean"]) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    return df


# ---------------------------------------------------------------- ML-06
def augment_windows(windows: DataFrame, seed: int = 42, p_noise: float = 0.3, sigma: float = 0.01,
                    p_scale: float = 0.3, scale_lo: float = 0.9, scale_hi: float = 1.1,
                    shift: float = 0.0, x: str = "x_values") -> DataFrame:
    """ML-06: per window row, with probability p add N(0, sigma) noise to every
    element; with probability p scale the window by U(lo, hi); optional
    constant shift.  Seeded, so a retried task reproduces its output."""
    coin_noise = F.rand(seed) < p_noise
    coin_scale = F.rand(seed + 1) < p_scale
    factor = F.lit(scale_lo) + F.rand(seed + 2) * (scale_hi - scale_lo)
    noisy = F.transform(x, lambda e, i: e + F.when(coin_noise, F.lit(sigma) * F.randn(seed + 3)).otherwise(0.0))
    scaled = F.transform(noisy, lambda e: F.when(coin_scale, e * factor).otherwise(e) + F.lit(shift))
    return windows.withColumn(x, scaled)
