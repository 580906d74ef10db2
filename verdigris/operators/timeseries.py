"""Trailing windows, bucketed roll-ups, gap fill, paging and latest rows.

Every function takes explicit ``as_of`` (a literal or Column); ``None``
means ``max(ts)`` of the input.  For batch inputs that maximum is computed
first (one aggregate on the executors, one value back) and used as a
literal, so the time predicate is pushed into the parquet scan (row-group
skipping) and, on a time-chunked table, prunes whole partitions -- a scalar
subquery would do neither.  Streaming inputs keep the in-plan form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.ranking import numbered
from verdigris.functions.time import bucket_step, epoch_micros, interval, time_bucket


def _ntz_literal(v) -> Column:
    return F.lit(v.isoformat(sep=" ") if hasattr(v, "isoformat") else str(v)).cast("timestamp_ntz")


def resolve_as_of(df: DataFrame, as_of=None, ts: str = "ts", eager: bool = True) -> Column:
    if as_of is None:
        if df.isStreaming or not eager:
            return df.select(F.max(ts)).scalar()
        src = df
        if CHUNK_COL in df.columns:            # newest partition first, then max(ts) inside it
            top = df.select(F.max(CHUNK_COL)).first()[0]
            if top is not None:
                src = df.filter(F.col(CHUNK_COL) == F.lit(top))
        v = src.select(F.max(F.col(ts).cast("timestamp_ntz"))).first()[0]
        return _ntz_literal(v) if v is not None else F.lit(None).cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz")


# ------------------------------------------------------------------ filters
def trailing(df: DataFrame, days: int, as_of=None, ts: str = "ts",
             inclusive: bool = False) -> DataFrame:
    """FLT-02 (strict ``ts > as_of - N days``) / FLT-03 (inclusive BETWEEN)."""
    a = resolve_as_of(df, as_of, ts)
    start = a - interval(f"{int(days)} DAYS")
    df = prune_chunks(df, start, a if inclusive else None, ts)
    if inclusive:
        return df.filter(F.col(ts).between(start, a))
    return df.filter(F.col(ts) > start)


CHUNK_COL = "chunk"


def prune_chunks(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """On a time-chunked table (SNK-07: partition column ``chunk`` = bucket
    start date, its width kept as metadata of the time column), add the
    partition predicate implied by a time range so whole folders are skipped;
    no-op on a table without chunks or without a recorded width."""
    width = df.schema[ts].metadata.get("chunk_width") if CHUNK_COL in df.columns else None
    if width is None:
        return df
    if start is not None:
        df = df.filter(F.col(CHUNK_COL) >= F.to_date(time_bucket(width, start)))
    if end is not None:
        df = df.filter(F.col(CHUNK_COL) <= F.to_date(end))
    return df


CHART_RANGES = {"24h": 1, "7d": 7, "30d": 30}


def chart_range(df: DataFrame, preset: str, as_of=None, ts: str = "ts") -> DataFrame:
    """FLT-05: the three chart presets as trailing windows."""
    return trailing(df, CHART_RANGES[preset], as_of, ts)


def filter_emissions(df: DataFrame, start=None, end=None, source_type=None,
                     min_co2e=None, ts: str = "ts") -> DataFrame:
    """FLT-01: optional filters; both dates -> inclusive BETWEEN; ``min_co2e=0``
    counts as unset (falsy), like the reference's truthiness test."""
    out = prune_chunks(df, *(F.lit(x).cast("timestamp_ntz") if x is not None else None for x in (start, end)), ts)
    if start is not None and end is not None:
        out = out.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"),
                                           F.lit(end).cast("timestamp_ntz")))
    elif start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    elif end is not None:
        out = out.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    if source_type:
        out = out.filter(F.col("source_type") == F.lit(source_type))
    if min_co2e:
        out = out.filter(F.col("co2e_kg") >= F.lit(float(min_co2e)))
    return out


def facility_range(df: DataFrame, facility_id, start, end, ts: str = "ts") -> DataFrame:
    """FLT-04: one facility within [start, end]."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return prune_chunks(df, lo, hi, ts).filter((F.col("facility_id") == F.lit(facility_id)) & F.col(ts).between(lo, hi))


def active_rows(df: DataFrame, include_deleted: bool = True) -> DataFrame:
    """FLT-06: rows not soft-deleted (the reference's reads keep them)."""
    return df if include_deleted else df.filter(F.col("deleted_at").isNull())


# ------------------------------------------------------------------ roll-ups
def daily_emissions(metrics: DataFrame, as_of=None, days: int = 30,
                    width: str = "1 day") -> DataFrame:
    """AGG-01: per bucket and facility, total CO2 and mean anomaly score over
    the trailing window; newest bucket first."""
    recent = trailing(metrics, days, as_of)
    return (recent.groupBy(time_bucket(width, "ts").alias("bucket"), "facility_id")
                  .agg(F.sum("co2_kg").alias("total_co2"),
                       F.avg("anomaly_score").alias("avg_anomaly"))
                  .orderBy(F.desc("bucket"), "facility_id"))


def bucket_totals(df: DataFrame, value: str, width: str = "1 hour", ts: str = "ts",
                  keys: tuple[str, ...] = (), alias: str = "total") -> DataFrame:
    """AGG-03 / AGG-04: bucketed totals at a named resolution."""
    return (df.groupBy(time_bucket(width, ts).alias("bucket"), *keys)
              .agg(F.sum(value).alias(alias), F.count("*").alias("n")))


def gapfilled_daily_stats(records: DataFrame, days: int, as_of=None, ts: str = "ts",
                          width: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-02: avg co2e, sum energy, sum water per bucket over the inclusive
    trailing window; buckets without rows appear with NULLs.

    The aggregate is computed before the join.  Without ``keys`` the spine is
    one row per bucket, generated from two scalars.  With ``keys`` (e.g. per
    facility) each key present in the window gets its own spine by exploding
    the bucket sequence on its row -- output-sized, no cross join.
    """
    a = resolve_as_of(records, as_of, ts)
    start = a - interval(f"{int(days)} DAYS")
    recent = prune_chunks(records, start, a, ts).filter(F.col(ts).between(start, a))
    agg = (recent.groupBy(*keys, time_bucket(width, ts).alias("bucket"))
                 .agg(F.avg("co2e_kg").alias("avg_co2e"),
                      F.sum("energy_kwh").alias("total_energy"),
                      F.sum("water_l").alias("total_water")))
    buckets = F.explode(F.sequence(time_bucket(width, start), time_bucket(width, a),
                                   interval(bucket_step(width)))).alias("bucket")
    if keys:
        spine = recent.select(*keys).distinct().select(*keys, buckets)
    else:
        spine = records.sparkSession.range(1).select(buckets)
    return spine.join(agg, [*keys, "bucket"], "left").orderBy(*keys, "bucket")


def period_stats(records: DataFrame, ts: str = "ts") -> DataFrame:
    """AGG-11: totals, mean intensity and the time of the peak emission."""
    return records.agg(
        F.sum("co2e_kg").alias("total_co2e"),
        F.avg("carbon_intensity").alias("avg_intensity"),
        F.sum("energy_kwh").alias("total_energy"),
        F.sum("water_l").alias("total_water"),
        F.max_by(F.col(ts), F.struct("co2e_kg", ts)).alias("peak_ts"))


# ------------------------------------------------------------------ ordering
#: Rows up to the end of a page that one top-k selection may hold; deeper pages are selected in place.
SHALLOW_ROWS = 10_000


def page(df: DataFrame, page_no: int, size: int, ts: str = "ts", tiebreak: str = "record_id") -> DataFrame:
    """SRT-01: newest first, page ``page_no`` (1-based) of ``size`` (1..1000).
    A page that ends within ``SHALLOW_ROWS`` rows is a top-k selection, which
    gathers that many rows; see ``deep_page`` for others."""
    if not 1 <= size <= 1000 or page_no < 1:
        raise ValueError("page >= 1 and 1 <= size <= 1000")
    if page_no * size > SHALLOW_ROWS:
        return deep_page(df, page_no, size, ts, tiebreak)
    return df.orderBy(F.desc(ts), F.asc(tiebreak)).offset((page_no - 1) * size).limit(size)


#: Bins of a histogram of the sort key, and rows from which a band of times isn't narrowed any more.
PAGE_BINS, PAGE_BAND = 1024, 50_000


def deep_page(df: DataFrame, page_no: int, size: int, ts: str = "ts", tiebreak: str = "record_id",
              bins: int = PAGE_BINS, band_rows: int = PAGE_BAND) -> DataFrame:
    """``page`` at any depth: histograms of the time (partial aggregates of at
    most ``bins`` rows) narrow the band of times that holds the page, and only
    the band's rows are numbered, by ranges of the order, and not by one task.
    Just the page's rows leave the executors.  Rows without a time come last."""
    first, last = (page_no - 1) * size, page_no * size
    none = -(1 << 62)
    t = F.coalesce(epoch_micros(ts).cast("bigint"), F.lit(none).cast("bigint"))
    low = high = None
    before, held, last_band = 0, None, None
    while True:
        band = df if low is None else df.where(t.between(F.lit(low), F.lit(high)))
        if low is not None and low > none:  # on the column itself, for the scan's statistics
            band = band.where(F.col(ts).between(_at_micros(low), _at_micros(high)))
        edges = band.select(t.alias("_t")).where(F.col("_t") > none).agg(F.min("_t"), F.max("_t")).first() if low is None else (low, high)
        if low is not None and (held <= band_rows or (low, high) == last_band):
            break  # small enough, or many rows of few times
        last_band = low, high
        least, most = edges[0] if edges[0] is not None else none, edges[1] if edges[1] is not None else none
        width = max(1, -(-(most - least + 1) // bins))
        spread = F.when(t == none, F.lit(-1)).otherwise(F.floor((t - F.lit(least)) / F.lit(width)))
        hist = (band.groupBy(spread.alias("_bin")).agg(F.count("*").alias("c"), F.min(t).alias("lo"), F.max(t).alias("hi"))
                .orderBy(F.desc("_bin")).collect())
        low, held, new_high, seen = None, 0, None, before
        for r in hist:
            if seen + r["c"] > first and seen < last:
                new_high, before = (r["hi"], seen) if new_high is None else (new_high, before)
                low, held = r["lo"], held + r["c"]
            seen += r["c"]
        if low is None:  # beyond the last row
            return df.limit(0)
        high = new_high
    placed = numbered(band, [F.desc(ts), F.asc(tiebreak)], "_place")
    wanted = placed.where((F.col("_place") >= first - before) & (F.col("_place") < last - before))
    return wanted.orderBy("_place").drop("_place")


def _at_micros(micros: int) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(micros).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def page_summary(page_df: DataFrame) -> DataFrame:
    """AGG-12: count of the page and its CO2e total rounded to 2."""
    return page_df.agg(F.count("*").alias("count"),
                       F.round(F.coalesce(F.sum("co2e_kg"), F.lit(0.0)), 2).alias("total_co2e"))


def newest(df: DataFrame, ts: str = "ts", n: int = 1, tiebreak: Sequence[str] = ()) -> DataFrame:
    """SRT-02: the newest row(s) (top-k, not a global sort); of rows with one
    time the first by ``tiebreak``, or by all other columns."""
    rest = list(tiebreak) or [c for c in df.columns if c != ts]
    return df.orderBy(F.desc(ts), *[F.asc(c) for c in rest]).limit(n)


def latest_per_key(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """WIN-07 building block: latest row per key via ``max_by`` (one partial
    aggregate, no window sort)."""
    others = [c for c in df.columns if c != key]
    s = F.max_by(F.struct(*others), F.struct(ts, *[c for c in others if c != ts]))
    return df.groupBy(key).agg(s.alias("_r")).select(key, "_r.*")


def last_n_per_key(df: DataFrame, key: str, n: int = 30, ts: str = "ts",
                   tiebreak: str | None = None) -> DataFrame:
    """WIN-06: the last ``n`` rows per key (row_number over newest first;
    Spark plans a per-partition group limit before the shuffle)."""
    order = [F.desc(ts)] + ([F.asc(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_per_interval(df: DataFrame, key: str, unit: str = "minute", ts: str = "ts",
                       tiebreak: str | None = None) -> DataFrame:
    """AGG-20: first response per key and truncated interval; later ones are
    reused (dropped)."""
    order = [F.asc(ts)] + ([F.asc(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(key, F.date_trunc(unit, ts)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
