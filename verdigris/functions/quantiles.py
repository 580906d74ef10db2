"""Exact grouped quantiles that stay safe when one group is huge.

Spark's exact ``percentile`` keeps a value->count map per group in one task,
which breaks when one key holds a large share of the rows.  Here:

1. one ``percentile_approx`` pass (mergeable sketch, partial aggregation on
   the map side) gives, per group, a narrow value band that must contain the
   requested order statistics (the sketch's rank error is n/accuracy; the
   band is widened by a multiple of that);
2. a second pass counts rows below the band and collapses rows inside it to
   (value, multiplicity) -- again a partial aggregation, so duplicates of a
   hot value cost nothing;
3. a running sum over the small per-group band finds the exact ranks.

When a group is so large that even its band holds more than ``MAX_BAND``
distinct values (about 16 n / accuracy), the band is narrowed first: an
equi-width histogram of the band (``REFINE_BINS`` bins, counted with partial
aggregation) locates the bins holding the target ranks, and the new band
edges are the actual smallest/largest values of those bins, so membership
stays exact.  Each round shrinks a spread band about a thousandfold.

Interpolation matches ``percentile`` / ``quantile_cont``:
``p = q (n-1)``, result ``v[floor p] + (p - floor p)(v[ceil p] - v[floor p])``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
_MARGIN = 8.0
MAX_BAND = 2_000_000        # distinct values one task may rank
REFINE_BINS = 1024
SALTS = 32                  # tasks that one group's rows are dealt to


def stored(table: DataFrame, name: str) -> DataFrame:
    """A table written to a folder of this call below the shared checkpoint
    folder and read back: the passes that use it share one computation, and no
    later read of the input can meet a stale cache."""
    from verdigris.operators.tables import scratch_path
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _stored(band: DataFrame) -> DataFrame:
    return stored(band, "quantile-band")


def _refine(attach, band: DataFrame, keys: list[str], below: Column, inside: Column, max_band: int) -> DataFrame:
    """Narrow bands holding more than ``max_band`` distinct values (see the
    module doc) until all fit.  Checks run as small aggregates; groups already
    small pass through unchanged.  A round divides a band's value range by
    ``REFINE_BINS``, so doubles run out of values between its edges long before
    the loop could be called endless; a round that narrows nothing raises."""
    gk = [*keys, "_qi"]
    p = F.col("_q") * (F.col("_n") - 1)
    last = None
    while True:
        j = attach(band)
        st = j.groupBy(*gk).agg(F.count_if(below).alias("_below"),
                                F.approx_count_distinct(F.when(inside, F.col("_v"))).alias("_d"),
                                F.min(F.when(inside, F.col("_v"))).alias("_bmin"),
                                F.max(F.when(inside, F.col("_v"))).alias("_bmax"))
        big = st.filter(F.col("_d") > max_band)
        size = big.agg(F.sum("_d")).first()[0]
        if size is None:
            return band
        if size == last:
            raise RuntimeError("a quantile band does not narrow")
        last = size
        jb = j.join(big, gk).filter(inside)
        w = (F.col("_bmax") - F.col("_bmin")) / REFINE_BINS
        b = F.least(F.lit(REFINE_BINS - 1), F.floor(F.try_divide(F.col("_v") - F.col("_bmin"), w)).cast("int"))
        hist = jb.groupBy(*gk, "_n", "_q", "_below", b.alias("_bin")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
        wc = Window.partitionBy(*gk).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_end", F.col("_below") + F.sum("_c").over(wc))
        hist = hist.withColumn("_start", F.col("_end") - F.col("_c"))
        r0, r1 = F.floor(p), F.ceil(p)
        new = hist.groupBy(*gk, "_n", "_q").agg(
            F.min(F.when((F.col("_end") > r0), F.col("_mn"))).alias("_lo2"),
            F.max(F.when((F.col("_start") <= r1), F.col("_mx"))).alias("_hi2"))
        band = (band.join(new.select(*gk, "_lo2", "_hi2"), gk, "left")
                    .withColumn("_lo", F.coalesce("_lo2", "_lo")).withColumn("_hi", F.coalesce("_hi2", "_hi"))
                    .drop("_lo2", "_hi2"))
        band = _stored(band)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                    probs: Mapping[str, float], accuracy: int = DEFAULT_ACCURACY,
                    approximate: bool = False, max_band: int = MAX_BAND) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``keys``.

    Returns one row per group with a column per entry of ``probs`` plus
    ``_n`` (non-null count).  NULL values are ignored.  ``approximate=True``
    stops after the sketch pass (``percentile_approx``, rank error
    n / accuracy, no interpolation) -- one partial aggregate, for callers
    that accept that error.
    """
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if approximate:
        names = list(probs)
        agg = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(
            "_v", [float(probs[n]) for n in names], accuracy).alias("_a"))
        return agg.select(*keys, "_n", *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])
    names = list(probs)
    margin = _MARGIN / accuracy
    fracs: list[float] = []
    for name in names:
        q = float(probs[name])
        fracs += [max(0.0, q - margin), min(1.0, q + margin)]
    stats = base.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", fracs, accuracy).alias("_a"))
    band_items = []
    for i, name in enumerate(names):
        q = float(probs[name])
        lo_f, hi_f = fracs[2 * i], fracs[2 * i + 1]
        # Groups no larger than ``accuracy`` use the whole group as the band
        # (bounded, exact); larger groups use the sketch band, whose margin
        # of 8 n / accuracy ranks covers the sketch error and both
        # interpolation neighbours.
        small = F.col("_n") <= F.lit(accuracy)
        none = F.lit(None).cast("double")
        lo = none if lo_f <= 0 else F.when(small, none).otherwise(F.col("_a")[2 * i])
        hi = none if hi_f >= 1 else F.when(small, none).otherwise(F.col("_a")[2 * i + 1])
        band_items.append(F.struct(F.lit(i).alias("_qi"), F.lit(q).alias("_q"),
                                   lo.alias("_lo"), hi.alias("_hi")))
    below = F.col("_lo").isNotNull() & (F.col("_v") < F.col("_lo"))
    inside = ~below & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    if keys:
        band = stats.select(*keys, "_n", F.inline(F.array(*band_items)))
        salted = base.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))

        def attach(b):
            # The value's hash takes part in the join, so a key that holds a
            # third of the rows is dealt to SALTS tasks instead of one.
            parts = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            return salted.join(parts, [*keys, "_salt"])
    else:
        band = stats.select("_n", F.inline(F.array(*band_items)))

        def attach(b):
            # One group: the band is a scalar (a few rows packed in one);
            # each value is paired with the requested quantiles by an explode.
            s = b.select(F.struct(F.first("_n").alias("_n"), F.collect_list(
                F.struct("_qi", "_q", "_lo", "_hi")).alias("_items")).alias("_s")).scalar()
            return base.select("_v", F.lit(0).alias("_salt"), s["_n"].alias("_n"), F.inline(s["_items"]))
    band = _stored(band)
    largest = band.agg(F.max("_n")).first()[0] or 0
    if largest * (2 * _MARGIN + 2) / accuracy > max_band:     # a band could exceed the bound
        band = _refine(attach, band, keys, below, inside, max_band)
    cand = attach(band)
    cand = (cand.filter(below | inside)
                .groupBy(*keys, "_salt", "_qi", "_q", "_n", F.when(inside, F.col("_v")).alias("_vv"))
                .agg(F.count("*").alias("_c")).drop("_salt"))
    w = (Window.partitionBy(*keys, "_qi").orderBy(F.col("_vv").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cand = cand.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    p = F.col("_q") * (F.col("_n") - 1)
    r0, r1 = F.floor(p), F.ceil(p)
    hit0 = F.col("_vv").isNotNull() & (F.col("_start") <= r0) & (r0 < F.col("_end"))
    hit1 = F.col("_vv").isNotNull() & (F.col("_start") <= r1) & (r1 < F.col("_end"))
    per_q = cand.groupBy(*keys, "_qi", "_q", "_n").agg(
        F.max(F.when(hit0, F.col("_vv"))).alias("_v0"),
        F.max(F.when(hit1, F.col("_vv"))).alias("_v1"))
    frac = F.col("_q") * (F.col("_n") - 1) - F.floor(F.col("_q") * (F.col("_n") - 1))
    val = F.col("_v0") + frac * (F.col("_v1") - F.col("_v0"))
    # The sketch guarantees coverage; fail loudly rather than return a wrong value.
    val = F.when(F.col("_v0").isNull() | F.col("_v1").isNull(),
                 F.raise_error(F.lit("quantile band missed the target rank")).cast("double")
                 ).otherwise(val)
    per_q = per_q.select(*keys, "_qi", "_n", val.alias("_val"))
    out = per_q.groupBy(*keys, "_n").agg(
        *[F.max(F.when(F.col("_qi") == i, F.col("_val"))).alias(name) for i, name in enumerate(names)])
    return out


def exact_median(df: DataFrame, keys: Sequence[str], value: str | Column,
                 alias: str = "median", accuracy: int = DEFAULT_ACCURACY, approximate: bool = False) -> DataFrame:
    return exact_quantiles(df, keys, value, {alias: 0.5}, accuracy, approximate).drop("_n")


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str,
                   median_alias: str = "median", mad_alias: str = "mad",
                   accuracy: int = DEFAULT_ACCURACY, approximate: bool = False) -> DataFrame:
    """Per-group median and unscaled MAD = median(|x - median|).

    The median is computed once and carried as an extra grouping column of
    the deviation pass (it is constant per group), so no join back is
    needed."""
    keys = list(keys)
    med = exact_median(df, keys, value, median_alias, accuracy, approximate)
    dev_src = df.select(*keys, F.col(value).alias("_x")).filter(F.col("_x").isNotNull())
    if keys:
        dev_src = dev_src.join(med, keys)
    else:
        dev_src = dev_src.withColumn(median_alias, med.select(median_alias).scalar())
    dev = dev_src.select(*keys, median_alias, F.abs(F.col("_x") - F.col(median_alias)).alias("_d"))
    return exact_median(dev, keys + [median_alias], "_d", mad_alias, accuracy, approximate)
