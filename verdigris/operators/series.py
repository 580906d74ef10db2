"""Series windows that stay parallel when one series is huge.

A window partitioned only by the series key sorts each whole series in one
task.  Here each series is cut into ordered buckets (by default one per
day) and window functions run per (series, bucket):

* ``positions``     -- the exact 0-based position ``_i`` of every row in
  its series and the series length ``_n``, from bucket-local row numbers
  plus prefix counts of a small per-bucket table;
* ``with_halo``     -- adds to each bucket copies of the ``back`` rows
  before it and the ``ahead`` rows after it (taken from however many
  neighbouring buckets that needs), so any row-based frame within
  [-back, +ahead] gives exactly the result of the unsplit window;
* ``in_blocks``     -- cuts each series at its positions into blocks of a
  fixed number of rows, with copies of the rows after each;
* ``running_sum``   -- an exact cumulative sum: bucket-local running sum
  plus the total of all earlier buckets;
* ``carry_known``   -- the previous / next non-null value of a column,
  looking across any number of buckets.

The per-bucket table has one row per (series, bucket), so it is windowed per
series cheaply however long the series is.  Bucket expressions must be
non-decreasing in the series order.

Fixed units of time make large buckets where readings are dense.  As a bucket,
``EqualDepth(rows)`` cuts each series at quantiles of its own times instead, so
that buckets have about equally many rows wherever these lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.time import epoch_micros

DEFAULT_BUCKET = "day"
_HELPERS = ("_b", "_li", "_o", "_c", "_cb", "_end", "_n", "_i", "_reachB", "_reachA", "_home", "_halo")


def bucket_expr(bucket, ts: str) -> Column:
    """A bucket column: a ``date_trunc`` unit name, a Column, or None (one
    bucket per series, i.e. a plain window); see also ``EqualDepth``."""
    if bucket is None:
        return F.lit(0)
    if isinstance(bucket, Column):
        return bucket
    return F.date_trunc(bucket, F.col(ts))


@dataclass(frozen=True)
class EqualDepth:
    """Buckets of about ``rows`` rows: the edges are quantiles of the times of
    each series and ``within`` (a longer unit of time, None for the series as
    a whole), from one mergeable sketch (``percentile_approx``, partial
    aggregation).  A unit is cut into up to 256 buckets; rows of one time stay
    together."""

    rows: int = 100_000
    within: str | None = "month"


#: Quantiles that cut a unit of an EqualDepth bucket, in blocks of which one is searched; the sketch's accuracy; tasks
#: that one unit's rows are dealt to when the edges are attached.
_CUTS, _BLOCK, _ACCURACY, _SALTS = 255, 16, 10_000, 32


def _equal_depth(df: DataFrame, keys: list[str], bucket: EqualDepth, ts: str) -> DataFrame:
    from verdigris.functions.quantiles import stored
    x = df.withColumn("_u", bucket_expr(bucket.within, ts)).withColumn("_t", epoch_micros(ts))
    sketch = x.groupBy(*keys, "_u").agg(F.count("_t").alias("_c"), F.percentile_approx(
        "_t", [(i + 1) / (_CUTS + 1) for i in range(_CUTS)], _ACCURACY).alias("_q"))
    # every m-th quantile, so that a bucket gets about `rows` rows
    m = F.greatest(F.lit(1), F.ceil(F.lit(bucket.rows * (_CUTS + 1.0)) / F.greatest(F.col("_c"), F.lit(1)))).cast("bigint")
    edges = F.array_distinct(F.filter("_q", lambda e, i: (i + 1) % F.col("_m") == 0))
    # stored: all passes over the rows must cut them at the same edges
    table = stored(sketch.withColumn("_m", m).select(*keys, "_u", F.coalesce(edges, F.array().cast("array<bigint>")).alias("_e")),
                   "series-edges")
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    x = x.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_t"), F.lit(_SALTS)).cast("int"), F.lit(0)))
    x = _join_back(x, table, [*keys, "_u", "_salt"])
    # edges at or before the row's time: whole blocks by their last edge, then within one block
    blocks = F.size(F.filter(F.transform(F.sequence(F.lit(_BLOCK), F.lit(_CUTS + 1), F.lit(_BLOCK)), lambda i: F.get("_e", i - 1)),
                             lambda e: e <= F.col("_t")))
    x = x.withColumn("_k", blocks * _BLOCK)
    rest = F.size(F.filter(F.slice("_e", F.col("_k") + 1, F.lit(_BLOCK)), lambda e: e <= F.col("_t")))
    place = F.coalesce(F.when(F.col("_t").isNotNull(), F.col("_k") + rest), F.lit(0))
    return x.withColumn("_b", F.struct(F.col("_u").alias("u"), place.alias("k"))).drop("_u", "_t", "_salt", "_e", "_k")


def _bucketed(df: DataFrame, keys: list[str], bucket, ts: str) -> DataFrame:
    """``df`` with its bucket in ``_b``."""
    if isinstance(bucket, EqualDepth):
        return _equal_depth(df, keys, bucket, ts)
    return df.withColumn("_b", bucket_expr(bucket, ts))


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _join_back(x: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """Equi-join in which NULL keys and NULL buckets (rows without a time) meet
    each other, as they do in a window's partitions."""
    a, b = x.alias("_x"), table.alias("_y")
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"_x.`{n}`").eqNullSafe(F.col(f"_y.`{n}`"))
    return a.join(b, on).select("_x.*", *[F.col(f"_y.`{c}`") for c in table.columns if c not in names])


def _bucket_table(x: DataFrame, keys: list[str], back: int, ahead: int) -> DataFrame:
    counts = x.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    counts = (counts.withColumn("_o", F.row_number().over(wb))
                    .withColumn("_end", F.sum("_c").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
                    .withColumn("_cb", F.col("_end") - F.col("_c"))
                    .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))))
    if back:
        # buckets starting within `back` rows of this bucket's start
        wr = Window.partitionBy(*keys).orderBy("_cb").rangeBetween(0, back - 1)
        counts = counts.withColumn("_cntB", F.count(F.lit(1)).over(wr))
        counts = counts.withColumn("_reachB", F.lead("_cntB", 1, 0).over(wb)).drop("_cntB")
    if ahead:
        # buckets ending within `ahead` rows before this bucket's end
        wr = Window.partitionBy(*keys).orderBy("_end").rangeBetween(-(ahead - 1), 0)
        counts = counts.withColumn("_cntA", F.count(F.lit(1)).over(wr))
        counts = counts.withColumn("_reachA", F.lag("_cntA", 1, 0).over(wb)).drop("_cntA")
    return counts


def _positioned(df: DataFrame, keys: list[str], order: Sequence[Column], bucket,
                back: int, ahead: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    x = _bucketed(df, keys, bucket, ts)
    x = x.withColumn("_li", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    counts = _bucket_table(x.select(*keys, "_b"), keys, back, ahead)
    x = _join_back(x, counts, keys + ["_b"]).withColumn("_i", F.col("_cb") + F.col("_li"))
    return x, counts


def positions(df: DataFrame, key, order: Sequence[Column], bucket=DEFAULT_BUCKET, ts: str = "ts") -> DataFrame:
    """``df`` plus ``_i`` (0-based position in the series) and ``_n``
    (series length), without a series-wide window."""
    x, _ = _positioned(df, _keys(key), order, bucket, 0, 0, ts)
    return x.drop("_b", "_li", "_o", "_c", "_cb", "_end")


def in_blocks(df: DataFrame, key, order: Sequence[Column], bucket, rows: int, ahead: int = 0, ts: str = "ts") -> DataFrame:
    """Rows of ``df`` with their positions, dealt to blocks ``_home`` of
    ``rows`` consecutive positions of a series, plus copies (``_halo`` true) of
    the ``ahead`` rows after each block.  Unlike buckets, blocks never hold more
    rows than that, however many rows share a time."""
    x = positions(df, key, order, bucket, ts)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("_i") - ahead) / rows))
    x = x.withColumn("_home", F.explode(F.sequence(first, F.floor(F.col("_i") / rows))))
    return x.withColumn("_halo", F.col("_i") >= (F.col("_home") + 1) * rows)


def with_halo(df: DataFrame, key, order: Sequence[Column], bucket, back: int = 0,
              ahead: int = 0, ts: str = "ts") -> DataFrame:
    """Rows of ``df`` tagged with their home bucket ordinal ``_home`` plus
    halo copies (``_halo`` true) of neighbouring rows that frames of up to
    ``back`` preceding / ``ahead`` following rows need."""
    keys = _keys(key)
    x, counts = _positioned(df, keys, order, bucket, back, ahead, ts)
    tgt = counts.select(*keys, F.col("_o").alias("_t"), F.col("_cb").alias("_tcb"), F.col("_end").alias("_tend"))
    parts = [x.withColumn("_home", F.col("_o")).withColumn("_halo", F.lit(False))]
    if back:
        cand = x.filter((F.col("_li") >= F.col("_c") - back) & (F.col("_reachB") > 0))
        cand = cand.withColumn("_t", F.explode(F.sequence(F.col("_o") + 1, F.col("_o") + F.col("_reachB"))))
        h = _join_back(cand, tgt, keys + ["_t"]).filter(F.col("_tcb") <= F.col("_i") + back)
        parts.append(h.withColumn("_home", F.col("_t")).withColumn("_halo", F.lit(True))
                      .drop("_t", "_tcb", "_tend"))
    if ahead:
        cand = x.filter((F.col("_li") < ahead) & (F.col("_reachA") > 0))
        cand = cand.withColumn("_t", F.explode(F.sequence(F.col("_o") - F.col("_reachA"), F.col("_o") - 1)))
        h = _join_back(cand, tgt, keys + ["_t"]).filter(F.col("_tend") + ahead - 1 >= F.col("_i"))
        parts.append(h.withColumn("_home", F.col("_t")).withColumn("_halo", F.lit(True))
                      .drop("_t", "_tcb", "_tend"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_framed(df: DataFrame, key, order: Sequence[Column], build: Callable[[Window], list[Column]],
                 back: int = 0, ahead: int = 0, bucket=DEFAULT_BUCKET, ts: str = "ts",
                 keep_positions: bool = False) -> DataFrame:
    """Evaluate the window columns from ``build(window)`` (frames within
    [-back, +ahead] rows) exactly, one (series, bucket) at a time."""
    keys = _keys(key)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *build(w))
    framed = with_halo(df, keys, order, bucket, back, ahead, ts)
    w = Window.partitionBy(*keys, "_home").orderBy(*order)
    extra = ["_i", "_n"] if keep_positions else []
    out = framed.select(*df.columns, *extra, "_halo", *build(w))
    return out.filter(~F.col("_halo")).drop("_halo")


def running_sum(df: DataFrame, key, order: Sequence[Column], value: Column | str, out: str,
                bucket=DEFAULT_BUCKET, ts: str = "ts") -> DataFrame:
    """Exact cumulative sum in series order: bucket-local running sum plus
    the totals of all earlier buckets of the series."""
    keys = _keys(key)
    v = F.col(value) if isinstance(value, str) else value
    x = _bucketed(df, keys, bucket, ts).withColumn("_v", v)
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_local", F.sum("_v").over(local))
    tot = x.groupBy(*keys, "_b").agg(F.sum("_v").alias("_bt"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_before", F.sum("_bt").over(wb)).drop("_bt")
    x = _join_back(x, tot, keys + ["_b"])
    zero = F.lit(0).cast(x.schema["_local"].dataType)
    return x.withColumn(out, F.coalesce(F.col("_before"), zero) + F.col("_local")).drop(
        "_b", "_v", "_local", "_before")


def carry_known(df: DataFrame, key, order: Sequence[Column], value: str, payload: Column,
                bucket=DEFAULT_BUCKET, ts: str = "ts") -> DataFrame:
    """Add ``_prev`` / ``_next``: ``payload`` (a struct) of the nearest row at
    or before / at or after each row where ``value`` is not NULL, searching
    across buckets through a per-bucket summary."""
    keys = _keys(key)
    x = _bucketed(df, keys, bucket, ts)
    known = F.when(F.col(value).isNotNull(), payload)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    x = (x.withColumn("_pl", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_nl", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    order_struct = F.struct(*order)
    summ = x.groupBy(*keys, "_b").agg(
        F.max_by(known, F.when(F.col(value).isNotNull(), order_struct)).alias("_bl"),
        F.min_by(known, F.when(F.col(value).isNotNull(), order_struct)).alias("_bf"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    summ = (summ.withColumn("_cp", F.last("_bl", True).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
                .withColumn("_cn", F.first("_bf", True).over(wb.rowsBetween(1, Window.unboundedFollowing)))
                .select(*keys, "_b", "_cp", "_cn"))
    x = _join_back(x, summ, keys + ["_b"])
    return (x.withColumn("_prev", F.coalesce("_pl", "_cp")).withColumn("_next", F.coalesce("_nl", "_cn"))
             .drop("_b", "_pl", "_nl", "_cp", "_cn"))
