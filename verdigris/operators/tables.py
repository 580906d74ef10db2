"""Table maintenance on Parquet (SNK-01..12, JOIN-07).

There is no table format with MERGE here, so changes are expressed as
DataFrames (new rows, changed rows, audit rows) and written by appending or
by dynamic partition overwrite of the affected time partitions only.
All timestamps written (created/updated/deleted) come from an ``as_of``
argument, never the wall clock, so a re-run task writes the same bytes.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.time import time_bucket
from verdigris.session import checkpoint_dir


def _ts(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/verdigris-tables/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- SNK-01 / JOIN-07
def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` to append: first row per key (by ``order``, e.g.
    file and line number) whose key is not already in ``target``.  The
    existing row wins.  Dedup is a row_number = 1 filter, planned with a
    per-partition group limit before the shuffle."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
    first = incoming.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    existing = target.select(*keys).distinct()
    return first.join(existing, keys, "left_anti")


# ---------------------------------------------------------------- SNK-02 / 03
def stamp_new_records(records: DataFrame, created_by, as_of, start_version: int = 1) -> DataFrame:
    """SNK-02 / SNK-03: CO2e computed, common created/updated time, creator,
    version 1, not deleted."""
    from verdigris.operators.carbon import with_co2e
    t = _ts(as_of)
    out = with_co2e(records) if "co2e_kg" not in records.columns else records
    return (out.withColumn("created_by", F.lit(created_by) if not isinstance(created_by, Column) else created_by)
               .withColumn("created_at", t).withColumn("updated_at", t)
               .withColumn("version", F.lit(start_version))
               .withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")))


def append_run(df: DataFrame, path: str, run_id: str, partition_by: Sequence[str] = ()) -> None:
    """Appends one run's rows below ``path``: each run has its own folder
    ``run_id=...`` and overwrites it, so a retried run doesn't write twice."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path.rstrip('/')}/run_id={run_id}")


def insert_ignore_run(incoming: DataFrame, path: str, run_id: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """SNK-01, written: appends one run's rows whose keys no other run of the
    table at ``path`` has (a new table: all first rows per key).  The run's own
    rows don't count as existing, so a retried run writes the same rows."""
    from verdigris.session import hadoop_path
    spark = incoming.sparkSession
    p, fs = hadoop_path(spark, path)
    others = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
    others = [x for x in others if "/run_id=" in x and not x.endswith(f"/run_id={run_id}")]
    target = spark.read.schema(incoming.schema).parquet(*others) if others else incoming.limit(0)
    append_run(insert_ignore(target, incoming, keys, order), path, run_id)


# ---------------------------------------------------------------- SNK-04
UPDATABLE = ("co2_kg", "energy_kwh", "water_l")


def apply_updates(table: DataFrame, updates: DataFrame, user_id, is_admin: bool, as_of,
                  key: str = "record_id", cols: Sequence[str] = UPDATABLE, order: str | None = None) -> DataFrame:
    """Partial update: only supplied (non-NULL) fields change, ``updated_at``
    is bumped and ``version`` incremented -- for rows the caller may change
    (admin, or the record's creator).  Of several updates for one key each
    field takes its newest supplied value by ``order`` (without it, the
    greatest).  Returns the whole table with updates applied; unaffected rows
    pass through unchanged."""
    def newest(c: str) -> Column:
        given = F.col(c).isNotNull()
        return F.max_by(c, F.when(given, F.struct(order, c))) if order else F.max(c)

    u = updates.groupBy(key).agg(*[newest(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = table.join(u, key, "left")
    allowed = F.coalesce(F.col("_hit"), F.lit(False)) & (F.lit(bool(is_admin)) | (F.col("created_by") == F.lit(user_id)))
    out = j
    for c in cols:
        out = out.withColumn(c, F.when(allowed, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)))
    out = (out.withColumn("updated_at", F.when(allowed, _ts(as_of)).otherwise(F.col("updated_at")))
              .withColumn("version", F.when(allowed, F.col("version") + 1).otherwise(F.col("version"))))
    return out.drop("_hit", *[f"_new_{c}" for c in cols])


# ---------------------------------------------------------------- SNK-05
def soft_delete(table: DataFrame, delete_keys: DataFrame, is_admin: bool, as_of, key: str = "record_id") -> DataFrame:
    """Set ``deleted_at`` for the given keys (admin only; a non-admin call
    changes nothing).  Already-deleted rows keep their first deletion time."""
    if not is_admin:
        return table
    k = delete_keys.select(key).distinct().withColumn("_del", F.lit(True))
    j = table.join(k, key, "left")
    hit = F.coalesce(F.col("_del"), F.lit(False)) & F.col("deleted_at").isNull()
    return (j.withColumn("deleted_at", F.when(hit, _ts(as_of)).otherwise(F.col("deleted_at")))
             .withColumn("updated_at", F.when(hit, _ts(as_of)).otherwise(F.col("updated_at")))
             .drop("_del"))


# ---------------------------------------------------------------- SNK-06
def audit_trail(old: DataFrame, new: DataFrame, key: str, compare: Sequence[str], changed_by, as_of) -> DataFrame:
    """One audit row per created (C), updated (U) or deleted (D) record:
    full outer join of two snapshots on the key; unchanged rows emit
    nothing.  A soft delete (deleted_at set) is reported as D."""
    o = old.select(key, F.struct(*compare).alias("_old"))
    n = new.select(key, F.struct(*compare).alias("_new"))
    j = o.join(n, key, "full")
    soft_deleted = (F.col("_old.deleted_at").isNull() & F.col("_new.deleted_at").isNotNull()
                    if "deleted_at" in compare else F.lit(False))
    changed = F.lit(False)
    for c in compare:                      # null-safe, column by column
        changed = changed | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    op = (F.when(F.col("_old").isNull(), F.lit("C"))
           .when(F.col("_new").isNull(), F.lit("D"))
           .when(soft_deleted, F.lit("D"))
           .when(changed, F.lit("U")))
    # JSON text is produced only for the rows that are written.
    return (j.withColumn("operation_type", op).filter(F.col("operation_type").isNotNull())
             .select(F.col(key).alias("record_id"), "operation_type",
                     F.to_json("_old").alias("old_values"), F.to_json("_new").alias("new_values"),
                     F.lit(changed_by).alias("changed_by"), _ts(as_of).alias("changed_at")))


# ---------------------------------------------------------------- SNK-07 / 08 / 09
CHUNK = {"emission_metrics": "1 week", "energy_usage": "1 day", "emission_records": "7 days"}


def _chunk_of(width: str, ts: str) -> Column:
    return F.to_date(time_bucket(width, ts))


#: Bytes of input that a task of a rewrite reads at most: it sorts its rows by chunk, which should fit its memory.
REWRITE_SPLIT = 32 << 20


@contextmanager
def _lean(spark: SparkSession):
    """While a table is rewritten: files are read in small splits, and a
    step's shuffle files are removed when it ends, not when the driver
    collects garbage, so the disk holds one step's at a time."""
    split, clean = "spark.sql.files.maxPartitionBytes", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {k: spark.conf.get(k, None) for k in (split, clean)}
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(split))
    spark.conf.set(split, str(min(least, REWRITE_SPLIT)))
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write_chunks(rows: DataFrame, path: str, width: str, ts: str, mode: str = "overwrite", compression: str | None = None,
                  order: Sequence[Column] = (), made: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> None:
    """Rows dealt by chunk; a rebalance, so a chunk that holds much of the
    table is split over tasks (``dealt``: they lie by chunk already).  The
    width is kept as metadata of the time column, for readers that prune
    chunks.  Without a named compression it is zstd at its quickest."""
    out = rows if dealt else rows.hint("rebalance", "chunk")
    if made:
        out = made(out)
    if order:
        out = out.sortWithinPartitions("chunk", *order)
    w = (out.withMetadata(ts, {"chunk_width": width}).write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("chunk").option("compression", compression or "zstd"))
    (w if compression else w.option("parquet.compression.codec.zstd.level", "1")).parquet(path)


def write_chunked(df: DataFrame, path: str, width: str = "1 day", ts: str = "ts", mode: str = "overwrite",
                  order: Sequence[str] = (), made: Callable[[DataFrame], DataFrame] | None = None, at: str | None = None) -> None:
    """SNK-07: time-chunked layout: a derived ``chunk`` column (bucket start
    date) is the partition column, so readers that filter on it prune whole
    folders; rows are clustered by chunk before the write so each task
    writes few files, ordered by ``order`` within them, which packs them
    closer.  ``made`` makes the table's rows, row by row, of those of ``df``
    (whose time is ``at``) and keeps ``chunk``: it runs after rows are dealt,
    so the shuffle carries the columns of ``df`` only."""
    with _lean(df.sparkSession):
        _write_chunks(df.withColumn("chunk", _chunk_of(width, at or ts)), path, width, ts, mode,
                      order=[F.col(c) for c in order], made=made)


def chunk_width(df: DataFrame, ts: str = "ts", default: str = "1 day") -> str:
    """The chunk width that the table's writer recorded."""
    return df.schema[ts].metadata.get("chunk_width", default)


def compact_cold(df: DataFrame, path: str, as_of, older_than_days: int = 30, ts: str = "ts",
                 segment_by: str = "facility_id", width: str | None = None) -> DataFrame:
    """SNK-08: rewrite the chunks that end at or before the cut-off, clustered
    by the segment key and ordered newest first within files (zstd).  A chunk
    that the cut-off divides stays as it is.  Only those chunks are overwritten
    (dynamic partition overwrite); returns the rewritten rows.

    ``df`` is usually the table at ``path`` itself, so the cold rows are
    first materialised with a reliable checkpoint in the shared checkpoint
    folder: the overwrite then reads the checkpoint, not the files it
    replaces, and a lost executor recomputes from the checkpoint."""
    from verdigris.session import cut_lineage
    width = width or chunk_width(df, ts)
    cut = _ts(as_of) - F.expr(f"INTERVAL {int(older_than_days)} DAYS")
    # rows of chunks before the one that holds the cut-off, that is chunks that end by then
    cold = df.filter(F.col(ts) < time_bucket(width, cut)).withColumn("chunk", _chunk_of(width, ts))
    cold = cut_lineage(cold)
    _write_chunks(cold, path, width, ts, compression="zstd", order=[F.col(segment_by), F.desc(ts)])
    return cold


RETENTION_DAYS = {"raw": 365, "aggregate": 5 * 365}


def retain(df: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    """SNK-09: rows inside the retention horizon (``ts >= as_of - days``)."""
    return df.filter(F.col(ts) >= _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


# ---------------------------------------------------------------- SNK-10 / 11 / 12
def prediction_rows(scored: DataFrame, model_version: str, as_of=None) -> DataFrame:
    """SNK-10: prediction table rows with JSON explanation/credit columns."""
    out = scored
    if "explanations" in out.columns:
        out = out.withColumn("explanations", F.to_json("explanations"))
    if "credits" in out.columns:
        out = out.withColumn("credits", F.to_json("credits"))
    return out.withColumn("model_version", F.lit(model_version))


def run_log(results: DataFrame, run_id: str, kind: str = "batch", ok: str = "ok") -> DataFrame:
    """SNK-11: one row per run: size and success count."""
    return results.agg(F.count("*").alias("batch_size"), F.count_if(F.col(ok)).alias("success_count")).select(
        F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "batch_size", "success_count")


def export_report(table: DataFrame, totals: DataFrame, path: str) -> None:
    """SNK-12: report table as CSV plus a JSON metadata file of totals.
    Both are small aggregates (one row per day / one row)."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/table")
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


# ---------------------------------------------------------------- PRJ-18
def protect_column(df: DataFrame, col: str, key_hex: str, out: str | None = None) -> DataFrame:
    """PRJ-18: AES-GCM encrypt a JSON/text payload column (base64 text out).
    The key is passed in by the caller (from the cluster's secret store),
    never stored with the data."""
    out = out or col
    key = F.unhex(F.lit(key_hex))
    payload = F.col(col) if dict(df.dtypes)[col] == "string" else F.to_json(F.col(col))
    return df.withColumn(out, F.base64(F.aes_encrypt(payload, key, F.lit("GCM"))))


def reveal_column(df: DataFrame, col: str, key_hex: str, out: str | None = None) -> DataFrame:
    """PRJ-18: inverse of ``protect_column``; a wrong key gives NULL."""
    out = out or col
    key = F.unhex(F.lit(key_hex))
    return df.withColumn(out, F.try_aes_decrypt(F.unbase64(F.col(col)), key, F.lit("GCM")).cast("string"))


# ---------------------------------------------------------------- merge by partition rewrite
#: Chunks whose list a merge reads back to prune folders; beyond, folders are pruned by their range only.
MAX_LISTED_CHUNKS = 10_000


#: Bits that stand for the keys of a change, at any number of keys: a broadcast of 32 MB at most, 4 KB a part.
KEY_BITS = 28
_PART_BITS = 15


def _places(key: str | Column) -> tuple[Column, list[Column]]:
    """A key's part of the bits and its two places in that part."""
    h = F.xxhash64(key)
    low = KEY_BITS - _PART_BITS
    places = [F.shiftrightunsigned(h, n).bitwiseAND(F.lit((1 << _PART_BITS) - 1)).cast("int") for n in (low, KEY_BITS)]
    return h.bitwiseAND(F.lit((1 << low) - 1)), places


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """Bits of all keys: a row for each part that has any, written once; its
    bytes as 1,024 numbers, the first byte highest."""
    from verdigris.functions.quantiles import stored
    part, (one, two) = _places(key)
    k = keys.filter(F.col(key).isNotNull()).select(part.alias("_part"), one.alias("_one"), two.alias("_two")).repartition("_part")
    bits = k.select("_part", F.explode(F.array("_one", "_two")).alias("_p")).groupBy("_part").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_p") + 1)).alias("_bits"))
    word = lambda i: F.conv(F.hex(F.substring(F.col("_bits"), 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda v: (v.bitwiseXOR(F.lit(1 << 31)) - (1 << 31)).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.lit((1 << _PART_BITS) // 32 - 1)), lambda i: signed(word(i)))
    return stored(bits.select("_part", words.alias("_words")), "key-bits")


def _hash_alike(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether equal keys have equal hashes: of one type, compared by bytes."""
    one, two = (x.schema[key].dataType for x in (a, b))
    return one == two and "collate" not in one.simpleString()


def with_may(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_may``: false where a row's key (or NULL) is surely none
    of ``keys``.  A few others are true by chance, more of them the more keys
    there are (all, where keys differ in type), so the exact join still
    follows; it needs only rows that may be joined, and the others aren't
    shuffled."""
    if not _hash_alike(df, keys, key):
        return df.withColumn("_may", F.col(key).isNotNull())
    bits, (part, places) = key_bits(keys, key), _places(key)

    def bit(p: Column) -> Column:
        at = 8 * (3 - F.shiftright(p, 3).bitwiseAND(F.lit(3))) + p.bitwiseAND(F.lit(7))
        return F.call_function("shiftright", F.get("_words", F.shiftright(p, 5)), at).bitwiseAND(F.lit(1)) == 1

    j = df.withColumn("_part", F.when(F.col(key).isNotNull(), part)).join(F.broadcast(bits), "_part", "left")
    return j.withColumn("_may", F.col("_words").isNotNull() & bit(places[0]) & bit(places[1])).drop("_part", "_words")


def _only_may(marked: DataFrame, key: str) -> DataFrame:
    """The rows that may have a key.  Their key is said to depend on
    ``_may``, or Spark would move a semi or anti join by key below it."""
    return marked.filter("_may").withColumn(key, F.when(F.col("_may"), F.col(key))).drop("_may")


def rows_with_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose key is in ``keys``: a semi join of the rows
    whose key may be."""
    may = _only_may(with_may(table, keys, key), key)
    return may.join(keys.select(key), key, "left_semi").select(*table.columns)


def merge_into_chunks(path: str, changed: DataFrame, key: str, ts: str = "ts", width: str | None = None) -> DataFrame:
    """Upsert ``changed`` rows (updated, soft-deleted or new; one per key) into
    the time-chunked table at ``path`` (SNK-07 layout) without a table format:
    only the chunks that hold an old or the new row of a changed key are
    rewritten, by dynamic partition overwrite, so a row whose time moved leaves
    its old chunk.  The touched chunks' list (a few dates, size-checked; else
    their range) is a literal filter, so other folders aren't read.

    Rows whose key is surely not changed (``with_may``) go from their folder to
    the new one without a shuffle; others are joined by key, and what remains
    of them is dealt by chunk with the changed rows.  So a merge adds about a
    file to each touched chunk; ``compact_cold`` gathers them.  The overwrite
    writes beside the folders it reads and replaces them when all tasks are
    done, so the rows needn't be kept apart.  It leaves the folders of touched
    chunks that have no row any more, known by their old files, so these are
    deleted after it; between the two a reader sees rows that left such a chunk
    twice, and a retry of an interrupted merge repairs it.  Rows without a time
    are a chunk like others.  Returns the rewritten rows, read from the table."""
    with _lean(changed.sparkSession):
        return _merge_into_chunks(path, changed, key, ts, width)


def _merge_into_chunks(path: str, changed: DataFrame, key: str, ts: str, width: str | None) -> DataFrame:
    from verdigris.functions.quantiles import stored
    spark = changed.sparkSession
    table = spark.read.parquet(path)
    before = set(table.inputFiles())
    width = width or chunk_width(table, ts)
    ch = stored(changed.withColumn("chunk", _chunk_of(width, ts)).select(*table.columns), "merge-changed")
    marked = with_may(table, ch, key)
    # by the key's hash, narrower than the key: two keys of one hash would only have a chunk more rewritten
    h = (F.xxhash64(key) if _hash_alike(table, ch, key) else F.col(key)).alias("_h")
    old = _only_may(marked, key).select(h, "chunk").join(ch.filter(F.col(key).isNotNull()).select(h), "_h", "left_semi")
    touched = stored(old.select("chunk").unionByName(ch.select("chunk")).distinct(), "merge-chunks")
    listed = [r.chunk for r in touched.limit(MAX_LISTED_CHUNKS + 1).collect()]
    if len(listed) <= MAX_LISTED_CHUNKS:
        none = F.col("chunk").isNull() if None in listed else F.lit(False)
        inside = lambda df: df.filter(F.col("chunk").isin([c for c in listed if c is not None]) | none)
    else:
        low, high = touched.agg(F.min("chunk"), F.max("chunk")).first()
        inside = lambda df: _in_chunks(df.filter(F.col("chunk").between(low, high) | F.col("chunk").isNull()), touched, "left_semi")
    part = inside(marked)
    joined = _only_may(part, key).join(ch.select(key), key, "left_anti").select(*table.columns).unionByName(ch)
    joined = joined.hint("rebalance", "chunk").sortWithinPartitions("chunk", key)  # near keys pack closer
    rows = part.filter("NOT _may").select(*table.columns).unionByName(joined)
    _write_chunks(rows, path, width, ts, dealt=True)
    read = lambda: inside(spark.read.schema(rows.schema).parquet(path))
    left = {f.rsplit("/", 2)[-2].partition("=")[2] for f in read().inputFiles() if f in before}
    left = [None if c == _NO_CHUNK else dt.date.fromisoformat(c) for c in left]
    gone = _in_chunks(touched, spark.createDataFrame([(c,) for c in left], "chunk date"), "left_semi").collect() if left else []
    _delete_chunks(spark, path, [r.chunk for r in gone])
    return read()


def _in_chunks(df: DataFrame, chunks: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by chunk, null-safe."""
    return df.alias("d").join(chunks.alias("c"), F.col("d.chunk").eqNullSafe(F.col("c.chunk")), how)


_NO_CHUNK = "__HIVE_DEFAULT_PARTITION__"


def _delete_chunks(spark: SparkSession, path: str, chunks: Sequence) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for chunk in chunks:
        name = _NO_CHUNK if chunk is None else chunk.isoformat()
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"chunk={name}"), True)


def expire_chunks(spark: SparkSession, path: str, as_of, days: int, ts: str = "ts") -> list:
    """SNK-09 on a time-chunked table: removes the chunks that end at or before
    the horizon (``as_of - days``) and returns their dates.  A chunk that the
    horizon divides stays; ``retain`` filters its rows on reading."""
    table = spark.read.parquet(path)
    width = chunk_width(table, ts)
    horizon = time_bucket(width, _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    gone = [r.chunk for r in table.filter(F.col("chunk") < F.to_date(horizon)).select("chunk").distinct()
            .orderBy("chunk").collect()]  # one date per expired chunk
    _delete_chunks(spark, path, gone)
    return gone
