"""File sources (SRC-01..05, SRC-09).

Every reader declares its schema (no inference pass over the data) and
recurses into folders with Spark's own file listing, which is distributed
for large folder trees.  Parsing is column expressions: a bad row becomes a
reject row, never a failed file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.time import parse_timestamp
from verdigris.operators.validate import required_present, split_valid
from verdigris.session import hadoop_path

# Historical meter export: its field names, as the files' headers give them.
CSV_SCHEMA = T.StructType([
    T.StructField("Timestamp", T.StringType()), T.StructField("FacilityID", T.StringType()),
    T.StructField("Energy_kWh", T.StringType()), T.StructField("Source", T.StringType()),
])
SUPPORTED_EXTENSIONS = ("csv", "json")


def _to_energy_usage(raw: DataFrame) -> DataFrame:
    return raw.select(
        parse_timestamp("Timestamp").alias("ts"),
        F.col("FacilityID").alias("facility_id"),
        F.col("Energy_kWh").try_cast("double").alias("kwh"),
        F.col("Source").alias("source"),
        "file_path", F.regexp_extract("file_path", "[^/]*$", 0).alias("file_name"),
    )


#: Bytes of a file that are read for its header, and files whose headers are read at a time.
HEADER_BYTES, HEADER_READERS = 1 << 16, 16


def _head(fs, path) -> str:
    """The beginning of a file, after a byte order mark."""
    stream = fs.open(path)
    try:
        return bytes(stream.readNBytes(HEADER_BYTES)).decode("utf-8", "replace").removeprefix("\ufeff")
    finally:
        stream.close()


def header_catalogue(spark: SparkSession, path: str, names: Sequence[str], suffix: str = ".csv") -> dict[tuple[str, ...] | None, list[str]]:
    """The distinct headers of the files under ``path`` that end in ``suffix``,
    each with its files; None for files whose first record has fewer than two
    of ``names``.  Each file is opened for one short read.  Hidden and empty
    files are left out, as Spark's readers do."""
    root, fs = hadoop_path(spark, path)
    listed, files = fs.listFiles(root, True), []
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().getName()
        hidden = any(p[:1] in ("_", ".") and "=" not in p for p in str(f.getPath())[len(str(fs.makeQualified(root))):].split("/"))
        if name.endswith(suffix) and f.getLen() and not hidden:
            files.append(f.getPath())

    def header(file):
        lines = csv.reader(io.StringIO(_head(fs, file), newline=""))
        first = next((x for x in lines if any(v.strip() for v in x)), [])
        fields = tuple(v.strip() for v in first)
        return file.toString(), fields if len(set(fields) & set(names)) >= 2 else None

    found: dict[tuple[str, ...] | None, list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for file, fields in pool.map(header, files):
            found.setdefault(fields, []).append(file)
    return found


def read_csv_by_header(spark: SparkSession, path: str, names: Sequence[str], multi_line: bool = True) -> DataFrame:
    """All ``*.csv`` under ``path`` as text columns ``names`` plus
    ``file_path``; each file's own header says where a column is, so files may
    order their columns differently and have others beside them.  A file
    without one of the columns gives NULLs there; one without any header line
    gives only NULLs (its rows are rejected, not lost).

    The headers are catalogued first (one short read of each file), then the
    files of each distinct header are read together, with as many columns as
    it has.  Quoted fields may hold line breaks, commas and doubled quotes.
    For that a file is read by one task; without ``multi_line`` large files
    are split, and a record ends at its line."""
    catalogue, out = header_catalogue(spark, path, names), None
    for fields, files in sorted(catalogue.items(), key=lambda x: (x[0] is not None, x[0] or ())):
        width = len(fields or ()) or 1
        reader = (spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("header", fields is not None)
                  .option("enforceSchema", True).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
                  .option("maxColumns", max(20480, width)).option("ignoreLeadingWhiteSpace", False))
        place = {n: i for i, n in reversed([*enumerate(fields or ())])}
        rows = reader.csv(files).select(F.col("_metadata.file_path").alias("file_path"), *[
            (F.col(f"c{place[n]}") if n in place else F.lit(None).cast("string")).alias(n) for n in names])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], ", ".join(["file_path string", *(f"`{n}` string" for n in names)]))
    return out


def load_historical_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-01 (+ VAL-14): all ``*.csv`` under ``path`` -> (energy_usage rows,
    rejects).  Columns are bound by header name and facility ids stay text.  A
    row missing a required value, or with an unparseable timestamp / kWh, is
    rejected alone (the rest of its file is kept)."""
    raw = read_csv_by_header(spark, path, CSV_SCHEMA.names)
    return split_valid(_to_energy_usage(raw), required_present(["ts", "facility_id", "kwh"]))


def load_historical_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-02: JSON lines with the same fields -> same target as SRC-01."""
    raw = (spark.read.schema(CSV_SCHEMA).option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.json").json(path).withColumn("file_path", F.col("_metadata.file_path")))
    return split_valid(_to_energy_usage(raw), required_present(["ts", "facility_id", "kwh"]))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: every file under ``path`` with its extension and whether it is
    loaded; unsupported files are reported (with a 0 row count) and skipped.
    Only file metadata is read (``content`` is never selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                  .select("path", "length"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length", ext.alias("extension"),
                        ext.isin(*SUPPORTED_EXTENSIONS).alias("supported"))


def stage_raw(spark: SparkSession, path: str, ingested_at, pattern: str | None = None) -> DataFrame:
    """SRC-04: raw staging rows: the whole line payload, source file name and
    ingest time (passed in, so a retried task writes the same value)."""
    r = spark.read.option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    t = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at).cast("timestamp_ntz")
    return r.text(path).select(F.col("value").alias("raw_data"), F.col("_metadata.file_name").alias("file_name"),
                               t.alias("ingested_at"))


def read_chunked(spark: SparkSession, path: str, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Read a SNK-07 time-chunked table; a [start, end] range is applied to
    both the partition column (folder pruning) and the timestamp."""
    from verdigris.operators.timeseries import prune_chunks
    df = spark.read.parquet(path)
    if start is None and end is None:
        return df
    lo = F.lit(start).cast("timestamp_ntz") if start is not None else None
    hi = F.lit(end).cast("timestamp_ntz") if end is not None else None
    df = prune_chunks(df, lo, hi, ts)
    if lo is not None:
        df = df.filter(F.col(ts) >= lo)
    return df.filter(F.col(ts) <= hi) if hi is not None else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-05: feature / scoring input; selecting columns early lets the scan
    read only those column chunks."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def long_to_wide(df: DataFrame, kinds: Sequence[str], keys: Sequence[str] = ("timestamp",),
                 kind: str = "sensor_kind", value: str = "value", order: str = "ts") -> DataFrame:
    """SRC-09: long sensor batch -> one column per sensor kind (the latest
    value per key and kind).  ``kinds`` is given, so the pivot needs no
    distinct pass; it is a single partial aggregate."""
    return df.groupBy(*keys).pivot(kind, list(kinds)).agg(F.max_by(value, order))


def ingest_report(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: one row per file under ``path``: extension, whether it is
    loaded, and the rows it contributed, rejects not counted (0 for skipped,
    unsupported files).  Row counts are partial aggregates over the file path."""
    inv = file_inventory(spark, path)
    loaded = [load(spark, path)[0].groupBy("file_path").agg(F.count("*").alias("_r"))
              for load in (load_historical_csv, load_historical_json)]
    counts = loaded[0].unionByName(loaded[1]).withColumnRenamed("file_path", "path")
    return (inv.join(counts, "path", "left")
               .select("path", "extension", "supported",
                       F.when(F.col("supported"), F.coalesce("_r", F.lit(0))).otherwise(F.lit(0))
                       .cast("bigint").alias("rows_loaded")))
