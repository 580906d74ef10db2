"""Helpers shared by the corpus operators: tables, scratch tables, bounded
broadcasts and Arrow batch access."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.session import checkpoint_dir

#: Largest object this package broadcasts (vocabularies, weights, sketches, one block of a query set).
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the
    lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(spark: SparkSession, value, n_bytes: int):
    if n_bytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"{n_bytes} bytes exceed the broadcast bound of {MAX_BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(value)


def vocabulary(spark: SparkSession, path: str):
    """A vocabulary file, read on the driver and broadcast as bytes, so that
    executors need no copy of the file."""
    with open(path, "rb") as f:
        raw = f.read()
    return bounded_broadcast(spark, raw, len(raw))


def partitions_for(df: DataFrame, units: int, per_partition: int) -> int:
    """Partitions for ``units`` rows or bytes at ``per_partition`` each, and
    not fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(units) // per_partition))


def named(name: str):
    """The top-level column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(col):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n + 1 row
    offsets into them; null counts as empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, limit: int):
    """Ranges of whole rows with up to ``limit`` bytes each (one row at least)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def small_batches(batches, column: int, limit: int = 4 << 20):
    """The rows of Arrow batches in batches whose ``column`` (texts or binary)
    has up to ``limit`` bytes (one row at least), which bounds what a task
    holds at a time."""
    for batch in batches:
        _, offs = bytes_of(batch.column(column))
        for i, j in row_slices(offs, limit):
            yield batch.slice(i, j - i)


def released(task):
    """The task, and after it the memory that its worker process would keep
    though nothing uses it: workers serve one task after another."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run
