"""Places of rows in a total order without a task that sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.quantiles import stored


def numbered(df: DataFrame, order: Sequence[Column], out: str = "_pos") -> DataFrame:
    """``df`` plus its 0-based place ``out`` in ``order``: rows are partitioned
    by ranges of the order and sorted within, and a row's place is its place in
    the partition plus the rows of the partitions before.  The partitioned rows
    are stored, as a range partitioning that is computed again may cut
    elsewhere.  One count for each partition goes through the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .select("*", F.monotonically_increasing_id().alias("_mid")), "numbered")
    part = F.shiftright("_mid", 33)  # the id is the partition's number, then the row's within it
    counts = placed.groupBy(part.cast("int").alias("_part")).agg(F.count("*").alias("_c")).orderBy("_part").collect()
    starts, before = [], 0
    for r in counts:
        starts.append((r["_part"], before))
        before += r["_c"]
    first = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_part", part.cast("int")).join(F.broadcast(first), "_part")
            .withColumn(out, local + F.col("_before")).drop("_part", "_mid", "_before"))
