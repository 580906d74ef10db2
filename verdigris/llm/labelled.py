"""Labelled texts to learn from: a bounded sample, one text for each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import named, stored


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int,
                   max_bytes: int, name: str) -> DataFrame:
    """Rows of id, y and text (null: empty): the labelled ids with the smallest
    hash, at most ``max_rows`` and ``max_bytes`` of text; all where there are
    fewer.  y is 1 if the mean of an id's labels is 0.5 or more; of several
    texts of an id the least one counts; null labels and ids are left out."""
    mean = F.avg(named(label_col).cast("double"))
    chosen = (labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("label_id"))
              .agg((mean >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    rows = (docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), F.col("id") == F.col("label_id")))
    rows = stored(rows.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")), name)
    size = rows.select("id", F.octet_length("text").cast("long").alias("size"))  # max_rows rows at most
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    within = size.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select(F.col("id").alias("within"))
    return rows.join(F.broadcast(within), F.col("id") == F.col("within")).select("id", "y", "text")
