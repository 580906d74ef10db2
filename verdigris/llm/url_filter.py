"""Operator 3: URL filter by host and path rules, DataFrame functions only.

Each URL is expanded into (host suffix + path prefix) expressions, the
expressions meet the rules in an equi-join on a 32-bit prefix of their
SHA-256, the full digest confirms a hit, and the longest confirmed rule wins.

Expansion is driven by the rules' own shapes: only the distinct pairs (number
of host labels, path length) that some rule has are produced, so a URL yields
at most as many expressions as there are rule shapes, however long it is.

Defined results: a null URL, or one without ``://``, has an empty host and
path, no rule and the default verdict.  Null ids, repeated rows and repeated
ids are kept: one output row for each input row.  Between two fitting rules of
equal length the longer host wins, then ``block``, then the rule's text.
Repeated rules count once.  Without rules every URL gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import lower_ascii, named

#: Hexadecimal digits of the digest that the join key holds (32 bits).
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    rest = F.substring_index(_after_scheme(url), "/", 1)
    return lower_ascii(F.substring_index(F.substring_index(rest, "?", 1), "#", 1))


def path_of(url: Column) -> Column:
    tail = F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1)
    return tail


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their expression, digest and shape."""
    expression = F.concat("host", "path")
    return (rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
            .where("host is not null and verdict is not null").distinct()
            .select(expression.alias("rule"), _digest(expression).alias("rule_digest"), "verdict",
                    F.length("host").alias("host_length"),
                    F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"))
            .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS)))


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per input row: the id, host, path, rule (null if none fits) and verdict."""
    compiled = compile_rules(rules)
    shapes = compiled.agg(F.sort_array(F.collect_set(F.struct("labels", "path_length"))).alias("shapes"))
    urls = (df.select(named(id_col).alias("_id"), named(url_col).alias("_url"))
            .select(F.monotonically_increasing_id().alias("_row"), "_id",
                    host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"),
                    shapes.scalar().alias("_shapes")))
    labels = F.split("_host", r"\.")
    fits = F.filter("_shapes", lambda s: (s["labels"] <= F.size(labels))
                    & (s["path_length"] <= F.length("_path")) & (F.col("_host") != ""))
    expressions = F.transform(fits, lambda s: F.concat(F.array_join(F.slice(labels, -s["labels"], s["labels"]), "."),
                                                       F.col("_path").substr(F.lit(1), s["path_length"])))
    expanded = (urls.withColumn("_expression", F.explode_outer(expressions))
                .withColumn("_digest", _digest(F.col("_expression")))
                .withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS)))
    hits = expanded.join(compiled, F.col("_prefix") == F.col("rule_prefix"), "left")
    confirmed = F.when(F.col("_digest") == F.col("rule_digest"),
                       F.struct(F.length("rule").alias("length"), "host_length",
                                (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))
    return (hits.groupBy("_row").agg(F.first("_id").alias(id_col), F.first("_host").alias("host"),
                                     F.first("_path").alias("path"), F.max(confirmed).alias("_best"))
            .select(id_col, "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
