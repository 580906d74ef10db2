"""Joins of events with validity intervals, of any size (JOIN-05, STR-07).

Time is cut into slots (a day by default) and a binary tree over them.  Each
interval is covered by the O(log length) tree nodes that lie in it, each slot
has one ancestor on each level, and an interval covers a slot exactly if one of
its nodes is an ancestor: an equi-join on (key, level, node).  It runs on the
distinct (key, slot) pairs of the events, so an event is neither copied nor
compared with more than the intervals that touch its slot; events then join the
found intervals on (key, slot).  A key that holds all events, or has an interval
for each day, is dealt by slot, and no table is broadcast or counted first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.time import epoch_micros

DAY_MICROS = 86_400_000_000
#: Slots are numbered from 0 to 2**LEVELS - 1, 1970-01-01 being in the middle; times beyond belong to the outermost slots.
LEVELS = 22


def slot_of(ts: str | Column, slot_micros: int = DAY_MICROS, before: int = 0) -> Column:
    """Number of the slot that holds a time (less ``before`` microseconds)."""
    n = F.floor((epoch_micros(ts) - before) / F.lit(float(slot_micros))).cast("bigint") + (1 << (LEVELS - 1))
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit((1 << LEVELS) - 1).cast("bigint"), n))


def dyadic_cover(first: Column, last: Column) -> Column:
    """The tree nodes that make up the slots from ``first`` to ``last``: an
    array of (level, node), at most two on each level, none if last < first."""
    kind = "array<struct<level:int,node:bigint>>"
    start = F.struct(first.cast("bigint").alias("a"), last.cast("bigint").alias("b"), F.array().cast(kind).alias("out"))

    def climb(acc, level):
        a, b = acc["a"], acc["b"]
        left, right = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)

        def node(take, n):
            return F.when(take, F.array(F.struct(level.alias("level"), n.alias("node")))).otherwise(F.array().cast(kind))
        return F.struct(F.when(a <= b, F.shiftright(F.when(left, a + 1).otherwise(a), 1)).otherwise(a).alias("a"),
                        F.when(a <= b, F.shiftright(F.when(right, b - 1).otherwise(b), 1)).otherwise(b).alias("b"),
                        F.concat(acc["out"], node(left, a), node(right, b)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, climb, lambda acc: acc["out"])


def interval_lookup(events: DataFrame, intervals: DataFrame, key: str, interval_key: str, take: Sequence[str], ts: str = "ts",
                    start: str = "effective_from", end: str = "effective_to", slot_micros: int = DAY_MICROS) -> DataFrame:
    """``events`` with the ``take`` columns of each interval of the same key
    with ``start <= ts < end`` (a NULL end is open), left outer: an event that
    no interval holds has NULLs, one that several hold has a row for each.
    Events without key or time match none, intervals without key or start
    hold none.  Choose slots so that few intervals of a key touch one."""
    events = events.withColumn("_slot", slot_of(ts, slot_micros))
    slots = events.select(F.col(key).alias("_k"), "_slot").dropna().distinct()
    last = F.when(F.col(end).isNull(), F.lit((1 << LEVELS) - 1).cast("bigint")).otherwise(slot_of(end, slot_micros, before=1))
    nodes = (intervals.where(F.col(interval_key).isNotNull() & F.col(start).isNotNull())
             .select(F.col(interval_key).alias("_k"), F.col(start).alias("_from"), F.col(end).alias("_to"), *take,
                     F.inline(dyadic_cover(slot_of(start, slot_micros), last))))
    above = slots.select("_k", "_slot", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    above = above.withColumn("node", F.expr("shiftright(_slot, level)"))
    found = (above.join(nodes, ["_k", "level", "node"])
             .select("_k", F.col("_slot").alias("_s"), "_from", "_to", *[F.col(c).alias(f"_t{i}") for i, c in enumerate(take)]))
    on = ((F.col(key) == F.col("_k")) & (F.col("_slot") == F.col("_s")) & (F.col(ts) >= F.col("_from"))
          & (F.col("_to").isNull() | (F.col(ts) < F.col("_to"))))
    kept = [c for c in events.columns if c != "_slot"]
    return events.join(found, on, "left").select(*kept, *[F.col(f"_t{i}").alias(c) for i, c in enumerate(take)])


def version_intervals(versions: DataFrame, key: str, valid_from: str = "valid_from") -> DataFrame:
    """Versions as intervals: each is valid until the next one of its key."""
    w = Window.partitionBy(key).orderBy(valid_from)
    return versions.withColumn("valid_to", F.lead(valid_from).over(w))
