"""Operator 2: exact dedup over a cuckoo-filter index of text digests.

Texts are equal when identical after lower-casing A-Z.  The index is a table
with one row per digest bucket: the bucket's cuckoo filter and its content, the
live digests with their group size and the row that stays.  A digest that the
filter doesn't know is new; a hit is verified against the bucket's content; an
insertion that finds no slot doubles the filter and refills it from the stored
keys.  Deletions take a row off its group and free the digest's slot with the
group's last row.

Work is dealt by bucket, and each Arrow batch sends one row per distinct digest
at most, so a text that a third of all rows share doesn't pile up in one task.
Buckets are sized from the number of rows, so one bucket fits in a task.

Defined results: null counts as empty; empty texts are equal to each other.
The row with the largest id stays (a null id is smaller than any); among
repeated rows with that id, one stays.  Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import free_name, named, partitions_for, released, small_batches, stored

#: Digests that one bucket is meant to hold.
BUCKET_DIGESTS = 100_000
#: Slots of one place in a filter, and moves before an insertion counts as overflow.
SLOTS, MAX_MOVES = 4, 200

_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHANGES = "bucket int, digest binary, keep_id {0}, keep_row long, rows long"
_INDEX = "bucket int, places int, slots binary, digests binary, keep_ids array<{0}>, keep_rows array<long>, rows array<long>"


class CuckooFilter:
    """16-bit fingerprints in places of four slots; a digest has two places."""

    def __init__(self, places: int, slots: bytes | None = None):
        self.places = places
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * places))

    def _where(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & (self.places - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995 >> 7)) & (self.places - 1)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._where(digest)
        return mark in self.slots[a * SLOTS:(a + 1) * SLOTS] or mark in self.slots[b * SLOTS:(b + 1) * SLOTS]

    def _put(self, place: int, mark: int) -> bool:
        for i in range(place * SLOTS, (place + 1) * SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False if it overflows; the filter is then to be rebuilt larger."""
        mark, a, b = self._where(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        place = b
        for move in range(MAX_MOVES):
            i = place * SLOTS + move % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            place = self._other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._where(digest)
        for place in (a, b):
            for i in range(place * SLOTS, (place + 1) * SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        return False


class DigestBucket:
    """One bucket: a filter before the stored content."""

    def __init__(self, places: int = 64, slots: bytes | None = None):
        self.filter = CuckooFilter(places, slots)
        self.content: dict[bytes, list] = {}

    def insert(self, digest: bytes, keep: tuple, rows: int) -> None:
        if digest in self.filter and (entry := self.content.get(digest)) is not None:
            entry[0] = max(entry[0], keep, key=_order)
            entry[1] += rows
            return
        self.content[digest] = [keep, rows]
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes, rows: int) -> None:
        if digest not in self.filter or (entry := self.content.get(digest)) is None:
            return
        entry[1] -= rows
        if entry[1] <= 0:
            del self.content[digest]
            self.filter.delete(digest)

    def _resize(self) -> None:
        places = self.filter.places
        while True:
            places *= 2
            self.filter = CuckooFilter(places)
            if all(self.filter.insert(d) for d in self.content):
                return


def _order(keep: tuple):
    row_id, row = keep
    return row_id is not None, row_id if row_id is not None else 0, row


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Stored rows of id, row (a number of its own, or the long key
    ``row_col``), t (a hash of the text as it is) and the normalised text's
    SHA-256."""
    text = F.coalesce(named(text_col), F.lit(""))
    row = F.monotonically_increasing_id() if row_col is None else named(row_col).cast("long")
    narrow = df.select(named(id_col).alias("id"), row.alias("row"),
                       F.xxhash64(text).alias("t"), text.alias("text"))

    def task(batches):
        for batch in small_batches(batches, 3):
            texts = batch.column(3).cast(pa.large_binary()).to_pylist()
            marks = [hashlib.sha256(t.translate(_UPPER_TO_LOWER)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(marks, pa.binary())],
                                             ["id", "row", "t", "digest"])

    kind = narrow.schema["id"].dataType.simpleString()
    return stored(narrow.mapInArrow(released(task), f"id {kind}, row long, t long, digest binary"), "digests")


def changes(rows: DataFrame, buckets: int) -> DataFrame:
    """Digest rows reduced to one change per distinct digest of an Arrow batch."""

    def task(batches):
        for batch in batches:
            seen: dict[bytes, list] = {}
            for row_id, row, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (entry := seen.get(digest)) is None:
                    seen[digest] = [(row_id, row), 1]
                else:
                    entry[0] = max(entry[0], (row_id, row), key=_order)
                    entry[1] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(d[-4:], "big") % buckets for d in keys], pa.int32()),
                 pa.array(keys, pa.binary()), pa.array([seen[d][0][0] for d in keys], batch.schema.field(0).type),
                 pa.array([seen[d][0][1] for d in keys], pa.int64()), pa.array([seen[d][1] for d in keys], pa.int64())],
                ["bucket", "digest", "keep_id", "keep_row", "rows"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "row", "digest").mapInArrow(released(task), _CHANGES.format(kind))


def buckets_for(n_rows: int) -> int:
    return max(1, -(-n_rows // BUCKET_DIGESTS))


def updated(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None,
            name: str = "digest-index") -> DataFrame:
    """The stored next version of an index after deletions and insertions
    (both as ``changes`` makes them, with the index's number of buckets).
    Deletions lower a group's count and drop it at 0; they don't look for
    another keeper, which ``advanced`` does."""
    kind = inserts.schema["keep_id"].dataType.simpleString()
    empty = "cast(null as int) places", "cast(null as binary) slots", "cast(null as binary) digests", \
        f"cast(null as array<{kind}>) keep_ids", "cast(null as array<bigint>) keep_rows", "cast(null as array<bigint>) counts"
    parts = [inserts.selectExpr("bucket", "2 step", "digest", "keep_id", "keep_row", "rows", *empty)]
    if deletes is not None:
        parts.append(deletes.selectExpr("bucket", "1 step", "digest", "keep_id", "keep_row", "rows", *empty))
    if index is not None:
        parts.append(index.selectExpr("bucket", "0 step", "cast(null as binary) digest", f"cast(null as {kind}) keep_id",
                                      "cast(null as bigint) keep_row", "cast(null as bigint) rows", "places", "slots",
                                      "digests", "keep_ids", "keep_rows", "rows as counts"))
    steps = parts[0]
    for part in parts[1:]:
        steps = steps.unionByName(part)

    def task(batches):
        bucket, state, id_type = None, None, None

        def out():
            held = state.content
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([state.filter.places], pa.int32()),
                 pa.array([state.filter.slots.tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary()),
                 pa.array([[e[0][0] for e in held.values()]], pa.list_(id_type)),
                 pa.array([[e[0][1] for e in held.values()]], pa.list_(pa.int64())),
                 pa.array([[e[1] for e in held.values()]], pa.list_(pa.int64()))],
                ["bucket", "places", "slots", "digests", "keep_ids", "keep_rows", "rows"])

        for batch in batches:
            id_type = batch.schema.field("keep_id").type
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    if state is not None:
                        yield out()
                    bucket, state = r["bucket"], DigestBucket()
                if r["step"] == 0:
                    state = DigestBucket(r["places"], r["slots"])
                    marks = [r["digests"][i:i + 32] for i in range(0, len(r["digests"]), 32)]
                    state.content = {d: [(i, n), c] for d, i, n, c in
                                     zip(marks, r["keep_ids"], r["keep_rows"], r["counts"], strict=True)}
                elif r["step"] == 1:
                    state.delete(r["digest"], r["rows"])
                else:
                    state.insert(r["digest"], (r["keep_id"], r["keep_row"]), r["rows"])
        if state is not None:
            yield out()

    parts_n = partitions_for(steps, 0, 1)
    dealt = steps.repartition(parts_n, "bucket").sortWithinPartitions("bucket", "step")
    return stored(dealt.mapInArrow(released(task), _INDEX.format(kind)), name)


class Version(NamedTuple):
    """An index and the live rows (id, row, digest) that it stands for."""

    members: DataFrame
    index: DataFrame
    buckets: int


#: More rows than a group has: a deletion of so many drops it.
_ALL_ROWS = 1 << 62


def advanced(version: Version | None, inserts: DataFrame, deletes: DataFrame | None = None, buckets: int | None = None) -> Version:
    """The next version after deletions, then insertions (rows of ``digests``
    with ``row_col``).  A row that is live isn't inserted again, and one that
    isn't can't be deleted.  Groups that lose a row are counted again from the
    live rows, with partial aggregation; all others only take their new rows."""
    rows = inserts.select("id", "row", "digest").dropDuplicates(["row"])
    if version is None:
        members = rows.limit(0)
        index, buckets = None, buckets or buckets_for(rows.count())
    else:
        members, index, buckets = version
    gone = members.limit(0) if deletes is None else members.join(deletes.select("row").distinct(), "row", "left_semi").select("id", "row", "digest")
    gone = stored(gone, "dedup-gone")
    stay = members.join(gone.select("row"), "row", "left_anti").select("id", "row", "digest")
    new = stored(rows.join(stay.select("row"), "row", "left_anti").select("id", "row", "digest"), "dedup-new")
    members = stored(stay.unionByName(new), "dedup-members")
    lost = gone.select("digest").distinct()
    counted = members.join(lost, "digest", "left_semi").select("id", "row", "digest")
    put = changes(counted.unionByName(new.join(lost, "digest", "left_anti").select("id", "row", "digest")), buckets)
    drop = changes(gone, buckets).withColumn("rows", F.lit(_ALL_ROWS)).select(*put.columns)
    index = updated(index, put, drop)
    return Version(members, index, buckets)


def live_groups(index: DataFrame) -> DataFrame:
    """One row per live digest: digest, keep_id, keep_row, group_size."""
    kind = index.schema["keep_ids"].dataType.elementType.simpleString()

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("digests")[i].as_py()
                keep = batch.column("keep_ids")[i].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[j:j + 32] for j in range(0, len(raw), 32)], pa.binary()), keep,
                     batch.column("keep_rows")[i].values, batch.column("rows")[i].values],
                    ["digest", "keep_id", "keep_row", "group_size"])

    return index.mapInArrow(released(task), f"digest binary, keep_id {kind}, keep_row long, group_size long")


def judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digests`` with the group of each: keep_id, keep_row, group_size."""
    rows = digests(df, id_col, text_col)
    index = updated(None, changes(rows, buckets_for(rows.count())))
    return rows.join(live_groups(index), "digest", "left")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    return (judged(df, id_col, text_col)
            .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df``, with its columns, for each group of equal texts."""
    kept = judged(df, id_col, text_col).where("row = keep_row").select(F.col("id").alias("keep_id"), F.col("t").alias("keep_t"))
    t, number = free_name(df, "t"), free_name(df, "number")
    joined = (df.withColumn(t, F.xxhash64(F.coalesce(named(text_col), F.lit("")))).alias("d")
              .join(kept.alias("k"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.keep_id"))
                    & (F.col(f"d.`{t}`") == F.col("k.keep_t"))).select("d.*"))
    repeated = Window.partitionBy(named(id_col), named(t)).orderBy(F.to_json(F.struct(*(named(c) for c in df.columns
                                                                                     if c != text_col))))
    return (joined.withColumn(number, F.row_number().over(repeated)).where(named(number) == 1)
            .select(*(named(c) for c in df.columns)))
