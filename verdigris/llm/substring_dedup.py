"""Operator 6: removal of repeated passages by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text.  Each word that is covered
by a window whose word sequence also starts earlier (smaller id, or same text,
earlier start) is removed; windows are judged on the input.

Anchors of ``WINDOW - PERIOD + 1`` words start only at positions whose remainder
modulo ``PERIOD`` is in ``COVER``, a difference cover: for any two positions
there is a shift below ``PERIOD`` that takes both into the cover, so two equal
windows share an aligned anchor inside.  Passes over the corpus:

1. Anchors are hashed and dealt by hash; those that start more than once go
   back to their documents.
2. Shared anchors are extended: only windows around one are hashed in full
   (32 bits choose the bucket, 80 more are compared there) and dealt by that hash, and in each group of equal windows all but
   the earliest are repeats.
3. Repeats go back to their documents, and the covered words are left out.

Hashes travel as packed arrays, one row for each batch and bucket.  A batch
sends one entry for each distinct hash and settles its own repeats, so what a
third of all documents share does not pile up in one bucket; buckets are sized
from the corpus's bytes, so one fits in a task.

Defined results: null and empty texts have no words.  Rows with one id and
equal texts are one document, and each gets that result; rows with one id and
different texts are ordered by a hash of the text.  Null ids come last;
ids keep their type, any that Spark orders, and "earlier" is by its order: the
places of ids that are not integers are numbered first.  Texts with fewer words than a window keep all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from verdigris.functions.ranking import numbered
from verdigris.llm import wordhash
from verdigris.llm.common import bytes_of, named, partitions_for, released, row_slices, small_batches, stored

WINDOW = 20
#: A perfect difference set: each remainder modulo 13 is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Text whose hashes one bucket holds, on average.
BUCKET_BYTES = 32 << 20
#: Text that a task compares with itself before it deals out the rest.
BATCH_BYTES = 16 << 20

#: Places of several documents, packed: their ids, text hashes and null marks, and of each place the document and word.
#: kind 0: places to report, by their documents' bucket; kind 1: places to compare, by their hashes' bucket.
_DEALT = ("bucket int, kind int, ids binary, ts binary, nulls binary, row binary, pos binary, high binary, low binary")
_NAMES = [f.split()[0] for f in _DEALT.split(", ")]
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 7]


class Places:
    """Hashed places (document, word) of a set of documents.  A document is its
    id (null last) and a hash of its text."""

    def __init__(self, ids, nulls, ts, row, pos, high, low):
        order = np.lexsort((ts, ids, nulls))
        same = np.zeros(len(ids), dtype=bool)
        a, b = order[1:], order[:-1]
        same[1:] = (ids[a] == ids[b]) & (nulls[a] == nulls[b]) & (ts[a] == ts[b])
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.cumsum(~same)
        self.ids, self.nulls, self.ts, self.rank = ids, nulls, ts, rank
        self.row, self.pos, self.high, self.low = row, pos, high, low

    def compared(self, first_too: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places to report, and the earliest place of each hash.  Reported
        are all but the earliest, or with ``first_too`` all of a hash that has
        more than one place."""
        rank = self.rank[self.row]
        order = np.lexsort((self.pos, rank, self.low, self.high))
        if not len(order):
            return order, order
        high, low, rank, pos = self.high[order], self.low[order], rank[order], self.pos[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        other = (rank != rank[start[group]]) | (pos != pos[start[group]])
        report = other if not first_too else np.logical_or.reduceat(other, start)[group]
        return order[report], order[start]

    def rows(self, places: np.ndarray, bucket: np.ndarray, buckets: int, kind: int) -> list[tuple]:
        """Rows of ``_DEALT`` for some places with the bucket of each."""
        order = np.lexsort((self.pos[places], self.row[places], bucket))
        places = places[order]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(bounds[1:] > bounds[:-1]):
            part = places[bounds[b]:bounds[b + 1]]
            docs, which = np.unique(self.row[part], return_inverse=True)
            out.append((int(b), kind, self.ids[docs].tobytes(), self.ts[docs].tobytes(), self.nulls[docs].tobytes(),
                        _packed(which), _packed(self.pos[part]), *((self.high[part].tobytes(), self.low[part].tobytes())
                                                                   if kind else (None, None))))
        return out

    def reported(self, places: np.ndarray, buckets: int) -> list[tuple]:
        """The same for places to report, by a bucket of their documents."""
        row = self.row[places]
        return self.rows(places, (self.ids[row] ^ self.ts[row]) % buckets, buckets, 0)

    def by_document(self):
        """(ids, ts, positions): one row for each document, repeated rows of one document joined."""
        rank = self.rank[self.row]
        order = np.lexsort((self.pos, rank))
        rank, pos = rank[order], self.pos[order]
        one = np.ones(len(order), dtype=bool)
        one[1:] = (rank[1:] != rank[:-1]) | (pos[1:] != pos[:-1])
        rank, pos, docs = rank[one], pos[one].astype("<u4"), self.row[order][one]
        start = np.flatnonzero(np.diff(rank, prepend=-1))
        offsets = (4 * np.append(start, len(rank))).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(pos.tobytes())])
        docs = docs[start]
        return pa.array(self.ids[docs], mask=self.nulls[docs]), pa.array(self.ts[docs]), blobs


def _unpacked_places(held: list[dict]) -> Places:
    """The places of several rows of ``_DEALT`` of one kind."""
    sizes = np.cumsum([0] + [len(r["ids"]) // 8 for r in held])
    columns = [np.concatenate([np.frombuffer(r[c], t) for r in held])
               for c, t in (("ids", np.int64), ("nulls", bool), ("ts", np.int64))]
    row = np.concatenate([_unpacked(r["row"]) + s for r, s in zip(held, sizes, strict=False)])
    pos = np.concatenate([_unpacked(r["pos"]) for r in held])
    if not held[0]["kind"]:
        return Places(*columns, row, pos, None, None)
    n = len(_unpacked(held[0]["row"]))
    hashes = [np.concatenate([np.frombuffer(r[c], f"<u{len(held[0][c]) // n}") for r in held]) for c in ("high", "low")]
    return Places(*columns, row, pos, *hashes)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _by_bucket(batches):
    """Lists of rows of one bucket, from rows sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["bucket"], r["kind"]) != (held[0]["bucket"], held[0]["kind"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _packed(x: np.ndarray) -> bytes:
    """The array as unsigned integers of two or four bytes, after that size."""
    size = 2 if not len(x) or int(x.max()) < 1 << 16 else 4
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def compare(docs: DataFrame, find, buckets: int, first_too: bool) -> DataFrame:
    """Places whose hash another place has (``Places.compared``), one row (id,
    t, marks: their positions) for each document that has some.  ``docs`` has
    id, t, text and marks; ``find(words, marks of the rows)`` gives arrays of
    row, position, bucket hash and the two parts of the hash that is compared."""

    def deal(batches):
        hasher = wordhash.Hasher()
        for batch in small_batches(batches, 2, BATCH_BYTES):
            buf, offs = bytes_of(batch.column(2))
            marks, parts = batch.column(3), []
            for i, j in row_slices(offs, wordhash.TEXT_SLICE):
                w = hasher.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                row, *rest = find(w, marks.slice(i, j - i))
                parts.append((row + i, *rest))
            if not parts:
                continue
            row, pos, deal_by, high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
            places = Places(batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False),
                            batch.column(1).to_numpy(), row, pos, high, low)
            report, heads = places.compared(first_too)
            out = places.reported(report, buckets)
            out += places.rows(heads, (deal_by[heads] % np.uint64(buckets)).astype(np.int64), buckets, 1)
            if out:
                yield _batch_of(out)

    def settle(batches):
        for held in _by_bucket(batches):
            if held[0]["kind"] == 0:
                rows = [tuple(r[c] for c in _NAMES) for r in held]
            else:
                places = _unpacked_places(held)
                rows = places.reported(places.compared(first_too)[0], buckets)
            if rows:
                yield _batch_of(rows)

    def gather(batches):
        for held in _by_bucket(batches):
            yield pa.RecordBatch.from_arrays([*_unpacked_places(held).by_document()], ["id", "t", "marks"])

    dealt = docs.select("id", "t", "text", "marks").mapInArrow(released(deal), _DEALT)
    settled = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(released(settle), _DEALT)
    return (settled.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(released(gather), "id long, t long, marks binary"))


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    length = window - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def find(w: wordhash.Words, marks):
        rows = w.rows()
        pos = np.arange(len(rows)) - w.first[rows]
        at = np.flatnonzero(in_cover[pos % period] & (pos + length <= w.counts[rows]) & (w.counts[rows] >= window))
        h = wordhash.gram_at(w.hash, at, length)
        return (rows[at], pos[at], h >> np.uint64(40), (h & np.uint64(0xFFFFFFFF)).astype("<u4"),
                ((h >> np.uint64(32)) & np.uint64(0xFF)).astype("<u1"))

    return find


def _windows(window: int, period: int):
    def find(w: wordhash.Words, marks):
        change = np.zeros(len(w.hash) + 1, dtype=np.int32)
        for r, blob in enumerate(marks.to_pylist()):
            at = np.frombuffer(blob or b"", "<u4").astype(np.int64) + w.first[r]
            np.add.at(change, np.maximum(at - (period - 1), w.first[r]), 1)
            np.add.at(change, at + 1, -1)
        near = np.cumsum(change[:-1]) > 0
        rows = w.rows()
        at = np.flatnonzero(near & (np.arange(len(rows)) + window <= w.row_ends()))
        high, low = wordhash.gram_at(w.hash, at, window), wordhash.gram_at(w.hash, at, window, 1)
        return rows[at], at - w.first[rows[at]], low >> np.uint64(32), high, (low & np.uint64(0xFFFF)).astype("<u2")

    return find


def _to_documents(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    d, m = docs.alias("d"), places.alias("m")
    return (d.join(m, F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.t") == F.col("m.t")), how)
            .select("d.id", "d.t", "d.text", "m.marks"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD,
          cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per row of ``df``: id, n_words, removed (spans of words, end
    exclusive), kept_text (the other words, joined by one blank)."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or window < period:
        raise ValueError("not a difference cover of a period within the window")
    text = F.coalesce(named(text_col), F.lit(""))
    ids = df.select(named(id_col).alias("key"), text.alias("text"))
    order = None
    if not isinstance(ids.schema["key"].dataType, IntegralType):
        order = stored(numbered(ids.select("key").where("key is not null").distinct(), [F.col("key")], "id"), "id-order")
        ids = ids.join(order, "key", "left")
    docs = ids.select((F.col("id") if order is not None else F.col("key").cast("long")).alias("id"),
                      F.xxhash64("text").alias("t"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions_for(df, size, BUCKET_BYTES)
    unmarked = docs.withColumn("marks", F.lit(None).cast("binary"))
    shared = compare(unmarked, _anchors(window, period, cover), buckets, True)
    repeats = compare(_to_documents(docs, shared, "inner"), _windows(window, period), buckets, False)

    def task(batches):
        for batch in small_batches(batches, 2):
            counts, removed, kept = [], [], []
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for text, blob in zip(texts, batch.column(3).to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                if not blob:
                    removed.append([])
                    kept.append(b" ".join(words))
                    continue
                change = np.zeros(len(words) + 1, dtype=np.int32)
                at = np.frombuffer(blob, "<u4")
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                edges = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False, append=False)).tolist()
                removed.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                rest = zip([0, *edges[1::2]], [*edges[::2], len(words)], strict=True)
                kept.append(b" ".join([x for a, b in rest for x in words[a:b]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "removed", "kept_text"])

    out = (_to_documents(docs, repeats, "left")
           .mapInArrow(released(task), "id long, n_words long, removed array<struct<start:int,end:int>>, kept_text string"))
    if order is not None:
        out = out.join(order, "id", "left").select(F.col("key").alias("id"), "n_words", "removed", "kept_text")
    return out.withColumnRenamed("id", id_col)
