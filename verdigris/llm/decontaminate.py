"""Operator 9: benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond
ASCII.  A benchmark window is ``WINDOW`` consecutive words of an item; an item
with fewer words is one window.  The fingerprint of a window is the least of
its k-gram hashes (k words, ``WINDOW - k + 1`` neighbours), so a document that
shares a window, or any longer span, has that fingerprint at the same place: no
shared span is missed.  Fingerprints of documents that join a benchmark
fingerprint are extended: each window around the hit is confirmed by a 128-bit
hash of all its words.  Items shorter than a window are winnowed with k equal
to their length, which keeps each of a document's k-grams.

The benchmark is a stated query set: its windows are dealt by hash into blocks
of about ``BLOCK_WINDOWS``, and of ``BLOCK_BYTES`` at most with their items'
ids (long ids make smaller blocks); each block is broadcast as plain arrays,
and the documents pass by it within their own partitions, without a shuffle.  What a
block holds doesn't grow with the documents.  With more blocks than one, each
makes one pass that leaves hits by the digest of their text, one row for each
digest and block, and these are joined to the documents.

Defined results: null texts have no words and no hits; items without words
have no window; repeated items and repeated documents each count by
themselves; null item ids are left out of the list of items.  Columns of the
documents that the caller keeps pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import wordhash
from verdigris.llm.common import bytes_of, free_name, named, released, small_batches, stored

WINDOW, GRAM = 13, 5
BLOCK_WINDOWS = 400_000
#: Bytes of a block at most, and those of a window and an id besides the id's own.
BLOCK_BYTES, WINDOW_BYTES = 48 << 20, 96
#: Words of a document are contaminated from one part in so many.
SHARE = 20

_STATE = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Stored distinct rows of length, fingerprint, 128-bit hash and item."""

    def task(batches):
        hasher = wordhash.Hasher()
        for batch in batches:
            buf, offs = bytes_of(batch.column(1))
            w = hasher.words(buf, offs, wordhash.ALPHANUMERIC, True)
            size = np.minimum(w.counts, window)
            starts = [np.arange(a, a + max(1, n - window + 1)) if n else np.zeros(0, int)
                      for a, n in zip(w.first[:-1], w.counts, strict=True)]
            row = np.repeat(np.arange(len(size)), [len(s) for s in starts])
            at = np.concatenate([*starts, np.zeros(0, int)]).astype(int)
            size = size[row]
            mark, hi, lo = (np.zeros(len(at), dtype=np.uint64) for _ in range(3))
            for n in np.unique(size):
                some = size == n
                k = min(gram, int(n)) if n == window else int(n)
                least = wordhash.gram_at(w.hash, at[some], k, 2)
                for t in range(1, int(n) - k + 1):
                    least = np.minimum(least, wordhash.gram_at(w.hash, at[some] + t, k, 2))
                mark[some] = least
                hi[some], lo[some] = (wordhash.gram_at(w.hash, at[some], int(n), s) for s in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(size.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (mark, hi, lo)),
                 batch.column(0).take(pa.array(row))], ["length", "mark", "hi", "lo", "item"])

    narrow = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return stored(narrow.mapInArrow(released(task), "length int, mark long, hi long, lo long, item string").distinct(), "benchmark")


def prepared(found: pa.Table) -> tuple[dict, list]:
    """A block's windows as plain arrays, which need no package to be read:
    for each length the sorted fingerprints, the two halves of the sorted
    distinct windows' hashes and the number of the set of items that each has;
    and the sets."""
    length, known, by_length = found["length"].to_numpy(), {}, {}
    for n in np.unique(length):
        some = found.filter(pa.array(length == n))
        mark, hi, lo = (some[c].to_numpy().view(np.uint64) for c in ("mark", "hi", "lo"))
        order = np.lexsort((lo, hi))
        hi, lo, items = hi[order], lo[order], some["item"].take(pa.array(order)).to_pylist()
        new = np.ones(len(hi), dtype=bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        at = np.append(np.flatnonzero(new), len(hi))
        sets = [known.setdefault(frozenset(i for i in items[a:b] if i is not None), len(known))
                for a, b in zip(at, at[1:], strict=False)]
        by_length[int(n)] = (np.unique(mark), hi[new], lo[new], np.array(sets))
    return by_length, list(known)


def dealt_blocks(windows: DataFrame, block_windows: int, block_bytes: int) -> int:
    """Blocks such that none exceeds the bytes, by a bound that counts each
    window with its item's id."""
    size = F.sum(F.octet_length(F.coalesce("item", F.lit(""))) + WINDOW_BYTES)
    n, total = windows.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    blocks = max(1, -(-n // block_windows), -(-total // block_bytes))
    while blocks < n:
        largest = windows.groupBy(_block_of(blocks).alias("b")).agg(size.alias("s")).agg(F.max("s")).first()[0]
        if largest <= block_bytes:
            break
        blocks *= 2
    return blocks


def _block_of(blocks: int):
    return F.pmod(F.xxhash64("hi", "lo", "item"), F.lit(blocks))


class Block:
    """A block in a task."""

    def __init__(self, by_length: dict, sets: list, window: int, gram: int):
        self.by_length, self.sets, self.window, self.gram = by_length, sets, window, gram

    def hits(self, w: wordhash.Words):
        """For each length: the starts (counted over all rows) of the windows
        that occur, and the number of each one's set of items."""
        row_ends = w.row_ends()
        for n, (marks, his, los, sets) in self.by_length.items():
            if len(w.hash) < n:
                continue
            k = min(self.gram, n) if n == self.window else n
            least = wordhash.sliding_min(wordhash.grams(w.hash, k, 2), n - k + 1)
            change = np.ones(len(least), dtype=bool)
            change[1:] = least[1:] != least[:-1]
            first = np.flatnonzero(change)  # one fingerprint for each run of windows with the same least hash
            near = np.minimum(np.searchsorted(marks, least[first]), len(marks) - 1)
            joined = np.flatnonzero(marks[near] == least[first])
            if not len(joined):
                continue
            sizes = np.append(first[1:], len(least))[joined] - first[joined]
            at = np.repeat(first[joined] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            at = at[at + n <= row_ends[at]]  # extension: the windows around a hit, each by all its words
            hi, lo = (wordhash.gram_at(w.hash, at, n, s) for s in (0, 1))
            place, last = np.searchsorted(his, hi), len(his) - 1
            while np.any(again := (place < last) & (his[np.minimum(place, last)] == hi) & (los[np.minimum(place, last)] != lo)):
                place = place + again
            place = np.minimum(place, last)
            sure = (his[place] == hi) & (los[place] == lo)
            yield n, at[sure], sets[place[sure]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark(df: DataFrame, items: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
         block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES, share: int = SHARE, result: str = "found") -> DataFrame:
    """The ``keep`` columns of each row (default: all) and, in a struct
    ``result``: n_words, hits (word spans), items (sorted as strings), n_hit,
    contaminated."""
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    windows = benchmark_windows(items, item_col, item_text_col, window, gram)
    blocks = dealt_blocks(windows, block_windows, block_bytes)
    names = [f"_{i}" for i in range(len(keep))]  # plain names within: the columns' own may clash
    rows = df.select(F.struct(*(named(c).alias(n) for c, n in zip(keep, names, strict=True)),
                              F.lit(None).cast("int").alias("none")).alias("kept"), named(text_col).alias("text"))

    def passed(rows: DataFrame, b: int, keep_text: bool = False) -> DataFrame:
        block = prepared(windows.where(_block_of(blocks) == b).toArrow())
        return _passed(rows, spark.sparkContext.broadcast(block), window, gram, keep_text)

    if blocks == 1:
        out = passed(rows, 0)
    else:  # each block's hits by the text's digest, then all blocks' hits to the rows
        digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        hit = [passed(rows.select(F.struct(digest.alias("key")).alias("kept"), "text"), b).where("size(hits) > 0")
               .select("kept.key", F.lit(b).alias("block"), F.struct("hits", "items").alias("h")) for b in range(1, blocks)]
        # copies of a text have equal hits: each task keeps one row for a digest and block before they meet
        once = _all(hit).groupBy("key", "block").agg(F.first("h").alias("h"))
        more = stored(once.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("h.hits"))).alias("more_hits"),
                                              F.array_distinct(F.flatten(F.collect_list("h.items"))).alias("more_items")),
                      "more-hits")
        out = _merged_rows(passed(rows, 0, keep_text=True).withColumn("key", digest).join(more, "key", "left"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (out.withColumn("n_hit", n_hit)
            .select(*(F.col(f"kept.{n}").alias(c) for c, n in zip(keep, names, strict=True)),
                    F.struct("n_words", "hits", "items", "n_hit",
                             ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
                    .alias(result)))


def clean(df: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with its columns, that aren't contaminated."""
    result = free_name(df, "found")
    marked = mark(df, items, text_col, result=result, **options)
    return marked.where(~F.col(f"{result}.contaminated")).select(*(named(c) for c in df.columns))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _merged_rows(joined: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            hits = [_merged([(s["start"], s["end"]) for x in pair if x for s in x])
                    for pair in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            items = [sorted({i for x in pair if x for i in x})
                     for pair in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _spans(hits), pa.array(items, pa.list_(pa.string()))],
                                             ["kept", "n_words", "hits", "items"])

    kind = joined.schema["kept"].dataType.simpleString()
    return (joined.select("kept", "n_words", "hits", "items", "more_hits", "more_items")
            .mapInArrow(released(task), f"kept {kind}, {_STATE}"))


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in rows], _HITS)


def _passed(rows: DataFrame, block, window: int, gram: int, keep_text: bool = False) -> DataFrame:
    """``rows`` (kept, text) past one block: kept, n_words, hits, items."""

    def task(batches):
        hasher, windows = wordhash.Hasher(), Block(*block.value, window, gram)
        for batch in small_batches(batches, 1):
            buf, offs = bytes_of(batch.column(1))
            w = hasher.words(buf, offs, wordhash.ALPHANUMERIC, True)
            hits, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for n, at, sets in windows.hits(w):
                rows = np.searchsorted(w.first, at, side="right") - 1
                for row, a in zip(rows.tolist(), (at - w.first[rows]).tolist(), strict=True):
                    hits[row].append((a, a + n))
                for row, number in {*zip(rows.tolist(), sets.tolist(), strict=True)}:
                    items[row] |= windows.sets[number]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(w.counts.astype(np.int64)), _spans([_merged(x) for x in hits]),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string())), *([batch.column(1)] if keep_text else [])],
                ["kept", "n_words", "hits", "items", *(["text"] if keep_text else [])])

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(released(task), f"kept {kind}, {_STATE}" + (", text string" if keep_text else ""))
