"""Operator 12: periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q (words q apart are
identical) of at least ``max(LEAST, TIMES * q)`` words.  Runs are found at the
dyadic scales t = 1, 2, 4, ...; scale t finds the periods from t to 2 t - 1:

* windows of t words inside a run with a period of at most t / ``TIMES`` are
  highly periodic; they are known, as the runs of the smaller scales, and set
  aside.  Their own (small) periods were proposed there;
* the synchronising set holds the positions i for which the least hash of the
  other windows that start in [i, i + t] is that of the first or the last of
  them.  Whether i is chosen depends on its context, the next 2 t words, alone,
  and every stretch of t positions has one unless it is highly periodic;
* so a run with period q in [t, 2 t) has a chosen i, with i + q chosen by an
  equal context, and no equal context between (it would give a smaller period).
  Neighbouring occurrences of each context propose their distance;
* a proposal is extended to both sides by hashes of 2**k words, then all words
  of the run are compared.  Of proposals with the same span the smallest
  period stays.

Documents are independent.  Each task takes up to ``BATCH`` bytes of whole
texts at a time (one text at least), end to end with a separator that equals
nothing else, so a text costs its own length times a logarithm and no shuffle
is needed.  A text of n words takes about 8 n log2(n) bytes while it is read.
Words are told apart exactly; window hashes have 64 bits, and a run is kept only
after a comparison of its words.

Defined results: null and empty texts have no words, no runs and an empty kept
text.  Repeated rows, ids and other columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import wordhash
from verdigris.llm.common import bytes_of, named, released, small_batches

LEAST, TIMES, BATCH = 6, 4, 2 << 20
_BASE, _MOST = np.uint64(0x9FB21C651E98DF25), np.uint64(2**64 - 1)
_RUN = "start: bigint, length: bigint, period: bigint"


def _levels(ids: np.ndarray, longest: int, seed: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... words, up to ``longest``."""
    out = [wordhash.mix(ids.astype(np.uint64), seed)]
    while 2 << (len(out) - 1) <= longest:
        h, half = out[-1], 1 << (len(out) - 1)
        out.append(wordhash.mix(h[:len(h) - half] * _BASE + h[half:], seed))
    return out


def _equal_ahead(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where y stands after all words that are equal from x and y (> x) on."""
    x, y = x.copy(), y.copy()
    for k in range(len(levels) - 1, -1, -1):
        h, last = levels[k], len(levels[k]) - 1
        step = ((y <= last) & (h[np.minimum(x, last)] == h[np.minimum(y, last)])) << k
        x, y = x + step, y + step
    return y


def _equal_behind(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where x (< y) stands before all words that are equal before x and y."""
    x, y = x.copy(), y.copy()
    for k in range(len(levels) - 1, -1, -1):
        h, size = levels[k], 1 << k
        a, b = np.maximum(x - size, 0), np.maximum(y - size, 0)
        step = ((x >= size) & (h[np.minimum(a, len(h) - 1)] == h[np.minimum(b, len(h) - 1)])) << k
        x, y = x - step, y - step
    return x


def synchronising(hashes: np.ndarray, size: int, periodic: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set for windows of ``size`` words with
    these hashes, of which ``periodic`` are set aside."""
    ident = np.where(periodic, _MOST, hashes)
    least = wordhash.sliding_min(ident, size + 1)
    n = len(least)
    return np.flatnonzero(((least == ident[:n]) | (least == ident[size:size + n])) & (least != _MOST))


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of n places, those in any [start, end)."""
    change = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(ends, minlength=n + 1)[:n + 1]
    return np.cumsum(change)[:n] > 0


def _unique_spans(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """One run for each span, that with the smallest period, in order."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES, seed: int = 0):
    """Starts, ends and periods of all runs of ``ids``, by start and end;
    ``longest`` bounds the length of a stretch without separator."""
    none = np.zeros(0, dtype=np.int64)
    start, end, period = none, none, none
    if longest < times:
        return start, end, period
    levels = _levels(ids, longest, seed)
    k = 0
    while times << k <= longest:
        size, windows = 1 << k, len(levels[k])
        known = (period * times <= size) & (end - start >= size)
        chosen = synchronising(levels[k], size, _inside(start[known], end[known] - size + 1, windows))
        context = levels[k + 1][chosen]
        order = np.argsort(context, kind="stable")
        place, context = chosen[order], context[order]
        apart = place[1:] - place[:-1]
        pair = np.flatnonzero((context[1:] == context[:-1]) & (apart >= size) & (apart < 2 * size))
        at, apart = place[pair], apart[pair]
        more = _unique_spans(_equal_behind(levels, at, at + apart), _equal_ahead(levels, at, at + apart), apart)
        long = more[1] - more[0] >= times * more[2]
        start, end, period = _unique_spans(*(np.concatenate([a, b[long]]) for a, b in zip((start, end, period), more, strict=True)))
        k += 1
    if not all(np.array_equal(ids[a:b - p], ids[a + p:b]) for a, b, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True)):
        return find_runs(ids, longest, least, times, seed + 1)  # two windows had one hash: again with others
    keep = end - start >= least
    return start[keep], end[keep], period[keep]


def _word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for identical words only."""
    inside = _inside(starts, ends, len(buf))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[inside]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _collapsed(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one blank."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))[kept]
    a, b = starts[kept], ends[kept]
    followed = np.zeros(len(a), dtype=bool)
    followed[:-1] = row[1:] == row[:-1]
    out = buf.copy()
    out[b[followed]] = 0x20  # white space stands behind a word that another follows
    inside = _inside(a, b + followed, len(buf))
    places = np.concatenate([[0], np.cumsum(inside)])[offs].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(places), pa.py_buffer(out[inside])])


def mark(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST, times: int = TIMES,
         result: str = "periodic") -> DataFrame:
    """The ``keep`` columns of each row (default: all) and a struct ``result``:
    n_words, runs (start, length, period; by start, then period) and kept_text,
    the words that no run contains after its first period, joined by blanks."""
    keep = df.columns if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]
    rows = df.select(F.struct(*(named(c).alias(n) for c, n in zip(keep, names, strict=True)),
                              F.lit(None).cast("int").alias("none")).alias("kept"), named(text_col).alias("text"))

    def task(batches):
        for batch in small_batches(batches, 1, BATCH):
            buf, offs = bytes_of(batch.column(1))
            starts, ends = wordhash.spans(buf, offs, wordhash.WHITE_SEPARATED)
            first = np.searchsorted(starts, offs)
            n_words, n_rows = np.diff(first), batch.num_rows
            at = np.arange(len(starts)) + np.repeat(np.arange(n_rows), n_words)  # one separator after each row
            ids = -1 - np.arange(len(starts) + n_rows, dtype=np.int64)
            ids[at] = _word_ids(buf, starts, ends)
            start, end, period = find_runs(ids, int(n_words.max(initial=0)), least, times)
            row = np.searchsorted(first + np.arange(n_rows + 1), start, side="right") - 1
            order = np.lexsort((period, start))
            start, end, period, row = start[order], end[order], period[order], row[order]
            dropped = _inside(start + period, end, len(ids))[at]
            runs = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (start - (first + np.arange(n_rows + 1))[row], end - start, period)],
                ["start", "length", "period"])
            bounds = pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(bounds, runs),
                 _collapsed(buf, offs, starts, ends, first, ~dropped).cast(pa.string())],
                ["kept", "n_words", "runs", "kept_text"])

    kind = rows.schema["kept"].dataType.simpleString()
    return (rows.mapInArrow(released(task), f"kept {kind}, n_words long, runs array<struct<{_RUN}>>, kept_text string")
            .select(*(F.col(f"kept.{n}").alias(c) for c, n in zip(keep, names, strict=True)),
                    F.struct("n_words", "runs", "kept_text").alias(result)))


def best_run(runs):
    """Of an array of runs in order, the first with the greatest length/period."""
    return F.aggregate(runs, F.lit(None).cast(f"struct<{_RUN}>"), lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))


def with_planted_periods(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's input: with h = crc32 of the id as text, g = h div 10,
    the words of every tenth document (h mod 10 = 0) from a = g mod n on repeat
    with period 1 + (n - a) div (3 + g mod 8); other texts stay."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size("_words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    some = F.coalesce(F.size("_words") > 0, F.lit(False))
    return (df.withColumn("_words", words).withColumn("_a", F.when(some, a)).withColumn("_p", F.when(some, p))
            .withColumn(text_col, F.when(some, F.array_join(planted, " ")).otherwise(F.col(text_col)))
            .drop("_words", "_a", "_p"))
