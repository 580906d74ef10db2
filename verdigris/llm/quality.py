"""Operator 8: quality classifier, hashed word n-grams and logistic regression
trained with follow-the-regularised-leader (FTRL-proximal) updates.

Features of a text are three views of its white-space separated words, each
as uni- and bigrams hashed into ``2**BITS`` weights: the words (A-Z
lower-cased), their shapes (runs of capitals, small letters, digits; each other
character as it is) and repeats (whether a word equals the one or two before).
A feature's value is its share of its view's n-grams, so long and short texts
are on one scale, and a score is a sparse dot product through the logistic
function.  Whole texts are read; ids, languages, sources and labels are never
inputs of a score.

Training reads at most ``MAX_ROWS`` labelled ids, those with the smallest hash,
and ``MAX_BYTES`` of their texts (documented bounds: all where there are fewer),
one text for each id; their features are computed on the executors, then one task, whose input the
bound limits, runs the sequential updates.  The weights (``2**BITS`` floats) are
broadcast, and scoring is one pass without a shuffle.

Defined results: null and empty texts have no features and score by the bias
alone; a document with several labels counts as 1 if their mean is 0.5 or
more; null labels are left out; without labels every score is 0.5.  Repeated
rows and null ids are kept, one output row for each input row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import wordhash
from verdigris.llm.common import bounded_broadcast, bytes_of, free_name, named, released, row_slices, small_batches
from verdigris.llm.labelled import labelled_texts

BITS, MAX_ROWS, MAX_BYTES, EPOCHS = 18, 12_000, 64 << 20, 5
#: FTRL-proximal: learning rate, its offset, and the L1 and L2 weights.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
#: Shares of a view are scaled so that a frequent n-gram's value is about one.
SCALE = 10.0

_CLASS = np.array([65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b
                   for b in range(256)], dtype=np.uint8)


def _shapes(hasher: wordhash.Hasher, buf: np.ndarray, w: wordhash.Words) -> np.ndarray:
    """Hashes of the words with each run of one character class as one character."""
    kinds = _CLASS[buf]
    keep = wordhash.WHITE_SEPARATED[buf]
    change = np.ones(len(kinds), dtype=bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[w.starts] = True
    keep &= change
    place = np.cumsum(keep)
    return hasher.hash_spans(kinds[keep], place[w.starts] - 1, place[w.ends - 1], False)


def features(hasher: wordhash.Hasher, buf: np.ndarray, offs: np.ndarray, bits: int):
    """For rows of text: word counts per row and, for each view, the weight
    numbers of its n-grams with the row of each."""
    w = hasher.words(buf, offs, wordhash.WHITE_SEPARATED, True)
    rows, h = w.rows(), w.hash
    shape = _shapes(hasher, buf, w) if len(h) else h
    same = np.zeros(len(h), dtype=np.uint64)
    for back in (1, 2):
        if len(h) > back:
            same[back:] += np.uint64(back) * ((h[back:] == h[:-back]) & (rows[back:] == rows[:-back])).astype(np.uint64)
    shift = np.uint64(64 - bits)
    for seed, view in enumerate((h, shape, wordhash.mix(same, 90))):
        two = wordhash.grams(view, 2, 20 + seed)
        within = rows[1:] == rows[:-1] if len(rows) > 1 else np.zeros(0, dtype=bool)
        yield (np.concatenate([wordhash.mix(view, 10 + seed), two[within]]) >> shift).astype(np.int64), \
            np.concatenate([rows, rows[1:][within] if len(rows) > 1 else rows[:0]])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS,
          alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Weights; the last one is the bias."""
    rows = (labelled_texts(docs, labels, id_col, text_col, label_col, max_rows, max_bytes, "quality-sample")
            .select(F.xxhash64("id", "text").alias("place"), "y", "text"))

    def featurise(batches):
        hasher = wordhash.Hasher()
        for batch in batches:
            buf, offs = bytes_of(batch.column(2))
            found = [[] for _ in range(batch.num_rows)]
            for i, j in row_slices(offs, wordhash.TEXT_SLICE):
                for number, row in features(hasher, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], bits):
                    order = np.argsort(row, kind="stable")
                    bounds = np.searchsorted(row[order], np.arange(j - i + 1))
                    number = number[order]
                    for r in range(j - i):
                        part = number[bounds[r]:bounds[r + 1]]
                        which, n = np.unique(part, return_counts=True)
                        found[i + r].append((which, SCALE * n / max(1, len(part))))
            which = [np.concatenate([x[0] for x in f]).astype("<i4") for f in found]
            value = [np.concatenate([x[1] for x in f]).astype("<f4") for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in which], pa.binary()),
                 pa.array([x.tobytes() for x in value], pa.binary())], ["place", "y", "which", "value"])

    def learn(batches):
        ys, which, value = [], [], []
        for batch in batches:
            ys += batch.column(1).to_pylist()
            which += [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            value += [np.frombuffer(x, "<f4").astype(np.float64) for x in batch.column(3).to_pylist()]
        z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

        def weights(i):
            active = np.abs(z[i]) > l1
            return np.where(active, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

        for _ in range(epochs):
            for y, i, x in zip(ys, which, value, strict=True):
                i, x = np.append(i, 2**bits), np.append(x, 1.0)
                w = weights(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                np.add.at(z, i, g - sigma * w)
                np.add.at(n, i, g * g)
        w = weights(np.arange(2**bits + 1)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    learned = (rows.mapInArrow(released(featurise), "place long, y int, which binary, value binary")
               .repartition(1).sortWithinPartitions("place", "y", "which").mapInArrow(released(learn), "w binary").collect())
    return np.frombuffer(learned[0]["w"], "<f4") if learned else np.zeros(2**bits + 1, "<f4")


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None,
          threshold: float = 0.5, result: str = "judged") -> DataFrame:
    """The ``keep`` columns of each row (default: all) and a struct ``result``
    of score and predicted."""
    spark, bits = df.sparkSession, int(len(weights) - 1).bit_length() - 1
    shared = bounded_broadcast(spark, np.asarray(weights, dtype=np.float64), 8 * len(weights))
    keep = df.columns if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]
    rows = df.select(F.struct(*(named(c).alias(n) for c, n in zip(keep, names, strict=True)),
                              F.lit(None).cast("int").alias("none")).alias("kept"), named(text_col).alias("text"))

    def task(batches):
        hasher, w = wordhash.Hasher(), shared.value
        for batch in small_batches(batches, 1):
            buf, offs = bytes_of(batch.column(1))
            margin = np.full(batch.num_rows, w[-1])
            for i, j in row_slices(offs, wordhash.TEXT_SLICE):
                for number, row in features(hasher, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], bits):
                    n = np.bincount(row, minlength=j - i)
                    margin[i:j] += SCALE * np.bincount(row, weights=w[number], minlength=j - i) / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))],
                                             ["kept", "score"])

    kind = rows.schema["kept"].dataType.simpleString()
    return (rows.mapInArrow(released(task), f"kept {kind}, score double")
            .select(*(F.col(f"kept.{n}").alias(c) for c, n in zip(keep, names, strict=True)),
                    F.struct("score", (F.col("score") >= threshold).cast("int").alias("predicted")).alias(result)))


def accepted(df: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, with its columns, that score at least ``threshold``."""
    result = free_name(df, "judged")
    scored = score(df, weights, text_col, threshold=threshold, result=result)
    return scored.where(F.col(f"{result}.predicted") == 1).select(*(named(c) for c in df.columns))


def training_fold(id_column):
    """Rows that labels may be learned from: crc32 of the id as text, mod 3, isn't 1."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 != 1, F.lit(False))
