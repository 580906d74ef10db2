"""Operator 11: toxicity by noisy-channel deobfuscation.

Spans that may be obfuscated (look-alikes among letters, letters pulled apart
or repeated) are decoded as character lattices by Viterbi under a character
trigram model (``deobfuscate``), whose counts cover all documents; the score is
that of the restored text.

Features of a restored text are its distinct words (runs of letters, A-Z
lower-cased) and their first ``PREFIXES`` letters, as 64-bit hashes.  The score is a logistic
regression on which of them are present, with an L1 penalty, fitted by
accelerated proximal gradient steps: words that better ones explain get no
weight, so neither names nor copies of one text add up, and no word has a
negative one.  The bias makes the mean score the share of toxic texts.

Training reads labelled rows in the order of a hash of their id, at most
``MAX_ROWS`` and ``MAX_BYTES`` of text (documented bounds; all where there are
fewer), one text for each id.  Features of at least ``MIN_TOXIC`` toxic texts are candidates, the
``MAX_FEATURES`` most frequent where there are more; those whose presence tells
of toxicity (``RATIO``, ``TELLING``) take part in the fit.  The weights that aren't zero are broadcast; counting characters and scoring are one
pass over the documents each, without a shuffle of texts.

Defined results: null and empty texts, and texts without any weighted word,
score by the bias alone; a document with several labels counts as 1 if their
mean is 0.5 or more; null labels and ids are left out; without labels of both
kinds every score is their share (0.5 without any).  Repeated rows and null ids
are kept, one output row for each input row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import deobfuscate, wordhash
from verdigris.llm.common import bounded_broadcast, bytes_of, named, released, row_slices, small_batches
from verdigris.llm.labelled import labelled_texts

PREFIXES = (4, 5)
MAX_ROWS, MAX_BYTES, MAX_FEATURES, MIN_TOXIC = 20_000, 64 << 20, 1 << 18, 2
#: Weight of the L1 penalty, steps of the fit, and the score from which a text counts as toxic.
PENALTY, STEPS, THRESHOLD = 0.03, 600, 0.3
#: A candidate's log odds ratio is at least RATIO (ten to one), and TELLING standard errors above zero.
RATIO, TELLING = float(np.log(10)), 2.5

_LETTERS = np.array([65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


def features(hasher: wordhash.Hasher, buf: np.ndarray, offs: np.ndarray):
    """Hashes of the words and of their first letters, each with its row."""
    w = hasher.words(buf, offs, _LETTERS, True)
    rows = w.rows()
    yield wordhash.mix(w.hash, 30), rows
    char = np.flatnonzero((buf & 0xC0) != 0x80)
    place = np.searchsorted(char, w.starts)
    for n in PREFIXES:
        ends = np.append(char, len(buf))[np.minimum(place + n, len(char))]
        longer = np.flatnonzero(ends < w.ends)
        yield wordhash.mix(hasher.hash_spans(buf, w.starts[longer], ends[longer], True), 30 + n), rows[longer]


def _present(table: np.ndarray, known: np.ndarray | None):
    """For batches of place, y, text: the distinct features of each row, as
    hashes, or as numbers of the ``known`` ones."""

    def task(batches):
        hasher, restorer = wordhash.Hasher(), deobfuscate.Restorer(table)
        for batch in small_batches(batches, 2, wordhash.TEXT_SLICE):
            buf, offs, _ = restorer.restored(*bytes_of(batch.column(2)))
            found = [[] for _ in range(batch.num_rows)]
            for h, rows in features(hasher, buf, offs):
                if known is not None:
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    h, rows = at[hit], rows[hit]
                bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                for r in range(batch.num_rows):
                    found[r].append(np.unique(h[bounds[r]:bounds[r + 1]]))
            yield batch, [np.concatenate(f) for f in found]

    return task


def association(y: np.ndarray, rows: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n features the log odds ratio of its presence in texts
    with y = 1 against the others, and that in standard errors."""
    toxic, all_ = (np.bincount(which, weights=v[rows], minlength=n) for v in (y, np.ones(len(y))))
    a, b = toxic + 0.5, all_ - toxic + 0.5
    ratio = np.log(a / (y.sum() + 1)) - np.log(b / (len(y) - y.sum() + 1))
    return ratio, ratio / np.sqrt(1 / a + 1 / b)


def fit_logistic(y: np.ndarray, rows: np.ndarray, which: np.ndarray, n: int, penalty: float = PENALTY,
                 steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of n present/absent features and the bias of an L1-penalised
    logistic regression, by accelerated proximal gradient steps (the bias has
    no penalty; each feature has a step of its own).  Weights aren't negative:
    harmless words don't hide a toxic one.  Both kinds of labels have the same
    weight in all.  ``rows`` and ``which`` pair texts with their features."""
    w, v, bias, bias_v, t = np.zeros(n), np.zeros(n), 0.0, 0.0, 1.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    size = weight * (np.bincount(rows, minlength=len(y)) + 1.0)
    step = 4 / np.maximum(1, np.bincount(which, weights=size[rows], minlength=n))  # a diagonal bound of X'X / 4
    step_bias = 4 / size.sum()
    for _ in range(steps):
        margin = np.bincount(rows, weights=v[which], minlength=len(y)) + bias_v
        apart = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)
        moved = v - step * np.bincount(which, weights=apart[rows], minlength=n)
        w_next = np.maximum(moved - step * penalty, 0)
        bias_next = bias_v - step_bias * apart.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bias_v = w_next + (t - 1) / t_next * (w_next - w), bias_next + (t - 1) / t_next * (bias_next - bias)
        w, bias, t = w_next, bias_next, t_next
    return w, float(bias)


def calibrated(margin: np.ndarray, y: np.ndarray) -> float:
    """What to add to the margins so that the mean score is the share of
    y = 1: a text without evidence never scores above that share."""
    low, high = -60.0, 60.0
    for _ in range(80):
        middle = (low + high) / 2
        if np.mean(1 / (1 + np.exp(-np.clip(margin + middle, -500, 500)))) < y.mean():
            low = middle
        else:
            high = middle
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES,
          min_toxic: int = MIN_TOXIC, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights, and the bias; ``table`` is the
    character model."""
    sample = (labelled_texts(docs, labels, id_col, text_col, label_col, max_rows, max_bytes, "toxicity-sample")
              .select(F.xxhash64("id").alias("place"), "y", "text"))
    none = (np.zeros(0, np.uint64), np.zeros(0))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if toxic in (0, n):
        return *none, float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    all_features, spark = _present(table, None), docs.sparkSession

    def counted(batches):
        for _, found in all_features(batches):
            h, c = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    frequent = (sample.where("y = 1").mapInArrow(released(counted), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
                .where(F.col("c") >= min_toxic).orderBy(F.desc("c"), "h").limit(max_features).select("h").toArrow())
    known = np.sort(frequent["h"].to_numpy().view(np.uint64))
    if not len(known):
        return *none, float(np.log(toxic / (n - toxic)))
    given = bounded_broadcast(spark, known, known.nbytes)

    def numbered(batches):
        for batch, found in _present(table, given.value)(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], ["place", "y", "which"])

    def learn(batches):
        y, which = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            which += [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
        y, rows = np.array(y, dtype=float), np.repeat(np.arange(len(y)), [len(x) for x in which])
        which = np.concatenate(which).astype(np.int64)
        ratio, errors = association(y, rows, which, len(given.value))
        telling = np.flatnonzero((ratio >= RATIO) & (errors >= TELLING))
        number = np.full(len(given.value), -1)
        number[telling] = np.arange(len(telling))
        kept = number[which] >= 0
        some, bias = fit_logistic(y, rows[kept], number[which[kept]], len(telling), penalty, steps)
        bias += calibrated(np.bincount(rows[kept], weights=some[number[which[kept]]], minlength=len(y)) + bias, y)
        w = np.zeros(len(given.value))
        w[telling] = some
        yield pa.RecordBatch.from_arrays([pa.array([np.append(w, bias).astype("<f8").tobytes()], pa.binary())], ["w"])

    rows = sample.mapInArrow(released(numbered), "place long, y int, which binary")
    got = rows.repartition(1).sortWithinPartitions("place", "y", "which").mapInArrow(released(learn), "w binary").collect()
    w = np.frombuffer(got[0]["w"], "<f8")
    used = np.flatnonzero(w[:-1])
    return known[used], w[used], float(w[-1])


def score(df: DataFrame, table: np.ndarray, weights: tuple[np.ndarray, np.ndarray, float], text_col: str = "text",
          keep: list[str] | None = None, threshold: float = THRESHOLD, result: str = "toxicity") -> DataFrame:
    """The ``keep`` columns of each row (default: all) and a struct ``result``
    of score, predicted and n_restored (spans that were decoded to others)."""
    keep = df.columns if keep is None else keep
    names = [f"_{i}" for i in range(len(keep))]
    rows = df.select(F.struct(*(named(c).alias(n) for c, n in zip(keep, names, strict=True)),
                              F.lit(None).cast("int").alias("none")).alias("kept"), named(text_col).alias("text"))
    given = bounded_broadcast(df.sparkSession, (table, *weights), table.nbytes + 2 * weights[0].nbytes)

    def task(batches):
        table, known, w, bias = given.value
        hasher, restorer = wordhash.Hasher(), deobfuscate.Restorer(table)
        for batch in small_batches(batches, 1):
            buf, offs = bytes_of(batch.column(1))
            margin, spans = np.full(batch.num_rows, bias), np.zeros(batch.num_rows, dtype=np.int64)
            for i, j in row_slices(offs, wordhash.TEXT_SLICE):
                plain, places, spans[i:j] = restorer.restored(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                for h, at in features(hasher, plain, places) if len(known) else ():
                    number = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[number] == h
                    pairs = np.unique(at[hit] * len(known) + number[hit])
                    margin[i:j] += np.bincount(pairs // len(known), weights=w[pairs % len(known)], minlength=j - i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500)))), pa.array(spans)], ["kept", "score", "n_restored"])

    kind = rows.schema["kept"].dataType.simpleString()
    return (rows.mapInArrow(released(task), f"kept {kind}, score double, n_restored long")
            .select(*(F.col(f"kept.{n}").alias(c) for c, n in zip(keep, names, strict=True)),
                    F.struct("score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_restored").alias(result)))


def training_fold(id_column):
    """Rows that labels may be learned from: crc32 of the id as text, mod 4, isn't 2."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 != 2, F.lit(False))
