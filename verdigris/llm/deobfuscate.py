"""The noisy channel of operator 11: obfuscated words back to plain ones.

A writer's word goes through a channel that exchanges letters for look-alikes
(``1d10t``), pulls letters apart (``i d i o t``, ``i.d.i.o.t``) or repeats them
(``idiooot``).  A span that may have gone through it is a lattice: each place has
the letters that its character can stand for, or nothing (a separator that was
put in), or itself as a sign between words.  Viterbi decoding finds the way
through the lattice that is likeliest under a character trigram model and the
channel's probabilities; a plain reading takes part in it, so ``4th`` or ``v2``
need not become words.

The model counts the character trigrams of all words of the corpus: 26 letters,
one class for every other letter, and the word boundary.  Its table has 28**3
counts, whatever the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import wordhash
from verdigris.llm.common import bytes_of, named, released, small_batches

LETTERS, OTHER, EDGE = 26, 27, 0
KINDS = 28

# Letters that signs stand for, in leetspeak.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz",
}

#: Probabilities of the channel: a letter was exchanged; a sign stands for itself; a separator between single letters
#: was put in; a letter that stands three times or more was meant once, or twice.
EXCHANGED, ITSELF, PUT_IN, ONCE, TWICE = 0.3, 0.005, 0.5, 0.6, 0.4
#: Weight of the shorter contexts in the model.
BACK_OFF = 8.0
#: Decoded spans that a task remembers.
REMEMBERED = 200_000

_CLASS = np.array([b - 96 if 97 <= b < 123 else b - 64 if 65 <= b < 91 else OTHER if b >= 0xC0 else EDGE for b in range(256)])
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])
_SIGN = np.array([chr(b) in LOOK_ALIKES for b in range(256)])
_TAIL = np.array([48 <= b < 58 or b in b"@$" for b in range(256)])
_SPACER = np.array([b in b".-_~" for b in range(256)])


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of (second last, last, next) in the words of some rows."""
    start = np.zeros(len(buf) + 1, dtype=bool)
    start[offs] = True
    whole = (buf & 0xC0) != 0x80  # one place for each character
    kind, start = _CLASS[buf[whole]], start[:-1][whole]
    last = np.zeros_like(kind)
    last[1:] = np.where(start[1:], EDGE, kind[:-1])
    second = np.zeros_like(kind)
    second[1:] = np.where(start[1:] | (last[1:] == EDGE), EDGE, last[:-1])
    word = (kind != EDGE) | (last != EDGE)
    return np.bincount(((second * KINDS + last) * KINDS + kind)[word], minlength=KINDS**3)


def count_trigrams(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of all whole texts, in a table of 28**3 entries."""

    def task(batches):
        total = np.zeros(KINDS**3, dtype=np.int64)
        for batch in small_batches(batches, 0):
            buf, offs = bytes_of(batch.column(0))
            for i, j in ((i, min(i + wordhash.TEXT_SLICE, len(buf))) for i in range(0, len(buf), wordhash.TEXT_SLICE)):
                total += _trigrams(buf[i:j], np.clip(offs, i, j) - i)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(KINDS**3, dtype=np.int64)
    rows = df.select(named(text_col).alias("text")).mapInArrow(released(task), "at long, n long")
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():  # 28**3 rows at most
        counts[r["at"]] = r["n"]
    return counts


def model(counts: np.ndarray) -> np.ndarray:
    """log P(next | second last, last), each context mixed with its shorter ones."""
    three = counts.reshape(KINDS, KINDS, KINDS).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + KINDS)
    p2 = (two + BACK_OFF * p1) / (two.sum(axis=1, keepdims=True) + BACK_OFF)
    p3 = (three + BACK_OFF * p2) / (three.sum(axis=2, keepdims=True) + BACK_OFF)
    return np.log(p3)


def _lattice(span: str):
    """For each place of a span its options: the text that it adds, the kinds
    that it goes through, and the channel's log probability."""
    exchanged, itself = np.log(EXCHANGED), np.log(ITSELF)
    for m in re.finditer(r"(.)\1*", span, re.DOTALL):
        c, n = m[1], len(m[0])
        if c in LOOK_ALIKES:
            signs = [(s, (ord(s) - 96,), exchanged - np.log(len(LOOK_ALIKES[c]))) for s in LOOK_ALIKES[c]]
            for _ in range(n):
                yield [*signs, (c, (EDGE,), itself)]
        elif c.isalpha() or ord(c) >= 128:
            kind = ord(c.lower()) - 96 if "a" <= c.lower() <= "z" else OTHER
            if n < 3:
                yield [(c * n, (kind,) * n, 0.0)]
            else:
                yield [(c, (kind,), np.log(ONCE)), (c * 2, (kind,) * 2, np.log(TWICE))]
        else:
            for _ in range(n):
                yield [("", (), np.log(PUT_IN)), (c, (EDGE,), np.log(1 - PUT_IN))]


def decode(span: str, table: list) -> str:
    """The likeliest plain text of a span (Viterbi; states are the last two
    kinds, ways back are kept as links)."""
    states = {(EDGE, EDGE): (0.0, None)}
    for options in _lattice(span):
        after: dict = {}
        for (b, a), (score, way) in states.items():
            for text, kinds, p in options:
                x, y, s = b, a, score + p
                for kind in kinds:
                    if kind != EDGE or y != EDGE:
                        s += table[x][y][kind]
                    x, y = (EDGE, EDGE) if kind == EDGE else (y, kind)
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (way, text))
        states = after
    end = max(states.items(), key=lambda i: (i[1][0] + (table[i[0][0]][i[0][1]][EDGE] if i[0][1] != EDGE else 0.0), i[0]))
    way, parts = end[1][1], []
    while way:
        way, text = way
        parts.append(text)
    return "".join(reversed(parts))


def suspicious(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans, in order and apart, that may have gone through the channel."""
    starts, ends = wordhash.spans(buf, offs, wordhash.WHITE_SEPARATED)
    if not len(starts):
        return starts, ends
    letter, n = _LETTER[buf], len(starts)
    letters = np.flatnonzero(letter)
    a, b = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    has = a < b
    some = np.append(letters, 0)
    first, last = np.where(has, some[a], -2), np.where(has, some[b - 1], -2)
    # look-alikes between letters, one before the first or one behind the last (rows of one sign are decoration)
    sign = np.flatnonzero(_SIGN[buf])
    word = np.searchsorted(starts, sign, side="right") - 1
    around = np.concatenate([[0], buf, [0]])
    alone = (around[sign] != buf[sign]) & (around[sign + 2] != buf[sign])
    edge = (sign == first[word] - 1) | ((sign == last[word] + 1) & _TAIL[buf[sign]])
    odd = np.zeros(n, dtype=bool)
    odd[word[has[word] & (((sign > first[word]) & (sign < last[word])) | (edge & alone))]] = True
    # the same ASCII letter three times or more
    if len(buf) > 2:
        three = np.flatnonzero((buf[1:-1] == buf[:-2]) & (buf[1:-1] == buf[2:]) & letter[:-2] & (buf[:-2] < 128))
        word = np.searchsorted(starts, three, side="right") - 1
        odd[word[three + 2 < ends[word]]] = True
    # single letters with a spacer between each two: at least three letters
    one = np.flatnonzero(has & (ends - starts >= 5))
    at = starts[one]
    spaced = letter[at] & _SPACER[buf[at + 1]] & letter[at + 2] & _SPACER[buf[at + 3]] & letter[at + 4]
    odd[one[spaced]] = True
    # single characters as words: three or more in a row, with one blank between, of which two are letters
    size = ends - starts
    bare = (size == 1) & (letter | _SIGN[buf])[starts]
    joined = np.zeros(n, dtype=bool)
    row = np.searchsorted(offs, starts, side="right")
    joined[1:] = bare[1:] & bare[:-1] & (starts[1:] == ends[:-1] + 1) & (buf[ends[:-1]] == 0x20) & (row[1:] == row[:-1])
    head = np.flatnonzero(bare & ~joined)
    tail = np.flatnonzero(bare & ~np.append(joined[1:], False))
    of_letters = np.concatenate([[0], np.cumsum(bare & letter[starts])])
    long = (tail - head >= 2) & (of_letters[tail + 1] - of_letters[head] >= 2)
    head, tail = head[long], tail[long]
    rows = np.zeros(n + 1, dtype=np.int64)
    np.add.at(rows, head, 1)
    np.add.at(rows, tail + 1, -1)
    single = np.flatnonzero(odd & ~(np.cumsum(rows[:-1]) > 0))
    begin, stop = np.concatenate([starts[single], starts[head]]), np.concatenate([ends[single], ends[tail]])
    order = np.argsort(begin)
    return begin[order], stop[order]


class Restorer:
    """Texts with their suspicious spans decoded; one for each task."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table.tolist(), {}

    def restored(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The restored bytes, their row offsets and the spans of each row
        that were changed."""
        starts, ends = suspicious(buf, offs)
        raw = buf.tobytes()
        parts, grown, changed, done = [], np.zeros(len(offs), dtype=np.int64), np.zeros(len(offs), dtype=np.int64), 0
        row = np.searchsorted(offs, starts, side="right") - 1
        for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
            span = raw[a:b]
            plain = self.known.get(span)
            if plain is None:
                plain = decode(span.decode("utf-8", "replace"), self.table).encode()
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[span] = plain
            if plain != span:
                parts += [raw[done:a], plain]
                done = b
                grown[r + 1] += len(plain) - len(span)
                changed[r] += 1
        parts.append(raw[done:])
        return np.frombuffer(b"".join(parts), np.uint8), offs + np.cumsum(grown), changed[:-1]
