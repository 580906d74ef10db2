"""Operator 4: token counts as the tokenizers library gives them.

Texts up to ``chunk_chars`` characters are counted whole.  A huge text is
encoded in overlapping chunks with offsets; neighbouring chunks are spliced at
a boundary that both encodings have and that is proven stable, and where an
overlap holds none it is widened (doubled) until it does or the chunk reaches
the text's end.

A boundary is proven stable where a blank or line feed follows a character
that no Unicode version counts as white space: with a byte-level
pre-tokenizer and no normalizer, no pre-token has white space after another
character, no merge crosses a pre-token, and an added token that strips or
contains white space is refused (``stable_boundaries``).  Such boundaries also
cut a text into units whose counts don't depend on their neighbours, so the
counts of units seen before come from a bounded table; the library encodes
each new one.  Vocabularies without that proof (another pre-tokenizer, a
normalizer, SentencePiece) are encoded whole, text by text.

Special strings in a text are handled as the library does by default: a
special token's string counts as that token.  Defined results: null counts as
empty; an empty text has 0 tokens; repeated rows and null ids are kept, one
output row for each input row.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm.common import named, released, small_batches, vocabulary

#: Characters of a chunk, and of the first overlap between two chunks.
CHUNK_CHARS = 32768
OVERLAP_CHARS = 512
#: Units whose counts a task remembers, and the longest that it remembers.
KNOWN_UNITS = 400_000
UNIT_CHARS = 256

#: All that some Unicode version or library counts as white space (fixed values).
ANY_WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e"
             "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b"
             "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff")
_STABLE = re.compile(f"(?<=[^{ANY_WHITE}])(?=[ \n])")


def stable_boundaries(spec: dict) -> bool:
    """Whether a tokenizers file has the properties that the proof needs."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and not spec.get("truncation") and not spec.get("padding")
            and (spec.get("model") or {}).get("dropout") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        for t in spec.get("added_tokens", [])))


class Counter:
    """Counts tokens of one text at a time with one vocabulary."""

    def __init__(self, raw: bytes, kind: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        self.chunk_chars, self.overlap_chars = chunk_chars, overlap_chars
        self.known: dict[str, int] = {}
        self.widened = 0
        if kind == "model":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.whole = lambda text: len(pieces.encode(text))
            self.stable = False
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.whole = lambda text: len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.stable = stable_boundaries(json.loads(raw))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.stable:
            return self.whole(text)
        return self.by_chunks(text) if len(text) > self.chunk_chars else self.by_units(text)

    def by_units(self, text: str) -> int:
        """Sum over units: each begins at a stable boundary."""
        known, total, held = self.known, 0, ""
        for i, piece in enumerate(text.split(" ")):
            unit = f"{held} {piece}" if i else piece
            if not unit:
                continue
            if unit[-1] in ANY_WHITE:  # the boundary after it isn't stable: hold it for the next
                held = unit
                continue
            held = ""
            n = known.get(unit)
            if n is None:
                n = self.whole(unit)
                if len(unit) <= UNIT_CHARS:
                    if len(known) >= KNOWN_UNITS:
                        known.clear()
                    known[unit] = n
            total += n
        return total + (self.whole(held) if held else 0)

    def by_chunks(self, text: str) -> int:
        """Overlap resynchronisation over one huge text."""
        total, at, size = 0, 0, len(text)
        end = min(size, self.chunk_chars)
        starts, stops = self.encoded(text, 0, end)
        while end < size:
            overlap = self.overlap_chars
            while True:
                back = max(at + 1, end - overlap)
                next_end = min(size, end + max(self.chunk_chars, end - at))
                following = self.encoded(text, back, next_end)
                cut = self.splice(text, back, end, (starts, stops), following)
                if cut is not None or back == at + 1:
                    break
                self.widened += 1
                overlap *= 2
            if cut is None:  # no common boundary at all: encode on from where the last splice was
                following = self.encoded(text, at, next_end)
                cut = at
            total += sum(1 for s in starts if at <= s < cut)
            at, end, (starts, stops) = cut, next_end, following
        return total + sum(1 for s in starts if s >= at)

    def encoded(self, text: str, a: int, b: int) -> tuple[list[int], list[int]]:
        offsets = self.tokenizer.encode(text[a:b], add_special_tokens=False).offsets
        return [a + s for s, _ in offsets], [a + e for _, e in offsets]

    @staticmethod
    def splice(text: str, a: int, b: int, left, right) -> int | None:
        """A stable boundary within a..b that no token of either encoding
        crosses, with the same tokens from there to the next stable one."""
        cuts = [m.start() for m in _STABLE.finditer(text, a, b) if a < m.start() < b]
        if len(cuts) < 2:
            return None

        def marks(side):
            starts, stops = side
            inside = [(s, e) for s, e in zip(starts, stops, strict=True) if a <= e and s <= b]
            return inside

        mine, other = marks(left), marks(right)
        for cut, after in zip(cuts, cuts[1:], strict=False):
            if any(s < cut < e or s < after < e for s, e in mine + other):
                continue
            if [x for x in mine if cut <= x[0] < after] == [x for x in other if cut <= x[0] < after]:
                return cut
        return None


def count_tokens(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows of id, n_bytes, n_tokens and over_limit."""
    raw = vocabulary(df.sparkSession, vocabulary_path)
    kind = vocabulary_path.rpartition(".")[2]

    def task(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(raw.value, kind, chunk_chars, overlap_chars)
        for batch in small_batches(batches, 1):
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            counts = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    narrow = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    return (narrow.mapInArrow(released(task), f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
