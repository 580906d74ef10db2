"""Operator 1: byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read on the driver and broadcast (size-checked); each task
builds one encoder from it.  Ids travel as packed little-endian unsigned
32-bit integers, the form a token store keeps, and decode to raw bytes.

Long texts are split before the library sees them, only where every match of
the pattern must end, so that the ids are those of the whole text:

* between a character that is not white space and one that is: no match of the
  pattern has white space after another character;
* before the last character of a run of white space that other text follows:
  all but that character is one match (``\\s+(?!\\S)``).  Very long runs are
  handed over as one piece, without the pattern, whose back-tracking on them
  overflows the library's stack.

Defined results: null counts as empty; an empty text has no ids and decodes to
no bytes; invalid UTF-8 is replaced by U+FFFD before encoding; repeated rows
and null ids are kept, one output row for each input row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm.common import named, released, small_batches, vocabulary

#: Unicode white space, as the pattern's \s has it (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts are cut into segments of about this many characters.
SEGMENT_CHARS = 65536
#: Runs of white space of this length bypass the pattern.
LONG_RUN = 1024

_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def segments(text: str, segment_chars: int = SEGMENT_CHARS) -> Iterator[tuple[str, bool]]:
    """Parts of a text, each with whether it is one match by itself."""
    at = 0
    for run in _RUN.finditer(text):
        yield from ((s, False) for s in _cut(text[at:run.start()], segment_chars))
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start():at], True
    yield from ((s, False) for s in _cut(text[at:], segment_chars))


def _cut(text: str, segment_chars: int) -> Iterator[str]:
    at = 0
    while len(text) - at > segment_chars:
        cut = _CUT.search(text, at + segment_chars)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def make_encoder(rank_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoder, text: str, segment_chars: int = SEGMENT_CHARS) -> np.ndarray:
    if len(text) < LONG_RUN:
        return np.array(encoder.encode_ordinary(text), dtype="<u4")
    ids: list[int] = []
    for part, whole in segments(text, segment_chars):
        ids += encoder._encode_single_piece(part) if whole else encoder.encode_ordinary(part)
    return np.array(ids, dtype="<u4")


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Rows of id, n_tokens and ids (packed little-endian unsigned 32-bit)."""
    ranks = vocabulary(df.sparkSession, rank_path)

    def task(batches):
        encoder = make_encoder(ranks.value, pattern)
        for batch in small_batches(batches, 1):
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            ids = [encode_text(encoder, t.decode("utf-8", "replace"), segment_chars) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([i.tobytes() for i in ids], pa.binary())], ["id", "n_tokens", "ids"])

    narrow = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return (narrow.mapInArrow(released(task), f"id {kind}, n_tokens long, ids binary")
            .withColumnRenamed("id", id_col))


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows of id, n_tokens, ids and decoded (the raw bytes of the ids)."""
    ranks = vocabulary(df.sparkSession, rank_path)

    def task(batches):
        encoder = make_encoder(ranks.value, pattern)
        for batch in small_batches(batches, 1):
            ids = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), batch.column(1),
                 pa.array([encoder.decode_bytes(i.tolist()) for i in ids], pa.binary())],
                ["id", "n_tokens", "ids", "decoded"])

    narrow = df.select(named(id_col).alias("id"), named(ids_col).alias("ids"))
    kind = narrow.schema["id"].dataType.simpleString()
    return (narrow.mapInArrow(released(task), f"id {kind}, n_tokens long, ids binary, decoded binary")
            .withColumnRenamed("id", id_col))
