"""Operators 1 and 4 against the libraries themselves."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from verdigris.llm import byte_bpe, token_count

from llm_cases import SF_SMALL, docs, documents, no_docs, sentence  # noqa: F401

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return byte_bpe.make_encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def counter():
    with open(JSON, "rb") as f:
        return token_count.Counter(f.read(), "json", chunk_chars=200, overlap_chars=8)


def test_round_trip_and_ids(spark, docs, encoder):
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(documents())
    want = sorted(repr((i, encoder.encode_ordinary(t or ""))) for i, t, *_ in documents())
    assert sorted(repr((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, *_ in documents())
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)


@pytest.mark.parametrize("text", ["", " ", "\n" * 3000, "a" + " " * 5000 + "b", " " * 2000 + "　" * 100 + "\nx", "x" * 40000,
                                  "it's 12ab \u0085  z" * 300, "\x1c \x1f " * 900, "\t" * 1500 + "end", sentence(11, 3000)])
def test_segments_keep_the_ids(encoder, text):
    assert byte_bpe.encode_text(encoder, text, segment_chars=50).tolist() == encoder.encode_ordinary(text)
    assert "".join(s for s, _ in byte_bpe.segments(text, 50)) == text


def test_white_space_beyond_the_librarys_stack(encoder):
    text = "a" + " " * 1_500_000 + "b"
    ids = byte_bpe.encode_text(encoder, text)
    assert encoder.decode_bytes(ids.tolist()).decode() == text


def test_empty_table(spark, no_docs):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_count.count_tokens(no_docs, JSON).count() == 0


def test_counts_as_the_library(spark, docs, counter):
    rows = token_count.count_tokens(docs, JSON, chunk_chars=300, overlap_chars=8, limit=40).collect()
    want = sorted(repr((i, len((t or "").encode()), counter.whole(t or ""))) for i, t, *_ in documents())
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 40) for r in rows)


@pytest.mark.parametrize("text", [sentence(12, 900), "a" * 2000, "a  b " * 400, "\n\n".join("xy" for _ in range(500)),
                                  "word" * 300 + " " + "more" * 300, "<|endoftext|> x<|endoftext|>" * 60,
                                  "tail   " * 100 + " " * 400, "中文 €" * 300])
def test_chunks_resynchronise(counter, text):
    assert counter.by_chunks(text) == counter.whole(text)
    assert counter.by_units(text) == counter.whole(text)


def test_overlaps_widen(counter):
    before = counter.widened
    text = ("b" * 150 + " ") * 20
    assert counter.by_chunks(text) == counter.whole(text)
    assert counter.widened > before


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_vocabularies_without_the_proof_are_encoded_whole(spark, docs, name):
    with open(public_tokenizers.path(name), "rb") as f:
        plain = token_count.Counter(f.read(), name.rpartition(".")[2])
    assert not plain.stable
    rows = token_count.count_tokens(docs.where("doc_id < 23"), public_tokenizers.path(name)).collect()
    want = sorted(repr((i, plain.whole(t) if t else 0)) for i, t, *_ in documents() if i is not None and i < 23)
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in rows) == want


def test_queries(spark, encoder):
    from verdigris.llm import queries
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(encoder.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(JSON)
    for r in queries.op4_token_count(spark, SF_SMALL).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)
