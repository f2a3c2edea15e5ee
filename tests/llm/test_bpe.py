"""Encoding against the tiktoken library, decoding as an exact round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqstats.llm import bpe
from seqstats.llm.queries import op4_byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return bpe.vocabulary(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_any_text(known, library, text):
    ids = next(known.encoded([text]))
    assert ids == packed(library.encode_ordinary(text))
    assert bpe.token_bytes(PATH).decode(ids) == text.encode()


def test_ties_long_runs_and_blocks(known, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 7)
    texts = ["a" * 3000, " " * 500 + "x", None, "", "zzzzzz yyyy " * 400, "ééé中文 <|endoftext|>'s 12345\r\n\t "]
    assert list(known.encoded(texts)) == [packed(library.encode_ordinary(t or "")) for t in texts]


def test_perfect_hash_is_minimal_and_tells_foreign_keys_apart(known):
    h = known.hash
    assert sorted(h.key_of) == list(range(len(known.tokens)))
    assert (h.find(known.tokens) == np.arange(len(known.tokens))).all()
    assert all(known.tokens[i] != b"no such entry" for i in h.find([b"no such entry"]))


def test_frame(spark, library):
    rows = [(1, "one two", "x"), (2, None, "y"), (None, "", None), (1, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in bpe.encoded_digests(df, PATH, P.PATTERN).collect())
    want = [(i or 0, library.encode_ordinary(t or "")) for i, t, _ in rows]
    assert got == sorted((i, len(x), hashlib.sha256(packed(x)).hexdigest()) for i, x in want)
    assert bpe.encoded_digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, folder).collect():
        assert r.ids_sha256 == hashlib.sha256(packed(library.encode_ordinary(texts[r.doc_id]))).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
