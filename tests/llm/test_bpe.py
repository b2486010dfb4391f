"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


V = bpe.vocabulary(PATH, PATTERN)
PARTS = st.sampled_from(
    ["'s", "'", "re", "'re", " ", "  ", "\n", "\n\n", "\t", " ", "　", "word", "Word", "12", "½", "²", "...", "!'", "é", "日本", "。", "🛡️",
     "a" * 40, "ab" * 30, "=" * 50, " =", "thth", "ing", "\x1c", "́", "Ⅳ", "٣", "<|endoftext|>"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=40), st.integers(1, 12))
def test_joined_halves_are_the_whole(parts, leaf):
    text = "".join(parts)
    with open(PATH, "rb"):
        pass
    want = V.merges.encode_ordinary(text)
    got = bpe.encode(V, text, leaf=leaf).tolist()
    assert got == want
    assert bpe.decode(V, bpe.encode(V, text, leaf=leaf), leaf=leaf) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinrstthe", min_size=1, max_size=300), st.integers(1, 9))
def test_joined_piece_is_the_whole(text, leaf):
    assert bpe.encode_piece(V, text.encode(), leaf) == V.merges._encode_single_piece(text.encode())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 6))
def test_any_text(text, leaf):
    assert bpe.encode(V, text, leaf=leaf).tolist() == V.merges.encode_ordinary(text)


def test_every_token_is_its_own_encoding():
    assert all(V.short_piece(raw) == [rank] for raw, rank in V.ranks.items())


def test_query_form(spark, sf, known):
    rows = [(1, "Hello world's 123  \n x"), (2, None), (3, ""), (4, "ab" * 50_000), (5, "日本語。" * 3000), (5, "dup"), (None, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    docs = docs.union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60))
    found = bpe.digests(docs.withColumnRenamed("doc_id", "_IDS"), PATH, PATTERN).collect()
    assert len(found) == 67
    for r in found:
        ids = known.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_a_middling_text_is_halved(known, monkeypatch):
    seams, plain = [], bpe._seam
    monkeypatch.setattr(bpe, "_seam", lambda *a: seams.append(a[2:]) or plain(*a))
    text = "Some words, 12 of them; and more.\n" * 60
    assert bpe.encode(V, text).tolist() == known.encode_ordinary(text)
    assert len(text) < 4096 and seams
