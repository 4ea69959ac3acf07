"""Ids equal those of the tiktoken library and decode to the texts."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import byte_bpe as B
from tests.llm.conftest import thue_morse


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    with open(B.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(got: dict, text: str | None, library) -> None:
    want = library.encode_ordinary(text or "")
    assert got["n_tokens"] == len(want)
    assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert got["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_documents_as_the_library(documents, library):
    rows = B.byte_bpe_digests(documents, B.vocabulary()).collect()
    assert len(rows) == documents.count()
    for r in rows:
        check(r.asDict(), r.text, library)


def test_awkward_rows(awkward, texts, library):
    rows = B.byte_bpe_digests(awkward, B.vocabulary()).collect()
    assert len(rows) == len(texts) and "Score" in rows[0].asDict()
    for r in rows:
        check(r.asDict(), r.text, library)


def test_token_lists_and_offsets(awkward, library):
    for r in B.byte_bpe(awkward, B.vocabulary()).collect():
        raw = (r.text or "").encode()
        assert r.token_ids == library.encode_ordinary(r.text or "")
        parts = [raw[a:b] for a, b in zip([0, *r.token_ends], r.token_ends, strict=False)]
        assert parts == [library.decode_single_token_bytes(i) for i in r.token_ids]
        assert B.decode(r.token_ids, B.vocabulary()) == raw


def test_empty_table(no_docs):
    assert B.byte_bpe(no_docs, B.vocabulary()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r'sdmtlrevLL .1 aé数")), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_any_texts(texts):
    encoding = test_any_texts.library
    ids, _, _ = B.encode(pa.array(texts), B.vocabulary())
    assert [i.tolist() for i in ids] == [encoding.encode_ordinary(t) for t in texts]


@pytest.fixture(scope="module", autouse=True)
def _bind(library):
    test_any_texts.library = library


def test_long_piece_without_spaces(library):
    text = "abcdefghij" * 500 + "é" * 700
    assert B.encode(pa.array([text]), B.vocabulary())[0][0].tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_structured_pieces_are_told_apart(library, n):
    pair = thue_morse(n)
    ids, _, _ = B.encode(pa.array(pair), B.vocabulary())
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in pair]
    assert [B.decode(i, B.vocabulary()).decode() for i in ids] == pair


def test_pieces_merged_side_by_side_as_alone(library):
    """Many pieces of one slice, one after another, and with a cache that overflows, give the library's ids."""
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcdeinorst ABé数0123-'") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    want = [library.encode_ordinary(p) for p in pieces]
    bpe = B.Merger(B.vocabulary())
    for size, cached in ((3000, B.CACHED_PIECES), (7, 50)):
        B.CACHED_PIECES, kept = cached, B.CACHED_PIECES
        try:
            for k in range(0, len(pieces), size):
                got = bpe._merge([p.encode() for p in pieces[k : k + size]])
                assert got == [library._encode_single_piece(p.encode()) for p in pieces[k : k + size]]
                ids, _, _ = B.encode(pa.array(pieces[k : k + size]), B.vocabulary())
                assert [i.tolist() for i in ids] == want[k : k + size]
        finally:
            B.CACHED_PIECES = kept
