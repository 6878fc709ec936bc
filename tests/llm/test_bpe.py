"""BPE against tiktoken and exact round trips."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
OWN = bpe.encoder(RANKS, P.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


def ids(text):
    return memoryview(OWN.pack(text)).cast("I").tolist()


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 3000, "é" * 2000, " \x1c x\x85\n\n y", "it's 'S we'LL", "12 ½² x", "́a", "<|endoftext|>", "\U0001f600" * 300, "word " * 40000])
def test_cases(text):
    assert ids(text) == LIB.encode_ordinary(text)
    assert OWN.unpack(OWN.pack(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdethinou '\n\t1.,-éßñ¼ʼ中 ")), max_size=80))
def test_any_text(text):
    assert ids(text) == LIB.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60))
def test_queue_order(ranks):
    queue = bpe.RankQueue(301)
    for position, rank in enumerate(ranks):
        queue.push(rank, position)
    out = []
    while queue.summary:
        out.append(queue.pop())
    assert out == sorted((r, p) for p, r in enumerate(ranks)) and not queue.buckets and not any(queue.words)


def test_frames(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "ü " * 70000)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary")
    encoded = bpe.encode(docs, RANKS, P.PATTERN)
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(LIB.encode_ordinary(text))
    assert bpe.round_trip(docs.where("false"), RANKS, P.PATTERN).count() == 0
