"""Operators 3 and 5 against the libraries."""

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm.bpe import codec, decode, encode
from skein.llm.token_counts import TokenCounter, token_counts

COUNTED, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(COUNTED)
COUNTER = TokenCounter(COUNTED)
with open(RANKS, "rb") as f:
    ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
LETTERS = [*"abcdefgh  \n\t'!?.,0123é中文ßİ\u00a0\u3000\x1c\x1f\x85👍🏽", "'re", "'s", "'ll", " the", "<|endoftext|>", "  "]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=40).map("".join) | st.text(max_size=60))
def test_prefixes(text):
    counts = COUNTER.prefix_counts(text)
    assert len(counts) == len(text.encode()) + 1 and COUNTER.count(text) == counts[-1]
    for k in range(len(text) + 1):
        assert counts[len(text[:k].encode())] == library(text[:k])
    if "<" not in text:
        for budget in (0, 1, 3, 7):
            assert COUNTER.fit(text, budget) == max(len(text[:k].encode()) for k in range(len(text) + 1) if library(text[:k]) <= budget)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*LETTERS, "aaa", "abab"]), max_size=60).map("".join) | st.text(max_size=80))
def test_replay(text):
    own = codec(RANKS, P.PATTERN)
    own.memo.clear()
    ids = next(own.encode([text]))
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ENCODING.encode_ordinary(text) and own.decode(ids).decode() == text


def test_replay_of_many_words_at_once():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 30))) for _ in range(200)) for _ in range(40)] + ["a" * 3000, "ab" * 999]
    own = codec(RANKS, P.PATTERN)
    own.memo.clear()
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ENCODING.encode_ordinary(t)


def test_columns(docs, corpus, no_docs):
    got = sorted(map(tuple, token_counts(docs, COUNTED, 20).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), n := library(t or ""), n > 20, COUNTER.fit(t, 20) if n > 20 else None) for i, t, *_ in corpus), key=repr)
    got = sorted(map(tuple, encode(docs, RANKS, P.PATTERN, digests=True).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := ENCODING.encode_ordinary(t or "")), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())) for i, t, *_ in corpus]
    assert got == sorted(want, key=repr)
    assert token_counts(no_docs, COUNTED).collect() == [] and encode(no_docs, RANKS, P.PATTERN).collect() == []


def test_round_trip(docs, corpus):
    got = decode(encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((i, t or "") for i, t, *_ in corpus), key=repr)


def test_prefix_column(spark):
    r = token_counts(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"), COUNTED, with_prefixes=True).orderBy("doc_id").collect()
    assert r[0]["prefix_counts"] == [library("ab cd"[:k]) for k in range(6)] and r[1]["prefix_counts"] == [0]


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(P.path("word_bpe_49k.json"))
