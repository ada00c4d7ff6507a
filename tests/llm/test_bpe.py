import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["'", "'r", "e", "'ll", " ", "  ", "\n", "\t\n", "a", "é", "the", " The", "12", "٣", "!!", "<|endoftext|>", "　", "日本", "😀", "́", "aaaaaaa", "."]


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_every_token_encodes_to_itself():
    coder = bpe.TreeBPE(RANKS, P.PATTERN)
    assert all(coder.match_ids(b) == [i] for b, i in list(RANKS.items())[::17])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40).map("".join), st.sampled_from([1, 2, 5, 1000]))
def test_tree_equals_the_library(text, leaf):
    coder = bpe.TreeBPE(RANKS, P.PATTERN, leaf)
    assert ids(coder, text) == THEIRS.encode_ordinary(text)
    assert coder.decode(np.frombuffer(coder.encode(text), "<u4")) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 3001 + "x", "=" * 777, "é" * 999, "'" * 500 + "s", "x1" * 400, "".join(random.Random(1).choices("abcdefgh", k=9000))])
def test_long_matches(text):
    for leaf in (7, 64, 1 << 16):
        assert ids(bpe.TreeBPE(RANKS, P.PATTERN, leaf), text) == THEIRS.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "Hello there's"), (2, ""), (3, None), (None, "x"), (1, "Hello there's"), (4, "z " * 200000)]
    docs = spark.createDataFrame([(*r, b"clash") for r in rows], "doc_id long, text string, ids binary")
    got = sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert got == sorted((i or -1, np.array(THEIRS.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert bpe.digests(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
