import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
REPLAY = bpe.MergeReplay(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    import numpy as np
    import regex

    pieces = regex.compile(P.PATTERN).findall(text)
    cache = {}
    bpe.piece_ids(REPLAY, cache, [pieces])
    return np.frombuffer(b"".join(cache[p] for p in pieces), dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_like_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)
    assert bpe.Decoder(REPLAY.by_id).decode(b"".join(i.to_bytes(4, "little") for i in ids_of(text))) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 3000, " " * 50 + "x", "\n\n\t", "aaa bbb aaaa", "déjà vu 漢字 🙂🙂🙂"])
def test_runs_and_scripts(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_lower_ranks_that_open_late():
    # merging xy opens (xy, z), whose rank is lower than that of xy: the vocabulary was not built in order
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 300, b"xy": 301, b"zx": 302}
    replay = bpe.MergeReplay(ranks)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 12))).encode() for _ in range(300)]
    for word, ids in zip(words, replay.encode(words), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in replay.plain(word))


def test_documents(spark):
    rows = [(1, "Hello world"), (None, None), (2, ""), (2, ""), (3, "x " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    got = bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    assert len(got) == 5
    texts = {i: t for i, t in rows}
    for r in got:
        want = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []
