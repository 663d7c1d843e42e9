"""Byte-level BPE against the public implementation."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from churnkit.llm import bpe, queries
from tests.conftest import SF
from tests.llm.helpers import docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(PATH, PATTERN).ranks, special_tokens={})


def test_queue_gives_lowest_rank_then_leftmost():
    r, q, left = random.Random(3), bpe.RankQueue(50_000), []
    for _ in range(3000):
        if left and r.random() < 0.4:
            assert q.pop() == min(left)
            left.remove(min(left))
        else:
            left.append((r.choice([0, 63, 64, 4095, 4096, 49_999, r.randrange(50_000)]), r.randrange(10**6)))
            q.push(*left[-1])
    while left:
        assert q.pop() == min(left)
        left.remove(min(left))
    assert q.pop() is None and not any(q.words) and not any(q.middle)


def test_ids_equal_for_long_pretokens_and_random_strings(oracle):
    c, r = bpe.codec(PATH, PATTERN), random.Random(5)
    cases = ["", " ", "a" * 20_000, "ab" * 3000, "=-" * 2000, "日本語" * 300, "é" * 500, " \n\n  x", "<|endoftext|>"]
    cases += ["".join(r.choice("abtheinrosl é%\n'") for _ in range(r.randint(1, 300))) for _ in range(300)]
    for text in cases:
        ids = c.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_frame_cases(spark, oracle):
    rows = [(1, "The cat's hat"), (2, None), (3, ""), (4, "a" * 30_000), (5, "twice"), (5, "twice"), (None, "no id")]
    got = bpe.round_trip(docs(spark, rows), PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in got) == sorted(
        (i or 0, np.array(oracle.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    back = bpe.decode(bpe.encode(docs(spark, rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs(spark, rows).limit(0), PATH, PATTERN).count() == 0


def test_query_equals_brute_force(spark, oracle):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = oracle.encode_ordinary(r.text or "")
        g = got.pop(r.doc_id)
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
