"""Packing: pieces tile their documents and their sequences, ids equal those of whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from churnkit.llm import packing, queries
from tests.conftest import SF
from tests.llm.helpers import docs, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def check(pieces, expected, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(expected)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(expected[doc_id])
            ids = np.array(expected[doc_id][at:at + p["length"]], "<u4").tobytes()
            assert (bytes(p["ids"]) == ids) if "ids" in p else p["ids_crc32"] == zlib.crc32(ids)
            at += p["length"]
        assert at == len(expected[doc_id])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        to = {p["padded_to"] for p in own}
        assert to == ({window} if k + 1 < len(by_sequence) else {1 << (at - 1).bit_length()}) and at <= to.pop()
        assert at == window or k + 1 == len(by_sequence)


def test_small_windows(spark):
    rows = [(1, words(30, 1)), (2, None), (3, ""), (4, words(3000, 2)), (5, "Ünïcode\tA\r\nb c\x1cd <|endoftext|>"), (6, "x" * 5000),
            (7, "a <|endoftext|> b<|startoftext|>,c <|ENDOFTEXT|>")]
    got = [p.asDict() for p in packing.pack(docs(spark, rows), PATH, window=64).collect()]
    check(got, {i: whole(x) for i, x in rows}, 64)


def test_another_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.Chunks(path), Tokenizer.from_file(path)
    assert not own.cuts and packing.Chunks(PATH).cuts
    for text in ("Two  words, here", "", " lead <|endoftext|>", "né" * 50):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_repeated_rows_are_packed_as_often_as_they_occur(spark):
    got = packing.pack(docs(spark, [(7, "same text")] * 5 + [(None, "no id")]), PATH).collect()
    assert sum(p.length for p in got) == 5 * len(whole("same text")) + len(whole("no id"))
    assert sorted(p.offset for p in got)[0] == 0


def test_empty_table(spark):
    assert packing.pack(docs(spark, [(1, "a")]).limit(0), PATH).count() == 0


def test_query_equals_whole_text_ids(spark):
    got = [p.asDict() for p in queries.op5_packing(spark, SF).collect()]
    check(got, {r.doc_id: whole(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}, 4096)
