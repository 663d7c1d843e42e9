"""Byte-level BPE encoding and decoding (operator 1).

Method: a hierarchical-bitmap rank queue.  The pieces of a pre-token form a linked list.  Every
adjacent pair that the vocabulary can merge lies in the bucket of its merge rank; a bitmap with
64-bit words and two summary levels marks the buckets that hold something, so find-first-set over
three words gives the lowest rank.  Merging a pair leaves the entries of its old neighbours in
their buckets; they are recognised as stale (their pair has another rank by now) and skipped.
Each merge costs a constant number of queue operations, whatever the length of the pre-token.

Pre-tokens do not depend on one another, so documents are encoded where they are read, without a
shuffle.  A bounded memo per worker process keeps the ids of short pre-tokens, in two halves, of which the older one is
dropped when the newer one is full; what is used again moves over, so frequent pre-tokens stay.

Defined results: a null or empty text has no ids; repeated rows give repeated rows; an empty
table gives an empty table; a null ``doc_id`` is carried along; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.common import arrow_map, prepare, texts

#: Pre-tokens up to so many characters are remembered, up to twice so many of them; characters encoded at once.
MEMO_CHARS, MEMO_SIZE, BLOCK_CHARS = 32, 350_000, 2 << 20


BIT = [1 << i for i in range(64)]


class RankQueue:
    """Priority queue of (rank, position) for a fixed number of ranks."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * (ranks // 64 + 1)
        self.middle = [0] * (len(self.words) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heapq.heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        bits = self.words[word]
        self.words[word] = bits | BIT[rank & 63]
        if not bits:
            block = word >> 6
            self.middle[block] |= BIT[word & 63]
            self.top |= BIT[block]

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank."""
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        marks = self.middle[block]
        word = (block << 6) + (marks & -marks).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = (word << 6) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        bits = self.words[word] = bits ^ low
        if not bits:
            marks = self.middle[block] = marks & (marks - 1)
            if not marks:
                self.top = top & (top - 1)
        return rank, bucket[0]


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=0) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.findall = regex.compile(pattern).findall
        self.queue = RankQueue(len(self.pieces))
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = np.array([len(x) for x in self.pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(self.pieces), np.uint8)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        n, rank_of = len(token), ranks.get
        piece: list[bytes | None] = [token[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of(token[i:i + 2], -1) for i in range(n)]  # the rank of the pair that begins here
        pair[-1] = -1
        push, pop = queue.push, queue.pop
        for i, rank in enumerate(pair):
            if rank >= 0:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale: one of its pieces was merged meanwhile
            j = after[i]
            merged = self.pieces[rank]
            piece[i], piece[j], pair[j] = merged, None, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = rank = rank_of(merged + piece[k], -1)
                if rank >= 0:
                    push(rank, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = rank = rank_of(piece[h] + merged, -1)
                if rank >= 0:
                    push(rank, h)
        return [ranks[p] for p in piece if p is not None]

    def packed(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            merged = self.merge(token.encode("utf-8"))
            ids = struct.pack(f"<{len(merged)}I", *merged)
            if len(token) > MEMO_CHARS:
                return ids
        if len(self.memo) >= MEMO_SIZE:
            self.older = dict(self.memo)
            self.memo.clear()
        self.memo[token] = ids
        return ids

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        known, packed, findall = self.memo.get, self.packed, self.findall
        gc.disable()  # many small acyclic objects: walking over them again and again takes time
        try:
            return [b"".join([known(t) or packed(t) for t in findall(text)]) for text in batch]
        finally:
            gc.enable()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """One gather from the bytes of all pieces."""
        own = np.frombuffer(ids, dtype="<u4")
        size = self.length[own]
        ends = np.cumsum(size)
        return self.all[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[own] - (ends - size), size)].tobytes()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per rank file and worker process.  ``path`` names a file that every host has."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return Codec(ranks, pattern)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encoded(c: Codec, batch: list[str]) -> list[bytes]:
    """Ids of texts, some megabytes of them at a time."""
    out, low, size = [], 0, 0
    for k, t in enumerate(batch):
        size += len(t)
        if size > BLOCK_CHARS or k + 1 == len(batch):
            out += c.encode_all(batch[low:k + 1])
            low, size = k + 1, 0
    return out


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` for documents ``(doc_id, text)``; ids as little-endian unsigned 32-bit integers."""
    prepare(df.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = pa.array(encoded(c, _column(batch, "text").to_pylist()), pa.binary())
        return pa.record_batch([_column(batch, "doc_id"), ids], names=["doc_id", "ids"])

    return arrow_map(texts(df), rows, "doc_id long, ids binary")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, decoded)`` for ``(doc_id, ids)``: the bytes that the ids stand for."""
    prepare(df.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        out = pa.array([c.decode(x or b"") for x in _column(batch, "ids").to_pylist()], pa.binary())
        return pa.record_batch([_column(batch, "doc_id"), out], names=["doc_id", "decoded"])

    return arrow_map(df.select("doc_id", "ids"), rows, "doc_id long, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: :func:`encode`, then :func:`decode` of those ids, in one pass."""
    prepare(df.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = encoded(c, _column(batch, "text").to_pylist())
        return pa.record_batch([_column(batch, "doc_id"), pa.array(ids, pa.binary()),
                                pa.array([c.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return arrow_map(texts(df), rows, "doc_id long, ids binary, decoded binary")
