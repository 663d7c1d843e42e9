"""Packing documents into fixed token windows (operator 5).

Method: concatenate and cut.  Documents are tokenized where they are read; each task numbers its
tokens from zero and writes them, with its own number, to a table in the shared folder.  A first
pass sums the tokens of each task, the prefix sums of these totals (one number a task) are the
global offset of each task, and a second pass turns "offset of the task + offset in the task"
into windows: a document's ids are cut where the global offset passes a multiple of the window
length.  Every window but the last is full, so the only padding is at the end of the last one,
which is padded to the next power of two.

Text is cut at blanks, tabs and line ends before it is tokenized, which the tokenizer drops anyway, and the ids
of a chunk are remembered, within a bound, in each worker process.  A tokenizer with another normalizer or pattern
encodes texts as a whole.  Control strings within a text get the ids that the tokenizer itself gives them.

Defined results: a null or empty text has only the end id; repeated rows are packed as often as
they occur; an empty table gives no pieces; a null ``doc_id`` is carried along; other columns are
ignored.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import prepare, stash, texts

WINDOW = 4096
#: Chunks up to so many characters are remembered, up to twice so many of them.
MEMO_CHARS, MEMO_SIZE = 40, 200_000
MARKS = ".,!&$%#*;:?"
#: What a tokenizer file must say for its texts to be cut at white space and words.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def settings(tokenizer) -> tuple[dict, dict, list]:
    """A tokenizer's normalizer and pre-tokenizer as its file has them, and its added tokens, without the vocabulary."""
    parts = [json.loads(x.__getstate__()) if x is not None else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    return (*parts, list(tokenizer.get_added_tokens_decoder().values()))


class Chunks(dict):
    """The ids of what stands between blanks, as little-endian unsigned 32-bit integers.

    Two generations are kept: when the newer one is full it becomes the older one, and what is
    used again moves back, so frequent chunks stay.
    """

    def __init__(self, path: str) -> None:
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.older = self.tokenizer.model, {}
        # chunks and words are cut as this normalizer and pattern allow; with others, texts stay whole
        normalizer, split, added = settings(self.tokenizer)
        self.cuts = [x.get("type") for x in normalizer.get("normalizers", ())] == NORMALIZERS and [x.get("type") for x in split.get("pretokenizers", ())] == ["Split", "ByteLevel"] \
            and split["pretokenizers"][0].get("pattern") == {"Regex": PATTERN} and not any(set(x.content) & set(" \t\n\r") or x.lstrip or x.rstrip or x.single_word for x in added)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.ids_of(chunk)
            if len(chunk) > MEMO_CHARS:
                return ids
        if len(self) >= MEMO_SIZE:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[chunk] = ids
        return ids

    def ids_of(self, chunk: str) -> bytes:
        """Marks after a letter are tokens of their own, and letters up to U+00FF are one word in lower case, so
        ``Word,`` has the ids of ``word`` and of the mark, and only such a word goes straight to the merges."""
        if self.cuts and len(chunk) <= MEMO_CHARS:
            stem = chunk.rstrip(MARKS)
            if stem.isalpha() and max(stem) <= "\xff":
                low = stem.lower()
                if low != chunk:
                    return self[low] + (self[chunk[len(stem):]] if len(stem) < len(chunk) else b"")
                pieces = self.model.tokenize(low if low.isascii() else low.encode("utf-8").decode("latin-1").translate(BYTE_LEVEL))
                return np.array([p.id for p in pieces], dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cuts:
            return self.ids_of(text)
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))

    def encode_all(self, batch: list[str]) -> list[bytes]:
        gc.disable()  # many small acyclic objects: walking over them again and again takes a third of the time
        try:
            return [self.encode(t) for t in batch]
        finally:
            gc.enable()


@lru_cache(maxsize=4)
def chunks(path: str) -> Chunks:
    """One tokenizer per file and worker process.  ``path`` names a file that every host has."""
    return Chunks(path)


def tokenize(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """``(part, base, doc_id, ids)``: the ids of each document with ``end_id`` after them, the number
    of the task that made them, and how many tokens that task made before."""
    prepare(df.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, own = TaskContext.get().partitionId(), 0, chunks(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [x + end for x in own.encode_all(batch.column(1).to_pylist())]
            before = list(accumulate((len(x) // 4 for x in ids), initial=base))
            base = before.pop()
            yield pa.record_batch([pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), batch.column(0),
                                   pa.array(ids, pa.binary())], names=["part", "base", "doc_id", "ids"])
        own.older = {}  # workers outlive their tasks: keep one generation only

    return texts(df).mapInArrow(run, "part int, base long, doc_id long, ids binary")


def pack(df: DataFrame, path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, padded_to, ids)`` of documents
    ``(doc_id, text)``: ``length`` ids of the document, from its ``start``-th on, stand at ``offset`` of the sequence,
    whose ids are followed by padding up to ``padded_to``.

    The driver sees one row for each task that read documents, and sends as many back.
    """
    spark = df.sparkSession
    tokens = stash(tokenize(df, path, end_id), "tokens").withColumn("n", (F.length("ids") / 4).cast("long"))
    totals = tokens.groupBy("part").agg(F.max(F.col("base") + F.col("n")).alias("total")).orderBy("part").collect()
    starts = list(accumulate((r["total"] for r in totals), initial=0))
    last, rest = divmod(starts[-1], window)
    offsets = spark.createDataFrame([(r["part"], s) for r, s in zip(totals, starts[:-1], strict=True)], "part int, first long")
    begin = F.col("first") + F.col("base")
    end = begin + F.col("n")

    def piece(s):
        at = F.greatest(begin, s * window)
        size = F.least(end, (s + 1) * window) - at
        return F.struct((at - begin).alias("start"), size.alias("length"), F.col("n").alias("doc_tokens"), s.alias("sequence_id"),
                        (at - s * window).alias("offset"),
                        F.when(s < last, window).otherwise(1 << max(rest - 1, 0).bit_length()).cast("int").alias("padded_to"),
                        F.substring(F.col("ids"), (4 * (at - begin) + 1).cast("int"), (4 * size).cast("int")).alias("ids"))

    pieces = F.transform(F.sequence(F.expr(f"(first + base) div {window}"), F.expr(f"(first + base + n - 1) div {window}")), piece)
    return tokens.join(F.broadcast(offsets), "part").select("doc_id", F.inline(pieces))
