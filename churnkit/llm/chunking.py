"""Document fingerprints (operator 7).

Method: content-defined chunking.  A gear hash over the last 32 bytes decides where a text is cut:
before the normal size a cut needs more zero bits than after it (normalised chunking), with a least
and a greatest size.  Cuts depend on the bytes around them, so an insertion moves few of them.  The
fingerprint is the set of the chunks' digests, each with its chunk's length; containment is the
share of a text's length in distinct chunks that the other text has too.

Defined results: a null or empty text has an empty fingerprint, which equals another empty one
(containment 1) and holds nothing of others (0); documents are ordered by ``doc_id``, null ids
first, then by a hash of the text; repeated rows follow one another; a single row is its own next
one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, prepare, task_count, texts

LEAST, NORMAL, MOST = 12, 32, 128
#: Zero bits asked for before and after the normal size.
HARD_BITS, EASY_BITS = 6, 4


def _gear() -> np.ndarray:
    """256 well-mixed numbers, from a rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of some bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum over j < 32 of gear[i - j] << j
        if n > k:
            shifted = h[:-k] << np.uint32(k)
            h[k:] += shifted
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = (easy[h[easy] < np.uint32(1 << (32 - HARD_BITS))] + 1).tolist()
    easy = (easy + 1).tolist()
    hard.append(n + MOST)
    easy.append(n + MOST)
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        i = bisect_left(hard, at + LEAST, i)
        cut = hard[i]
        if cut >= at + NORMAL:
            j = bisect_left(easy, at + NORMAL, j)
            cut = min(easy[j], at + MOST)
        at = min(cut, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_set(text: str) -> np.ndarray:
    """Distinct chunks of a text, sorted: 40 bits of digest, 8 bits of length."""
    data = text.encode("utf-8", "surrogatepass")
    ends, digest = cuts(data), xxhash.xxh3_64_intdigest
    at, out = 0, []
    for end in ends:
        out.append(((digest(data[at:end]) & 0xFFFFFFFFFF) << 8) | (end - at))
        at = end
    return np.unique(np.array(out, dtype=np.uint64))


def as_string(chunks: np.ndarray) -> str:
    """Six bytes a chunk, in base 64; equal for equal sets."""
    return base64.b64encode(chunks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode("ascii")


def from_string(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).copy().view("<u8").ravel()


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Share of the length of ``own`` chunks that ``other`` holds."""
    if not len(own):
        return float(not len(other))
    length = (own & np.uint64(255)).astype(np.int64)
    if not len(other):
        return 0.0
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return float(length[other[at] == own].sum() / length.sum())


def fingerprints(df: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` for documents ``(doc_id, text)``."""
    prepare(df.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [as_string(chunk_set(t)) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return arrow_map(texts(df), rows, "doc_id long, fingerprint string")


def with_next(df: DataFrame, prepared: Callable, pair: Callable, schema: str) -> DataFrame:
    """``pair(this, next)`` for every document and the next one in order, the first one being next to the last.

    ``prepared(doc_id, text)`` is called once for each document a task reads, and ``pair`` gets its results; it gives a
    row of ``schema``.  Documents are dealt out by ranges of their ids; the first document of a range also goes to the
    range before it.  The driver sees the borders of the ranges and the first id of each, one of each a task.
    """
    spark = df.sparkSession
    prepare(spark)
    parts = task_count(df)
    rows = texts(df).withColumn("h", F.xxhash64("text"))
    quantiles = [k / parts for k in range(1, parts)]
    borders = np.array(sorted(set(rows.select(F.col("doc_id").cast("double").alias("x")).where("x IS NOT NULL")
                                  .approxQuantile("x", quantiles, 0.25 / parts))) if quantiles else [], dtype=np.float64)

    def range_of(ids: pd.Series) -> np.ndarray:
        return np.searchsorted(borders, ids.astype("float64").fillna(-np.inf).to_numpy(), side="right")

    @F.pandas_udf("int")
    def dealt(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids), dtype="int32")

    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("h"))
    firsts = rows.select(dealt("doc_id").alias("part"), order.alias("o")).groupBy("part").agg(F.min("o").alias("o")).orderBy("part").collect()
    # (id or None, hash) of a range's first document -> the range before, around the ring
    before = {(r["o"]["doc_id"], r["o"]["h"]): firsts[k - 1]["part"] for k, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, h: pd.Series) -> pd.Series:
        own = range_of(ids).tolist()
        keys = zip((None if pd.isna(i) else int(i) for i in ids), h.tolist(), strict=True)
        return pd.Series([[p] if (b := before.get(k)) is None else [p, -1 - b] for p, k in zip(own, keys, strict=True)])

    kinds = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()])
                       for f in spark.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            out = []
            for p, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    part, held = p, None
                elif held is None:
                    continue  # further copies of the next range's first document
                this = prepared(doc_id, text)
                if held is not None:
                    out.append(pair(held, this))
                held = None if extra else this
            if out:
                yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    dealt_out = rows.withColumn("at", F.explode(places("doc_id", "h")))
    dealt_out = dealt_out.select(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("part"), (F.col("at") < 0).alias("extra"),
                                 "doc_id", "h", "text")
    return (dealt_out.repartition(parts, "part").sortWithinPartitions("part", "extra", "doc_id", "h")
            .select("part", "extra", "doc_id", "text").mapInArrow(run, schema))
