"""Training rows as blocks (M3): one table row holds the codes, labels and folds of a few thousand customers.

Blocks are written once per data set and read by every fit.  A fit is a number: 0 to 4 leave out that fold, ``WHOLE`` uses
all training rows.  Rows made by over-sampling belong to one fit only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit import constants as K
from churnkit.ml.features import Encoder, Rows

BLOCK_ROWS = 4096
WHOLE = K.CV_FOLDS
EVERY = -1  # ``fit`` of rows that are not made
BLOCKS = "n int, num binary, level binary, other binary, gap binary, y binary, fold binary, fit binary"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


@dataclass
class Block:
    rows: Rows
    y: np.ndarray
    fold: np.ndarray
    fit: np.ndarray

    def used(self, fit: int) -> np.ndarray:
        """Rows that a fit learns from."""
        return (self.fit == fit) | ((self.fit == EVERY) & (self.fold != fit))

    def packed(self) -> list:
        r, made = self.rows, self.rows.other is not None
        return [len(r), r.num.astype("<f8").tobytes(), r.level.astype("<i2").tobytes(), r.other.astype("<i2").tobytes() if made else b"",
                r.gap.astype("<f8").tobytes() if made else b"", self.y.astype("u1").tobytes(), self.fold.astype("i1").tobytes(), self.fit.astype("i1").tobytes()]


def batch(blocks: list[Block]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 7]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*(b.packed() for b in blocks), strict=True), kinds, strict=True)], names=_NAMES)


def unpacked(encoder: Encoder, record: pa.RecordBatch) -> Iterator[Block]:
    for n, num, level, other, gap, y, fold, fit in zip(*(record.column(c).to_pylist() for c in _NAMES), strict=True):
        made = bool(other) or bool(gap)
        rows = Rows(encoder, np.frombuffer(num, "<f8").reshape(n, -1), np.frombuffer(level, "<i2").reshape(n, -1),
                    np.frombuffer(other, "<i2").reshape(n, -1) if made else None, np.frombuffer(gap, "<f8") if made else None)
        yield Block(rows, np.frombuffer(y, "u1"), np.frombuffer(fold, "i1"), np.frombuffer(fit, "i1"))


def pack(train: DataFrame, encoder: Encoder) -> DataFrame:
    """Blocks of training rows ``(features, label, fold)``."""
    columns = [*encoder.columns, K.TARGET_COLUMN, "fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(len(h) for h in held) >= BLOCK_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield batch([one(whole.slice(0, BLOCK_ROWS))])
                held = whole.slice(BLOCK_ROWS).to_batches()
        if sum(len(h) for h in held):
            yield batch([one(pa.Table.from_batches(held))])

    def one(table: pa.Table) -> Block:
        c = {name: table.column(name).combine_chunks() for name in columns}
        c = {k: v.chunk(0) if isinstance(v, pa.ChunkedArray) and v.num_chunks == 1 else v for k, v in c.items()}
        rows = encoder.read(c)
        return Block(rows, np.asarray(c[K.TARGET_COLUMN]).astype("u1"), np.asarray(c["fold"]).astype("i1"), np.full(len(rows), EVERY, "i1"))

    return train.select(*columns).mapInArrow(run, BLOCKS)
