"""Logistic regression by Newton steps (M5): least sum of losses + |w|^2 / (2 C), the intercept free, for several fits at once.

A step is one aggregation: tasks sum gradients and the upper part of X' W X of their blocks for every fit, whose size is that of
the slots squared; the driver solves.  Some eight steps reach the optimum to machine precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.ml import blocks as B
from churnkit.ml.ensemble import Linear, logistic
from churnkit.ml.features import Encoder


def moments(table: DataFrame, encoder: Encoder, fits: list[int]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Means and population deviations of the numeric columns, and the rows, of each fit's given training rows (none of those made)."""
    k = len(encoder.numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), 2 * k + 1))
        for b in batches:
            for block in B.unpacked(encoder, b):
                shifted = block.rows.num - np.array(encoder.means)
                for m, fit in enumerate(fits):
                    own = shifted[block.used(fit) & (block.fit == B.EVERY)]
                    total[m] += np.r_[own.sum(axis=0), (own * own).sum(axis=0), len(own)]
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = sum((np.frombuffer(x, "<f8").reshape(len(fits), -1) for x in table.mapInArrow(run, "sums binary").toArrow().column(0).to_pylist()), np.zeros((len(fits), 2 * k + 1)))
    out = []
    for t in total:
        n = max(t[-1], 1.0)
        mean = t[:k] / n
        spread = np.sqrt(np.maximum(t[k:2 * k] / n - mean**2, 0))
        out.append((mean + np.array(encoder.means), np.where(spread > 0, spread, 1.0), float(t[-1])))
    return out


def train(table: DataFrame, encoder: Encoder, fits: list[int], inverse_ridge: float, steps: int, positive_weight: float = 1.0) -> list[Linear]:
    """The optimum of each fit; ``steps`` bounds the Newton steps."""
    scaled = [encoder.scaled_by(m, s) for m, s, _ in moments(table, encoder, fits)]
    d = encoder.width + 1
    w = np.zeros((len(fits), d))
    ridge = np.r_[np.full(d - 1, 1.0 / inverse_ridge), 0.0]
    open_ = np.ones(len(fits), bool)
    center = np.zeros((len(fits), d - 1))
    spark = table.sparkSession

    def sums(w: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(fits), d * d + 2 * d + 1))
            for b in batches:
                for block in B.unpacked(encoder, b):
                    for m, fit in enumerate(fits):
                        used = block.used(fit)
                        if not used.any():
                            continue
                        rows = block.rows.take(used)
                        rows.encoder = scaled[m]
                        x, y = np.c_[rows.values(), np.ones(len(rows))], block.y[used].astype(np.float64)
                        share = np.where(y == 1, positive_weight, 1.0)
                        z = x @ sent.value[m]
                        p = logistic(z)
                        loss = share @ (np.logaddexp(0, z) - y * z)
                        total[m] += np.r_[(x.T @ (x * (share * p * (1 - p))[:, None])).ravel(), x.T @ (share * (p - y)), x.sum(axis=0), loss]
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        found = sum((np.frombuffer(x, "<f8").reshape(len(fits), -1) for x in table.mapInArrow(run, "sums binary").toArrow().column(0).to_pylist()),
                    np.zeros((len(fits), d * d + 2 * d + 1)))
        sent.unpersist()
        return found

    step, last = np.zeros_like(w), np.full(len(fits), np.inf)
    for _ in range(steps):
        found = sums(w)
        for m in np.flatnonzero(open_):
            t = found[m]
            rows = max(t[d * d + 2 * d - 1], 1.0)
            center[m] = t[d * d + d:d * d + 2 * d - 1] / rows
            cost = t[-1] + ridge @ (w[m] ** 2) / 2
            if cost > last[m] * (1 + 1e-13) + 1e-12:  # the step went too far
                step[m] /= 2
                w[m] += step[m]
                open_[m] = np.abs(step[m]).max() > 1e-12
                continue
            last[m] = cost
            gradient = t[d * d:d * d + d] + ridge * w[m]
            step[m] = np.linalg.lstsq(t[:d * d].reshape(d, d) + np.diag(ridge), gradient, rcond=None)[0]
            w[m] -= step[m]
            open_[m] = np.abs(step[m]).max() > 1e-9
        if not open_.any():
            break
    return [Linear(scaled[m], w[m, :-1].copy(), float(w[m, -1]), center[m]) for m in range(len(fits))]
