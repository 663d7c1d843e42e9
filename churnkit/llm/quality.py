"""Quality classifier (operator 6).

Method: regularised quadratic discriminant.  Each document is described by a short vector of
transformed statistics of its text.  The labelled rows give, for each class, a count, sums and
sums of products; from these come the class means and the class covariances, shrunk towards the
pooled covariance and towards a multiple of the identity.  A score is the logistic of the
difference of the two log densities, whose Mahalanobis terms use Cholesky factors that are computed
once.  Fitting needs one aggregation whose result has a few hundred numbers, at any input size, and
all labelled rows count.

Defined results: a null or empty text is described like any other (all its statistics are those of
nothing); a document with several labels counts once, with the smallest; null labels are ignored;
rows of a repeated ``doc_id`` are scored one by one; without rows of both classes every score is
the share of class 1 among the labelled rows, or 0.5 without any; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, prepare, stash, texts

FEATURES = ("length", "words", "word_length", "word_spread", "distinct", "most_frequent", "adjacent_repeats", "capitals",
            "symbols", "digits", "marks", "distinct_lines", "line_words", "short_words", "symbol_words", "other_bytes")
CAP = 5.0  # standardised features are cut here, so that odd texts are odd within reason

_KIND = np.zeros(256, np.uint8)  # 0 lower case, 1 capital, 2 digit, 3 mark of prose, 4 other symbol, 5 blank, 6 not ASCII
_KIND[[i for i in range(128) if not chr(i).isalnum()]] = 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 6
_PLAIN = re.compile(r"[^\W\d_]", re.UNICODE)


def _share(part: float, whole: float, usual: float, weight: float) -> float:
    """Log-odds of a share, drawn towards a usual value in short texts."""
    p = (part + usual * weight) / (whole + weight)
    return math.log(p / (1 - p))


def describe(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7).tolist()
    words = text.split()
    k = len(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.float64, k)
    lines = [x for x in text.split("\n") if x]
    repeats = sum(map(str.__eq__, words, words[1:]))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)
    letters = counts[0] + counts[1]
    return [
        math.log1p(n), math.log1p(k),
        math.log((float(sizes.sum()) + 5 * 5) / (k + 5)),
        math.log(float(((sizes - sizes.mean()) ** 2).sum() + 9 * 5) / (k + 5)) if k else math.log(9),
        math.log((len(seen) + 2) / (k + 2)) / math.log(k + 3) if k else 0.0,
        _share(max(seen.values(), default=0) - 1 if k else 0, k, 0.05, 10),
        _share(repeats, k, 0.01, 5),
        _share(counts[1], letters, 0.03, 40),
        _share(counts[4], n, 0.005, 40),
        _share(counts[2], n, 0.005, 40),
        _share(counts[3], n, 0.02, 40),
        _share(len(set(lines)), len(lines), 0.95, 4),
        math.log((k + 20) / (len(lines) + 1)),
        _share(float((sizes <= 3).sum()), k, 0.4, 10),
        _share(odd, k, 0.01, 5),
        _share(counts[6], n, 0.02, 40),
    ]


def features(df: DataFrame) -> DataFrame:
    """``(doc_id, x)`` for documents ``(doc_id, text)``: the statistics of the whole text, in the order of ``FEATURES``."""
    prepare(df.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([describe(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        return pa.record_batch([batch.column(0), x], names=["doc_id", "x"])

    return arrow_map(texts(df), rows, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Scores rows of features; ``white`` are inverse Cholesky factors of the class covariances."""

    share: float
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    white: np.ndarray
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.center):
            return np.full(len(x), self.share)
        z = np.clip((x - self.center) / self.scale, -CAP, CAP)
        logs = []
        for c in (0, 1):
            d = (z - self.means[c]) @ self.white[c].T
            logs.append(-0.5 * (d * d).sum(axis=1) - 0.5 * self.log_det[c])
        gap = np.clip(logs[1] - logs[0] + math.log(self.share / (1 - self.share)), -700, 700)
        return 1 / (1 + np.exp(-gap))


def _moments(z: DataFrame, dims: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products for each class, from one aggregation."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    agg = [F.count(F.lit(1)).alias("n")]
    agg += [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)]
    agg += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in z.groupBy("label").agg(*agg).collect():
        s = np.array([r[f"s{i}"] for i in range(dims)])
        p = np.zeros((dims, dims))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[int(r["label"])] = (float(r["n"]), s, p)
    return out


def fit(labelled: DataFrame, to_pooled: float = 0.2, to_identity: float = 0.02) -> Discriminant:
    """The discriminant of rows ``(x, label)`` with labels 0 and 1, all of them.

    ``to_pooled`` and ``to_identity`` are the shares of the pooled covariance and of a multiple of the
    identity in each class covariance.
    """
    dims = len(FEATURES)
    labelled = labelled.select("x", F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    raw = _moments(labelled, dims)
    n = sum(m[0] for m in raw.values())
    share = raw[1][0] / n if 1 in raw else 0.0
    none = np.zeros(0)
    if len(raw) < 2:
        return Discriminant(share if n else 0.5, none, none, none, none, none)
    center = sum(m[1] for m in raw.values()) / n
    spread = sum(np.diag(m[2]) for m in raw.values()) / n - center**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    cut = F.transform(F.col("x"), lambda v, i: F.greatest(F.lit(-CAP), F.least(F.lit(CAP), (v - F.lit(center.tolist())[i]) / F.lit(scale.tolist())[i])))
    cut_moments = _moments(labelled.select(cut.alias("x"), "label"), dims)
    means, own = [], []
    for c in (0, 1):
        k, s, p = cut_moments[c]
        means.append(s / k)
        own.append(p / k - np.outer(s / k, s / k))
    pooled = sum(cut_moments[c][0] * own[c] for c in (0, 1)) / n
    white, log_det = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * own[c] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / dims, 1e-6) * np.eye(dims)
        low = np.linalg.cholesky(cov)
        white.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(min(max(share, 1e-6), 1 - 1e-6), center, scale, np.array(means), np.array(white), np.array(log_det))


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score, predicted)`` for ``(doc_id, x)``: the chance of label 1, and 1 if it is a half at least."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
        s = model.score(x)
        return pa.record_batch([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                               names=["doc_id", "score", "predicted"])

    return arrow_map(described.select("doc_id", "x"), rows, "doc_id long, score double, predicted int")


def held_out(doc_id) -> F.Column:
    """Rows whose labels no fit may see: CRC-32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, label)``: one label for each document that is not held out."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
            .where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label")))


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``documents``, learned from the rows of
    ``labels`` that are not held out."""
    x = stash(features(documents), "features")
    model = fit(x.join(known_labels(labels, label), "doc_id"))
    return score(x, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``documents`` that :func:`classify` predicts to have label 1, as they are.  Texts are described again
    where they are filtered, which costs less than moving them."""
    x = stash(features(documents), "features")
    model = fit(x.join(known_labels(labels, label), "doc_id"))

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        described = np.array([describe(t) for t in text], dtype=np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(described) >= 0.5)

    return documents.where(good(F.coalesce(F.col("text").cast("string"), F.lit(""))))
