"""Quality classifier: moments, score against a direct computation, held-out accuracy."""

import zlib

import numpy as np
import pytest

from churnkit.llm import quality, queries
from tests.llm.helpers import docs, words

SF01 = "/root/testdata/sf0.01"


def test_scores_equal_direct_densities(spark):
    r = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = np.concatenate([r.normal(0, 1, (300, d)), r.normal(0.7, 2, (200, d))])
    y = np.repeat([0, 1], [300, 200])
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "doc_id long, x array<double>, label int")
    model = quality.fit(rows)
    center, scale = x.mean(axis=0), x.std(axis=0)
    z = np.clip((x - center) / scale, -quality.CAP, quality.CAP)
    logs = []
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (300 * own[0] + 200 * own[1]) / 500
    for c in (0, 1):
        cov = 0.8 * own[c] + 0.2 * pooled
        cov = 0.98 * cov + 0.02 * np.trace(cov) / d * np.eye(d)
        gap = z - z[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == c).mean()))
    direct = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = {q.doc_id: q for q in quality.score(rows, model).collect()}
    assert np.allclose([got[i].score for i in range(500)], direct, atol=1e-9)
    assert all(q.predicted == int(q.score >= 0.5) for q in got.values())


def test_odd_rows_and_labels(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, words(20_000, 1)), (5, "x " * 50), (5, "x " * 50), (None, "no id"), (6, "🙂" * 9), (7, "\n\n"), (8, "%%% &&&")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.classify(docs(spark, rows).limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs(spark, rows), labels.where("quality = 1")).collect()} == {1.0}


def test_held_out_labels_are_not_seen(spark):
    documents = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("quality", (quality.held_out(labels.doc_id).cast("int") + labels.quality * (1 - 2 * quality.held_out(labels.doc_id).cast("int"))))
    a, b = (quality.classify(documents, x).collect() for x in (labels, flipped))
    assert np.allclose([r.score for r in sorted(a, key=lambda r: r.doc_id)], [r.score for r in sorted(b, key=lambda r: r.doc_id)], atol=1e-9)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = queries.op6_quality(spark, SF01).collect()
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    own = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, y in own if y == 1], [s for s, _, y in own if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.98
    assert np.mean([p == y for _, p, y in own]) > 0.97


@pytest.mark.parametrize("text", ["", " ", "\n", "a", "é" * 100_000, "!" * 1000])
def test_statistics_are_finite(text):
    x = quality.describe(text)
    assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()
