"""Nearest neighbours: exact where all leaves are visited, recall against brute force, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from churnkit.llm import ann, queries

SF01 = "/root/testdata/sf0.01"


def brute(rows, k=20, every=20):
    good, seen = [], set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        good.append((i, np.array(v, dtype=np.float64)))
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted(((-float(v @ w), j) for j, w in good if j != i))[:k]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist()) for i in range(300)]
    rows += [(400, None), (420, [0.0] * 6), (440, [None] + [1.0] * 5), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, []), (None, [1.0] * 6)]
    rows += [(i, [2.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(600, 700)] + [(600, [2.0, 1.0, 0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "2 AS rank", "'x' AS v")
    got, want = as_dict(ann.nearest(df, recall=1.0).collect()), brute(rows)
    assert set(got) == set(want)
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) > 0.95
    assert [j for _, j in got[600]] == [j for _, j in want[600]] and 600 not in [j for _, j in got[600]]  # ties to smaller ids
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert as_dict(ann.nearest(few).collect()) == {0: [(-0.5, 1), (1.0, 2)]}


@pytest.mark.parametrize("block", [64, 4096])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(500)]
    monkeypatch.setattr(ann, "LEAF", 10**6)  # one leaf: the search is exact
    got, want = as_dict(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), brute(rows)
    assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in want.items()}
    assert all(np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12) for q in want)


def test_recall_of_the_query(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 20)  # many leaves
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got, want = as_dict(queries.op9_ann(spark, SF01).collect()), brute(rows)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 20 for q in want]) >= 0.9


def test_leaves_share_groups_and_large_ones_are_dealt_out():
    first, blocks, groups = ann._groups([3, 4, 5, 25, 0, 10, 1], 10)
    assert first.tolist() == [0, 0, 1, 2, 4, 5, 6] and blocks.tolist() == [1, 1, 1, 3, 1, 1, 1] and groups == 7
    assert ann._groups([], 10)[2] == 1


def test_a_batch_of_queries_is_taken_in_parts(spark, monkeypatch):
    """Neither the scores of a whole batch nor the vectors of all its visits are held at once, and a query travels once to a group."""
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for most, cells in ((ann.MOST_BLOCK, ann.CELLS), (100, 500)):
        monkeypatch.setattr(ann, "MOST_BLOCK", most)
        monkeypatch.setattr(ann, "CELLS", cells)
        got, want = as_dict(ann.nearest(df, recall=1.0).collect()), brute(rows)
        assert set(got) == set(want)
        assert all([j for _, j in got[q]] == [j for _, j in want[q]] for q in want)
    batch = pa.record_batch({"x": pa.array(range(1000))})
    assert [len(p) for p in ann._parts(batch, 200)] == [2] * 500 and [len(p) for p in ann._parts(batch, 10_000)] == [1] * 1000
