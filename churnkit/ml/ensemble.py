"""Fitted models as flat arrays, scored in Arrow batches.

A tree ensemble is five arrays over all nodes of all trees; a linear model is one vector.  Their size is that of the
model, whatever the data; they reach the executors as one broadcast, and any number of models is evaluated in a single
pass over the rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.ml.features import Encoder, Rows
from churnkit.sources import artifacts


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


@dataclass
class Trees:
    """Boosted trees (their values add up to log-odds on top of ``base``) or a forest (the mean of their values is the probability).

    ``feature`` is the tested slot, -1 in leaves; a row goes left if its code is at most ``cut``; children of a node are ``left`` and
    ``left + 1``.  ``cover`` is the training weight that reached a node.
    """

    encoder: Encoder
    boosted: bool
    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @property
    def linear(self) -> bool:
        return False

    def lean(self) -> Trees:
        """What scoring needs."""
        return replace(self, cover=np.zeros(0))

    def leaves(self, codes: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
        """The leaf each row reaches in each tree."""
        node = np.broadcast_to((self.roots if roots is None else roots)[None, :], (len(codes), len(self.roots if roots is None else roots))).astype(np.int32)
        flat, begin = codes.ravel(), (np.arange(len(codes)) * codes.shape[1])[:, None]
        at = np.arange(node.size)
        node = node.ravel()
        row = np.broadcast_to(begin, (len(codes), node.size // max(len(codes), 1))).ravel() if len(codes) else np.zeros(0, np.int64)
        while len(at):
            own = node[at]
            f = self.feature[own]
            inner = f >= 0
            at, own, f = at[inner], own[inner], f[inner]
            node[at] = self.left[own] + (flat[row[at] + f] > self.cut[own])
        return node.reshape(len(codes), -1)

    def margin(self, rows: Rows) -> np.ndarray:
        codes = rows.codes()
        total = np.zeros(len(codes))
        for low in range(0, len(codes), 2048):
            own = codes[low:low + 2048]
            total[low:low + 2048] = self.value[self.leaves(own)].sum(axis=1)
        return self.base + total if self.boosted else total / max(len(self.roots), 1)

    def probability(self, rows: Rows) -> np.ndarray:
        m = self.margin(rows)
        return logistic(m) if self.boosted else m


TREE_ROWS = "tree int, feature binary, cut binary, `left` binary, value binary, cover binary, piece int"
#: Nodes of a forest that are sent to the executors at once.
MODEL_NODES = 1 << 22


def joined_trees(encoder: Encoder, boosted: bool, base: float, rows: list[tuple]) -> Trees:
    """Trees from rows of :data:`TREE_ROWS`; without a piece a row is a whole tree.  A piece's root takes the place of the leaf that names it.
    Where the piece is not among the rows, that leaf stays, and is worth nothing."""
    rows = sorted(rows, key=lambda r: (r[0], r[6] if len(r) > 6 else 0))
    numbers = [r[6] if len(r) > 6 else 0 for r in rows]
    kinds = ((1, "<i2", np.int16), (2, "u1", np.uint8), (3, "<i4", np.int32), (4, "<f8", np.float64), (5, "<f8", np.float64))
    parts = [[np.frombuffer(r[k], kind) for r in rows] for k, kind, _ in kinds]
    # of a piece, the root moves into the tree above
    sizes = np.array([len(x) - (number > 0) for x, number in zip(parts[0], numbers, strict=True)], np.int64)
    begin = np.cumsum(sizes) - sizes
    feature, cut, left, value, cover = (np.concatenate([x[number > 0:] for x, number in zip(own, numbers, strict=True)]).astype(kind, copy=False) if own else np.zeros(0, kind)
                                        for own, (_, _, kind) in zip(parts, kinds, strict=True))
    shift = np.repeat(begin - (np.array(numbers, np.int64) > 0), sizes).astype(np.int32)
    linked = np.flatnonzero((feature < 0) & (left > 0))
    named = dict(zip(zip(np.searchsorted(begin, linked, "right").tolist(), left[linked].tolist(), strict=True), linked.tolist(), strict=True)) if len(linked) else {}
    left[feature >= 0] += shift[feature >= 0]
    left[linked] = 0
    top = -1
    for i, number in enumerate(numbers):
        if not number:
            top = i
            continue
        at = named[top + 1, number]
        for whole, own in zip((feature, cut, value, cover), (parts[k] for k in (0, 1, 3, 4)), strict=True):
            if len(own[i]):
                whole[at] = own[i][0]
        left[at] = parts[2][i][0] + begin[i] - 1 if parts[0][i][0] >= 0 else 0
    roots = begin[np.array(numbers, np.int64) == 0]
    return Trees(encoder, boosted, base, roots.astype(np.int32), feature, cut, left, value, cover)


@dataclass
class Linear:
    """Logistic regression over the standardised slots; ``center`` holds the training means of the slots."""

    encoder: Encoder
    weights: np.ndarray
    intercept: float
    center: np.ndarray

    @property
    def linear(self) -> bool:
        return True

    def lean(self) -> Linear:
        return self

    def margin(self, rows: Rows) -> np.ndarray:
        return Rows(self.encoder, rows.num, rows.level).values() @ self.weights + self.intercept

    def probability(self, rows: Rows) -> np.ndarray:
        return logistic(self.margin(rows))


Model = Trees | Linear


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Write a model: its arrays, then a description, whose presence says that the model is complete."""
    if isinstance(model, Trees):
        data = io.BytesIO()
        np.savez_compressed(data, roots=model.roots, feature=model.feature, cut=model.cut, left=model.left, value=model.value, cover=model.cover)
        artifacts.write_bytes(spark, f"{path}/trees.npz", data.getvalue())
        describe(spark, model.encoder, path, boosted=model.boosted, base=model.base)
    else:
        describe(spark, model.encoder, path, weights=model.weights.tolist(), intercept=model.intercept, center=model.center.tolist())


def describe(spark: SparkSession, encoder: Encoder, path: str, **kind) -> None:
    artifacts.write_bytes(spark, f"{path}/model.json", json.dumps({"encoder": encoder.to_json(), **kind}).encode())


def saved(spark: SparkSession, path: str) -> bool:
    return artifacts.path_exists(spark, f"{path}/model.json")


def load(spark: SparkSession, path: str) -> Model:
    d = json.loads(artifacts.read_bytes(spark, f"{path}/model.json"))
    encoder = Encoder.from_json(d["encoder"])
    if "weights" in d:
        return Linear(encoder, np.array(d["weights"]), d["intercept"], np.array(d["center"]))
    if "table" not in d:
        x = np.load(io.BytesIO(artifacts.read_bytes(spark, f"{path}/trees.npz")))
        return Trees(encoder, d["boosted"], d["base"], *(x[c] for c in ("roots", "feature", "cut", "left", "value", "cover")))
    # a forest: a table with a row for each tree of several fits, or for each piece of one
    return _read(spark, d, encoder)


def _read(spark: SparkSession, d: dict, encoder: Encoder, low: tuple[int, int] | None = None, high: tuple[int, int] | None = None) -> Trees:
    """A forest, or what lies from piece ``low`` to piece ``high`` of it, without what only explanations need.  The upper nodes of a tree whose
    later pieces alone are read lead to these, but their own leaves are worth nothing."""
    names = ["tree", "feature", "cut", "left", "value", "cover", "piece"]
    trees = spark.read.parquet(d["table"]).where(F.col("fit") == d["fit"])
    if low:
        after = (F.col("tree") > low[0]) | ((F.col("tree") == low[0]) & ((F.col("piece") >= low[1]) | (F.col("piece") == 0)))
        before = (F.col("tree") < high[0]) | ((F.col("tree") == high[0]) & (F.col("piece") <= high[1]))
        trees = trees.where(after & before).withColumn("cover", F.lit(b""))
    trees = trees.select(names).toArrow()
    rows = list(zip(*(trees.column(n).to_pylist() for n in names), strict=True))
    if low and low[1]:
        rows = [r if (r[0], r[6]) != (low[0], 0) else (*r[:4], bytes(len(r[4])), *r[5:]) for r in rows]
    found = joined_trees(encoder, d["boosted"], d["base"], rows)
    return found.lean() if low else found


def slices(spark: SparkSession, path: str) -> Iterator[tuple[Trees, int]]:
    """A forest by and by: trees of :data:`MODEL_NODES` nodes together, unless a single piece has more, and the number of trees in all.  What
    rows reach in all slices adds up to what they reach in the forest: a leaf is worth something in one slice only."""
    d = json.loads(artifacts.read_bytes(spark, f"{path}/model.json"))
    encoder = Encoder.from_json(d["encoder"])
    sizes = spark.read.parquet(d["table"]).where(F.col("fit") == d["fit"]).select("tree", "piece", F.octet_length("cut").alias("nodes")).collect()
    lots, room = [], 0
    for r in sorted(sizes, key=lambda r: (r["tree"], r["piece"])):
        if r["nodes"] > room or not lots:
            lots.append([])
            room = MODEL_NODES
        room -= r["nodes"]
        lots[-1].append((r["tree"], r["piece"]))
    for own in lots:
        yield _read(spark, d, encoder, own[0], own[-1]), len({r["tree"] for r in sizes})


def batch_rows(encoder: Encoder, columns: list[pd.Series]) -> Rows:
    """Feature rows of the pandas columns a vectorised function receives, in the encoder's order."""
    return encoder.read({c: pa.Array.from_pandas(s) for c, s in zip(encoder.columns, columns, strict=True)})


def evaluate(df: DataFrame, encoder: Encoder, function, sent) -> Column:
    """``array<double>`` column: ``function(sent.value, rows)`` for each Arrow batch, one pass whatever it evaluates.  ``sent`` is a broadcast
    of what the function needs."""

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        found = function(sent.value, batch_rows(encoder, list(columns)))
        return pd.Series(list(np.asarray(found, dtype=float)))

    return run(*[F.col(c) for c in encoder.columns])
