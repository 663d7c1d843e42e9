"""Approximate nearest neighbours by inner product (operator 9).

Method: hierarchical k-means tree with best-bin-first traversal.  The tree is fitted on a bounded
sample of the distinct vectors and every vector is put into a leaf.  A query keeps the nodes it has
seen in a priority queue, by the inner product with their centres; it opens the best one, again and
again, and visits the leaves that come out.  How many leaves a query visits is calibrated: for a
bounded sample of queries the true neighbours are found by comparing with all vectors, and the
number of visits is widened until the share of true neighbours in visited leaves reaches a target.

Equal vectors are indexed once, with as many of their smallest ids as a result can hold.  Leaves that
lie beside each other are searched together, so a query travels once to a group of leaves, however
many of them it visits.  A leaf with very many vectors is searched in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
neither do rows with a null id, nor vectors whose length is not the most frequent one; repeated
rows with the same id and vector count once; equal scores are ordered by the smaller id; a query
with fewer candidates than asked for gets all of them; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, prepare, stash

#: Bounds of the fit: distinct vectors it sees, queries it calibrates with, ways of a node.
SAMPLE, CALIBRATION, WAYS = 20_000, 256, 16
#: Vectors that are searched together: at least, where there are so many, and at most; components they may have.
BLOCK, MOST_BLOCK, BLOCK_CELLS = 4096, 1 << 15, 1 << 21
#: Numbers that a task computes or sends on at once: scores of queries, components of the vectors of their visits.
CELLS = 1 << 20
#: Vectors of a leaf that the fit aims at, and the least share of them a leaf must have in the sample.
LEAF, LEAST_SAMPLED = 400, 8


def vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: the rows that take part, ``v`` as little-endian doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fit)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [np.asarray(x, dtype="<f8").tobytes() for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    out = stash(arrow_map(rows, pack, "vec_id long, v binary").distinct(), "vectors")
    usual = out.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return out if usual is None else out.where(F.length("v") == usual["size"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


@dataclass
class Tree:
    """Nodes by number; ``children`` of inner nodes, ``leaf`` numbers of the others (else -1)."""

    centers: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, center: np.ndarray, least: int, r: np.random.Generator) -> int:
        at = len(self.centers)
        self.centers.append(center)
        self.children.append([])
        self.leaf.append(-1)
        groups = kmeans(x, WAYS, r) if len(x) > least else []
        if len(groups) < 2:
            self.leaf[at] = self.leaves
            self.leaves += 1
        else:
            self.children[at] = [self.grow(x[own], c, least, r) for own, c in groups]
        return at

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: from the root to the nearest centre, level by level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = np.stack([self.centers[k] for k in self.children[node]])
            best = np.argmin((c * c).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
            todo += [(k, rows[best == i]) for i, k in enumerate(self.children[node]) if (best == i).any()]
        return out

    def order(self, scores: np.ndarray, most: int) -> list[int]:
        """The first leaves a query visits; ``scores`` has its inner products with all centres."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for k in self.children[node]:
                heapq.heappush(queue, (-scores[k], k))
        return out


def kmeans(x: np.ndarray, ways: int, r: np.random.Generator, rounds: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, centre) of each group that is not empty."""
    c = x[r.choice(len(x), min(ways, len(x)), replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
        c = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
    return [(np.flatnonzero(own == k), c[k]) for k in range(len(c)) if (own == k).any()]


def _ranked(rows: DataFrame, by: list, most: int, *order) -> DataFrame:
    """The first ``most`` rows of each group; Spark cuts them down before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def _best(ids: np.ndarray, least: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, equal ones by the smaller least id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((least[some], -scores[some]))[:k]]


def _groups(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first group of each leaf, its groups, and the number of all groups: leaves in turn share one of ``most`` vectors, a larger leaf
    is dealt out to several."""
    first, blocks, room, groups = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes):
        if n > room or not groups:
            blocks[leaf] = max(1, -(-n // most))
            groups, room = groups + int(blocks[leaf]), most if n <= most else 0
        first[leaf] = groups - blocks[leaf]
        room = max(room - n, 0)
    return first, blocks, max(groups, 1)


def _parts(batch: pa.RecordBatch, cells: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at a time that ``cells`` numbers for each make ``CELLS``, one at least."""
    step = max(1, CELLS // max(cells, 1))
    return (batch.slice(low, step) for low in range(0, batch.num_rows, step))


def nearest(df: DataFrame, k: int = 20, query_every: int = 20, recall: float = 0.97, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``query_every``, the ``k`` rows found with
    the largest inner products, its own id excepted.  ``recall`` is the share of true neighbours that the calibration asks for.

    The fit sees ``SAMPLE`` vectors and the calibration ``CALIBRATION`` queries, chosen by a hash; all other work covers all rows.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = vectors(df, vec_id, vector)
    most = k + 1  # the query's own id is among the results until the end
    members = _ranked(rows, ["v"], most, F.col("vec_id"))
    distinct = stash(members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    n = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = np.frombuffer(b"".join(r.v for r in distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()), "<f8").reshape(min(n, SAMPLE), -1)
    tree = Tree()
    tree.grow(sample, sample.mean(axis=0), max(LEAST_SAMPLED, LEAF * len(sample) // n), np.random.default_rng(7))
    centers = np.stack(tree.centers)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf = tree.place(_matrix(batch.column(0)))
        return pa.record_batch([pa.array(leaf, pa.int32()), *batch.columns], names=["leaf", "v", "ids"])

    index = stash(arrow_map(distinct, place, "leaf int, v binary, ids array<long>"), "index")
    queries = rows.where(F.col("vec_id") % query_every == 0)
    asked = stash(queries.groupBy("v").agg(F.min("vec_id").alias("q")), "asked")  # equal queries are asked once, under their smallest id
    visits = _calibrate(index, asked, tree, centers, most, recall)

    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    dims, slots = sample.shape[1], spark.sparkContext.defaultParallelism
    first, blocks, groups = _groups([sizes.get(leaf, 0) for leaf in range(tree.leaves)], max(1, min(MOST_BLOCK, BLOCK_CELLS // dims, max(BLOCK, n // (4 * slots)))))

    def visit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # a batch holds thousands of queries, and each goes with its vector to all groups it visits
        for some in _parts(batch, max(len(centers), visits + dims * min(visits, groups))):
            number, group, leaves = [], [], []
            for i, scores in enumerate((_matrix(some.column(0)) @ centers.T).tolist()):
                leaf = np.sort(np.array(tree.order(scores, visits), np.int32))
                at = np.repeat(first[leaf] - np.cumsum(blocks[leaf]) + blocks[leaf], blocks[leaf]) + np.arange(blocks[leaf].sum())
                leaf = np.repeat(leaf, blocks[leaf])
                order = np.argsort(at, kind="stable")
                at, leaf = at[order], leaf[order]
                edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                number += [i] * len(edges)
                group += at[edges].tolist()
                leaves += [x.astype("<i4").tobytes() for x in np.split(leaf, edges[1:])]
            take = pa.array(number, pa.int64())
            yield pa.record_batch({"group": pa.array(group, pa.int32()), "v": some.column(0).take(take), "q": some.column(1).take(take), "leaves": pa.array(leaves, pa.binary())})

    of = spark.createDataFrame([(leaf, int(first[leaf]), int(blocks[leaf])) for leaf in range(tree.leaves)], "of int, first int, blocks int")
    none = F.array().cast("array<bigint>")
    stored = index.join(F.broadcast(of), F.col("leaf") == F.col("of")).select(
        (F.col("first") + F.pmod(F.xxhash64("v"), F.col("blocks"))).cast("int").alias("group"), F.lit(0).alias("kind"), "leaf", "v", "ids", F.lit(0).cast("long").alias("q"), F.lit(b"").alias("leaves"))
    wanted = arrow_map(asked, visit, "group int, v binary, q long, leaves binary").select("group", F.lit(1).alias("kind"), F.lit(-1).alias("leaf"), "v", none.alias("ids"), "q", "leaves")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x, leaf_of, ids, least = None, [], None, None, None, None
        for batch in batches:
            group, kind = (batch.column(i).to_numpy() for i in range(2))
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])]).tolist()
            for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
                part = batch.slice(a, b - a)
                if group[a] != key:
                    key, held, x = group[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:
                    x, leaf_of = np.concatenate([_matrix(h.column(3)) for h in held]), np.concatenate([h.column(2).to_numpy() for h in held])
                    ids = [i for h in held for i in h.column(4).to_pylist()]
                    least = np.array([i[0] for i in ids])
                    held = held[:1]
                for some in _parts(part, len(x)):
                    q, vectors_ = some.column(5).to_numpy(), _matrix(some.column(3))
                    visited = [np.isin(leaf_of, np.frombuffer(raw, "<i4")) for raw in some.column(6).to_pylist()]
                    many = sum(map(np.count_nonzero, visited)) * 4 > len(x) * len(q)
                    scores = vectors_ @ x.T if many else None
                    best, values = [], []
                    for i, own in enumerate(visited):
                        own = np.flatnonzero(own)
                        found = scores[i, own] if many else x[own] @ vectors_[i]
                        top = _best(ids, least[own], found, most)
                        best.append(own[top])
                        values.append(found[top])
                    flat = np.concatenate(best)
                    yield pa.record_batch([pa.array(np.repeat(q, [len(t) for t in best]), pa.int64()), pa.array(np.concatenate(values), pa.float64()),
                                           pa.array(least[flat], pa.int64()), pa.array([ids[i] for i in flat], pa.list_(pa.int64()))],
                                          names=["q", "score", "least", "ids"])

    pairs = stored.union(wanted).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind")
    found = pairs.mapInArrow(search, "q long, score double, least long, ids array<long>")
    found = _ranked(found, ["q"], most, F.desc("score"), F.col("least")).select("q", "score", F.explode("ids").alias("found"))
    found = _ranked(found, ["q"], most, F.desc("score"), F.col("found")).select("q", "score", "found")
    answers = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("found")))).alias("a"))
    answers = asked.join(answers, "q").select("v", "a")
    own = queries.select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    a = F.slice(F.filter("a", lambda x: x["found"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(a).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.found").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _calibrate(index: DataFrame, asked: DataFrame, tree: Tree, centers: np.ndarray, most: int, recall: float) -> int:
    """Leaves to visit, so that sampled queries have ``recall`` of their true neighbours in them."""
    some = [r.v for r in asked.select("v").orderBy(F.xxhash64("v", F.lit(1)), "v").limit(CALIBRATION).collect()]
    if not some or tree.leaves == 1:
        return 1
    q = np.frombuffer(b"".join(some), "<f8").reshape(len(some), -1)

    def compare(batch: pa.RecordBatch) -> pa.Table:
        leaf = batch.column(0).to_numpy()
        scores = q @ _matrix(batch.column(1)).T
        best = [_best(leaf, leaf, s, most) for s in scores]
        number = np.repeat(np.arange(len(best)), [len(b) for b in best])
        flat = np.concatenate(best)
        return pa.table({"q": pa.array(number, pa.int32()), "score": pa.array(scores[number, flat], pa.float64()), "leaf": pa.array(leaf[flat], pa.int32())})

    true = _ranked(arrow_map(index.select("leaf", "v"), compare, "q int, score double, leaf int"), ["q"], most, F.desc("score")).select("q", "leaf").collect()
    own: list[list[int]] = [[] for _ in some]
    for r in true:
        own[r.q].append(r.leaf)
    needed = []
    for vector, leaves in zip(q, own, strict=True):  # one query at a time: its order names all leaves
        turn = {leaf: t for t, leaf in enumerate(tree.order((vector @ centers.T).tolist(), tree.leaves))}
        needed += [turn[leaf] for leaf in leaves]
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
