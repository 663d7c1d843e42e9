"""Second-order histogram boosting.

Every round adds a tree to each of several fits at once.  For one level of all these trees, a task sums gradients,
hessians and row counts of its blocks into cells (fit, node, slot, bin); the driver adds the tasks' sums, whose size is that of
the trees and bins, and picks each node's best cut.  Of two siblings only the one with fewer rows is summed, the other
is the parent less it.  All nodes up to the depth limit are grown level by level; where the number of leaves is limited, the
tree is then cut back to what growing the best leaf first would have made, which is the same because a leaf's gain depends on no other leaf.

Margins of all fits are kept in the blocks.  Every round adds its trees once, to a table held by the executors, and every ``REFRESH``
rounds that table is written to the shared folder, which cuts the lineage.  The written one and the trees so far are also where a run
that was stopped goes on.
"""

from __future__ import annotations

import io
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from churnkit.ml import blocks as B
from churnkit.ml.ensemble import Trees, joined_trees, logistic
from churnkit.ml.features import LEVEL_BINS, NUMERIC_BINS, Encoder
from churnkit.sources import artifacts

REFRESH = 5
#: Tasks whose sums the driver adds itself; more are first added in as many tasks as the square root of their number.
DIRECT_TASKS = 32


@dataclass(frozen=True)
class Boosted:
    """Sizes and regularisation of a booster.  ``l2`` is added to the hessians; a child needs ``least_hessian`` and ``least_rows``;
    ``sampling`` is the share of rows, drawn by hash anew each round; ``positive_weight`` weighs rows of class 1."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.03
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    leaves: int = 0
    sampling: float = 1.0
    positive_weight: float = 1.0


@dataclass
class Job:
    """One fit of one booster."""

    name: str
    fit: int
    sizes: Boosted


class Cells:
    """Flat numbering of (slot, bin)."""

    def __init__(self, encoder: Encoder) -> None:
        self.numeric = len(encoder.numeric)
        sizes = np.array([NUMERIC_BINS] * self.numeric + [LEVEL_BINS] * (encoder.width - self.numeric), np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.n = int(sizes.sum())
        self.slot = np.repeat(np.arange(len(sizes)), sizes)
        self.bin = np.arange(self.n) - self.begin[self.slot]

    def add(self, total: np.ndarray, part: Part, on: np.ndarray, node: np.ndarray, stats: np.ndarray) -> None:
        """Add the statistics ``(3, rows)`` of rows ``on`` of a block to the cells of their nodes."""
        nodes, n = len(total), part.codes.shape[1]
        for k in range(self.numeric):
            key = node * NUMERIC_BINS + part.codes[k][on]
            begin = self.begin[k]
            for i in range(3):
                total[:, i, begin:begin + NUMERIC_BINS] += np.bincount(key, stats[i], minlength=nodes * NUMERIC_BINS).reshape(nodes, -1)
        if self.n == self.numeric * NUMERIC_BINS:
            return
        # levels: a product with the indicators of the last bin; what is left is the first bin, or, in made rows, one between
        own = np.zeros((nodes * 3, n))
        for i in range(3):
            own[node * 3 + i, on] = stats[i]
        found = (own @ part.last_bins(self.numeric).T).reshape(nodes, 3, -1)
        view = total[:, :, self.numeric * NUMERIC_BINS:].reshape(nodes, 3, -1, LEVEL_BINS)
        view[..., LEVEL_BINS - 1] += found
        rest = own.sum(axis=1).reshape(nodes, 3, 1) - found
        if part.made:
            cell, row = part.between(self.numeric)
            at = np.full(n, -1)
            at[on] = node
            some = at[row] >= 0
            cell, row = cell[some], row[some]
            place, levels = at[row], found.shape[2]
            for i in range(3):
                part_sum = np.bincount(place * (levels * LEVEL_BINS) + cell, own[place * 3 + i, row], minlength=nodes * levels * LEVEL_BINS).reshape(nodes, levels, LEVEL_BINS)
                view[:, i] += part_sum
                rest[:, i] -= part_sum.sum(axis=2)
        view[..., 0] += rest
        total[:, :, self.numeric * NUMERIC_BINS:] = view.reshape(nodes, 3, -1)


class Growing:
    """A tree being grown, in level order: parallel lists of its nodes."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.stats, self.gain, self.parent = [-1], [0], [0], [None], [0.0], [-1]

    def split(self, node: int, slot: int, cut: int, gain: float, left, right) -> None:
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = slot, cut, len(self.feature), gain
        for s in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.stats.append(s)
            self.gain.append(0.0)
            self.parent.append(node)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int32)

    def best_first(self, leaves: int) -> None:
        """Keep the splits that growing the leaf of the highest gain first, up to ``leaves`` leaves, would have made."""
        if not leaves or self.feature.count(-1) <= leaves:
            return
        import heapq

        kept, open_ = set(), [(-self.gain[0], 0)]
        while open_ and len(kept) + 1 < leaves:
            _, node = heapq.heappop(open_)
            kept.add(node)
            for child in (self.left[node], self.left[node] + 1):
                if self.feature[child] >= 0:
                    heapq.heappush(open_, (-self.gain[child], child))
        order, new = [0], {0: 0}
        for node in order:
            if node in kept:
                for child in (self.left[node], self.left[node] + 1):
                    new[child] = len(order)
                    order.append(child)
        old = self.__dict__.copy()
        self.feature = [old["feature"][k] if k in kept else -1 for k in order]
        self.cut, self.stats, self.gain = ([old[c][k] for k in order] for c in ("cut", "stats", "gain"))
        self.left = [new[old["left"][k]] if k in kept else 0 for k in order]


def stops(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, node: int = 0):
    """The node of one small tree that each row stops in; ``codes`` has a row for each slot.  Both sides of a node are evaluated for all rows and
    the test's bits pick, which for trees of a few levels is less work than following rows, or than picking by branches."""
    kind = np.uint8 if len(feature) <= 256 else np.uint16 if len(feature) <= 1 << 16 else np.uint32
    feature, cut, left = feature.tolist(), cut.tolist(), left.tolist()

    def walk(node: int):
        if feature[node] < 0:
            return kind(node)
        low, high = walk(left[node]), walk(left[node] + 1)
        mask = np.negative((codes[feature[node]] > cut[node]).view(np.uint8).astype(kind, copy=False))
        mask &= low ^ high
        mask ^= low
        return mask

    return walk(node)


def reached(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, node: int = 0):
    """``value`` of the node of one small tree that each row stops in."""
    return value[stops(codes, feature, cut, left, node)]


def best_cuts(cells: Cells, sums: np.ndarray, sizes: list[Boosted]) -> tuple[np.ndarray, ...]:
    """For sums ``(nodes, 3, cells)`` of gradients, hessians and rows: the gain, slot, cut and left sums of each node's best cut; the gain
    is not positive where no cut helps."""
    total = sums[:, :, cells.slot == 0].sum(axis=2)
    left = np.empty_like(sums)
    for begin, size, count in ((0, NUMERIC_BINS, cells.numeric), (cells.numeric * NUMERIC_BINS, LEVEL_BINS, (cells.n - cells.numeric * NUMERIC_BINS) // LEVEL_BINS)):
        end = begin + size * count
        shape = (*sums.shape[:2], count, size)
        left[:, :, begin:end] = sums[:, :, begin:end].reshape(shape).cumsum(axis=3).reshape(*sums.shape[:2], -1)
    right = total[:, :, None] - left
    l2 = np.array([s.l2 for s in sizes])[:, None]
    hessian, rows = np.array([s.least_hessian for s in sizes])[:, None], np.array([s.least_rows for s in sizes])[:, None]
    score = lambda g, h: g * g / np.maximum(h + l2, 1e-12)
    gain = score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(total[:, :1], total[:, 1:2])
    fair = (left[:, 1] >= hessian) & (right[:, 1] >= hessian) & (left[:, 2] >= rows - 0.5) & (right[:, 2] >= rows - 0.5)
    gain = np.where(fair, gain, -np.inf)
    best = np.argmax(np.round(gain, 9), axis=1)
    at = np.arange(len(sums))
    return gain[at, best], cells.slot[best], cells.bin[best], left[at, :, best], total


def sampled(n: int, block: int, round_: int, share: float, seed: int) -> np.ndarray:
    """Rows of a block that take part in a round."""
    return np.random.default_rng([seed, round_, block]).random(n) < share


@dataclass
class Part:
    """A block as boosting sees it: codes with a row for each slot, and the margins of the jobs that use it."""

    codes: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    fit: np.ndarray
    jobs: list[int]
    margins: np.ndarray
    made: bool
    _last: np.ndarray | None = None
    _between: tuple[np.ndarray, np.ndarray] | None = None

    def used(self, job: Job) -> np.ndarray:
        """Rows that a job learns from."""
        return self.fit == job.fit if self.made else self.fold != job.fit

    def last_bins(self, numeric: int) -> np.ndarray:
        """Indicators of the last bin of each level's slot, once for all jobs."""
        if self._last is None:
            self._last = (self.codes[numeric:] == LEVEL_BINS - 1).astype(np.float64)
        return self._last

    def between(self, numeric: int) -> tuple[np.ndarray, np.ndarray]:
        """(place among the levels' cells, row) of the codes that are neither the first bin nor the last, once for all jobs."""
        if self._between is None:
            levels = self.codes[numeric:].ravel()
            at = np.flatnonzero((levels > 0) & (levels < LEVEL_BINS - 1))
            slot, row = np.divmod(at, self.codes.shape[1])
            self._between = slot * LEVEL_BINS + levels[at], row
        return self._between


STATE = "n int, codes binary, y binary, fold binary, fit binary, jobs array<int>, margins binary"
_STATE = [x.split()[0] for x in STATE.split(", ")]


def parts(record: pa.RecordBatch) -> Iterator[Part]:
    for n, codes, y, fold, fit, jobs, margins in zip(*(record.column(c).to_pylist() for c in _STATE), strict=True):
        fit = np.frombuffer(fit, "i1")
        yield Part(np.frombuffer(codes, "u1").reshape(-1, n), np.frombuffer(y, "u1"), np.frombuffer(fold, "i1"), fit, jobs,
                   np.frombuffer(margins, "<f8").reshape(len(jobs), n), bool(n and fit[0] != B.EVERY))


class Booster:
    """Trains several fits in lockstep over blocks; ``folder`` holds the margins and the trees of a stopped run."""

    def __init__(self, spark: SparkSession, table: DataFrame, encoder: Encoder, jobs: list[Job], folder: str, seed: int) -> None:
        self.spark, self.encoder, self.jobs, self.folder, self.seed = spark, encoder, jobs, folder, seed
        self.cells, self.table = Cells(encoder), table
        self.trees: list[list[tuple]] = [[] for _ in jobs]  # per job, (feature, cut, left, value, cover)
        self.rounds = max(j.sizes.rounds for j in jobs)

    # --- passes over the blocks -----------------------------------------------------------

    def _starts(self) -> np.ndarray:
        """Log-odds of each fit's weighted training rows."""
        jobs, encoder = self.jobs, self.encoder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(jobs), 2))
            for b in batches:
                for block in B.unpacked(encoder, b):
                    for m, job in enumerate(jobs):
                        w = block.used(job.fit) * np.where(block.y == 1, job.sizes.positive_weight, 1.0)
                        total[m] += w @ block.y, w.sum()
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        total = sum((np.frombuffer(x, "<f8").reshape(-1, 2) for x in self.table.mapInArrow(run, "sums binary").toArrow().column(0).to_pylist()), np.zeros((len(jobs), 2)))
        share = np.clip(total[:, 0] / np.maximum(total[:, 1], 1e-12), 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def _begun(self, starts: np.ndarray) -> DataFrame:
        """The blocks with codes and first margins, dealt out evenly to the task slots where they are few: a given block serves most jobs, a made
        one only those of its fit, so tasks of one kind would wait for the others in every level."""
        encoder, jobs = self.encoder, self.jobs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block in B.unpacked(encoder, b):
                    own = [m for m, j in enumerate(jobs) if block.used(j.fit).any()]
                    margins = np.repeat(starts[own, None], len(block.y), axis=1)
                    columns = [[len(block.y)], [np.ascontiguousarray(block.rows.codes().T).tobytes()], [block.y.tobytes()], [block.fold.tobytes()], [block.fit.tobytes()], [own], [margins.tobytes()]]
                    kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.binary()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_STATE)

        slots = self.spark.sparkContext.defaultParallelism
        table = self.table.repartition(slots) if self.tasks <= 2 * slots else self.table
        return self._written(table.mapInArrow(run, STATE), 0)

    def _advanced(self, state: DataFrame, latest: list[list[tuple]]) -> DataFrame:
        """The state with the margins that the latest trees give."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                margins = [added(part, latest).tobytes() for part in parts(b)]
                yield pa.record_batch([*b.columns[:-1], pa.array(margins, pa.binary())], names=_STATE)

        return state.mapInArrow(run, STATE)

    def _written(self, state: DataFrame, round_: int) -> DataFrame:
        state.write.mode("overwrite").parquet(f"{self.folder}/margins-{round_}")
        return self._held(round_)

    def _held(self, round_: int) -> DataFrame:
        state = self.spark.read.schema(STATE).parquet(f"{self.folder}/margins-{round_}").persist()
        self.tasks = state.rdd.getNumPartitions()
        return state

    def _level(self, state: DataFrame, since, growing, wanted: list[list[int]], round_: int) -> list[np.ndarray]:
        """Sums ``(nodes, 3, cells)`` of the wanted nodes of each job."""
        cells, jobs, seed = self.cells, self.jobs, self.seed
        shape = [(len(w), 3, cells.n) for w in wanted]
        # wanted nodes by place, others -1
        place = [np.array([w.index(k) if k in w else -1 for k in range(max(len(g[0]) if g else 1, 1))]) for g, w in zip(growing, wanted, strict=True)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(s) for s in shape]
            for b in batches:
                for part in parts(b):
                    margins = added(part, since)
                    for k, m in enumerate(part.jobs):
                        if not wanted[m]:
                            continue
                        n, used = len(part.y), part.used(jobs[m])
                        node = reached(part.codes, *growing[m], place[m]) if growing[m] else np.zeros(n, np.int64)
                        if growing[m]:
                            used &= node >= 0
                        if jobs[m].sizes.sampling < 1:
                            used &= sampled(n, block_number(part), round_, jobs[m].sizes.sampling, seed)
                        on = np.flatnonzero(used)
                        p, y, node = logistic(margins[k][on]), part.y[on], node[on]
                        first, second = p - y, np.maximum(p * (1 - p), 1e-16)
                        if jobs[m].sizes.positive_weight != 1:
                            w = np.array([1.0, jobs[m].sizes.positive_weight])[y]
                            first, second = w * first, w * second
                        cells.add(total[m], part, on, node, (first, second, np.ones(len(on))))
            yield pa.record_batch([pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())], names=["sums"])

        sums = state.mapInArrow(run, "sums binary")
        if self.tasks > DIRECT_TASKS:
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for b in batches:
                    for x in b.column(0).to_pylist():
                        x = np.frombuffer(x, "<f8")
                        total = x.copy() if total is None else total + x
                if total is not None:
                    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

            sums = sums.repartition(math.isqrt(self.tasks)).mapInArrow(add, "sums binary")
        found = sums.toArrow().column(0).to_pylist()
        flat = sum((np.frombuffer(x, "<f8") for x in found), np.zeros(sum(int(np.prod(s)) for s in shape)))
        out, at = [], 0
        for s in shape:
            out.append(flat[at:at + int(np.prod(s))].reshape(s))
            at += out[-1].size
        return out

    # --- growing --------------------------------------------------------------------------

    def _round(self, state: DataFrame, since, round_: int) -> list[Growing]:
        live = [j.sizes.rounds > round_ for j in self.jobs]
        trees = [Growing() for _ in self.jobs]
        held: list[dict[int, np.ndarray]] = [{} for _ in self.jobs]
        wanted = [[0] if on else [] for on in live]
        others: list[dict[int, tuple[int, int]]] = [{} for _ in self.jobs]  # node -> (parent, sibling that is summed)
        for level in range(max(j.sizes.depth for j in self.jobs)):
            if not any(wanted):
                break
            arrays = [t.arrays() if len(t.feature) > 1 else () for t in trees]
            sums = self._level(state, since, arrays, wanted, round_)
            now: list[dict[int, np.ndarray]] = [dict(zip(w, s, strict=True)) for w, s in zip(wanted, sums, strict=True)]
            for m, own in enumerate(now):
                for node, (parent, sibling) in others[m].items():
                    own[node] = held[m][parent] - own[sibling]
            held = now
            wanted, others = [[] for _ in self.jobs], [{} for _ in self.jobs]
            flat = [(m, node) for m, own in enumerate(now) for node in sorted(own) if level < self.jobs[m].sizes.depth]
            if not flat:
                break
            gain, slot, cut, left, total = best_cuts(self.cells, np.stack([now[m][node] for m, node in flat]), [self.jobs[m].sizes for m, _ in flat])
            for k, (m, node) in enumerate(flat):
                tree = trees[m]
                tree.stats[node] = total[k]
                if gain[k] <= 1e-6:
                    continue
                tree.split(node, int(slot[k]), int(cut[k]), float(gain[k]), left[k], total[k] - left[k])
                a = tree.left[node]
                if level + 1 < self.jobs[m].sizes.depth:
                    few, many = (a, a + 1) if left[k][2] <= total[k][2] - left[k][2] else (a + 1, a)
                    wanted[m].append(few)
                    others[m][many] = (node, few)
        for tree, job in zip(trees, self.jobs, strict=True):
            tree.best_first(job.sizes.leaves)
        return trees

    def _keep(self, round_: int) -> None:
        """Commit the trees of the last rounds, whose margins are complete, and drop the margins before them."""
        data = io.BytesIO()
        np.savez(data, **{f"{m}.{t}.{k}": x for m, own in enumerate(self.trees) for t, tree in enumerate(own[max(round_ - REFRESH, 0):]) for k, x in enumerate(tree)})
        artifacts.write_bytes(self.spark, f"{self.folder}/trees-{round_}.npz", data.getvalue())
        artifacts.remove(self.spark, f"{self.folder}/margins-{round_ - REFRESH}")

    def _resumed(self) -> int:
        """The last round whose margins and trees are complete; 0 without one."""
        at = 0
        while artifacts.path_exists(self.spark, f"{self.folder}/trees-{at + REFRESH}.npz"):
            at += REFRESH
        if not artifacts.path_exists(self.spark, f"{self.folder}/margins-{at}/_SUCCESS"):
            return 0
        for r in range(REFRESH, at + 1, REFRESH):
            kept = np.load(io.BytesIO(artifacts.read_bytes(self.spark, f"{self.folder}/trees-{r}.npz")))
            for m, own in enumerate(self.trees):
                t = 0
                while f"{m}.{t}.0" in kept:
                    own.append(tuple(kept[f"{m}.{t}.{k}"] for k in range(5)))
                    t += 1
        return at

    def train(self) -> list[Trees]:
        """The boosted trees of each job."""
        self.tasks = self.table.rdd.getNumPartitions()
        starts = self._starts()
        done = self._resumed()
        state = self._held(done) if done else self._begun(starts)
        none: list[list[tuple]] = [[] for _ in self.jobs]
        old = None
        for round_ in range(done, self.rounds):
            if round_ > done and round_ % REFRESH == 0:
                state = self._written(state, round_)
                self._keep(round_)
                old.unpersist()
                old = None
            since = [[] for _ in self.jobs]
            grown = self._round(state, none, round_)
            if old is not None:
                old.unpersist()
            for m, tree in enumerate(grown):
                if self.jobs[m].sizes.rounds <= round_:
                    continue
                feature, cut, left = tree.arrays()
                stats = np.array([s if s is not None else np.zeros(3) for s in tree.stats])
                value = np.where(feature < 0, -stats[:, 0] / np.maximum(stats[:, 1] + self.jobs[m].sizes.l2, 1e-12) * self.jobs[m].sizes.rate, 0.0)
                since[m].append((feature, cut, left, value))
                self.trees[m].append((feature, cut, left, value, stats[:, 2]))
            old = state
            if round_ + 1 < self.rounds:
                state = self._advanced(old, since)
                if (round_ + 1) % REFRESH:
                    state.persist()  # made by the next round's first pass
        state.unpersist()
        return [joined_trees(self.encoder, True, float(starts[m]), [(k, f.astype("<i2").tobytes(), c.astype("u1").tobytes(), x.astype("<i4").tobytes(), v.astype("<f8").tobytes(), w.astype("<f8").tobytes())
                                                                    for k, (f, c, x, v, w) in enumerate(own)]) for m, own in enumerate(self.trees)]


def added(part: Part, since: list[list[tuple]]) -> np.ndarray:
    """Margins of a block's jobs with the trees since they were written."""
    out = part.margins.copy()
    for k, m in enumerate(part.jobs):
        for tree in since[m]:
            out[k] += reached(part.codes, *tree)
    return out


def block_number(part: Part) -> int:
    """A number of a block that does not depend on where it is stored."""
    return zlib.crc32(part.codes.tobytes(), zlib.crc32(part.y.tobytes()))


def jobs_key(jobs: list[Job]) -> str:
    import hashlib

    return hashlib.sha1(json.dumps([(j.name, j.fit, vars(j.sizes)) for j in jobs], sort_keys=True).encode()).hexdigest()[:12]
