"""Random forests grown to pure leaves (M5).

Every tree learns from all rows of its fit.  Trees of a fit are dealt out to groups.  Where a task can hold the rows of a fit
(``TASK_ROWS``), each group gets them in one task and grows its trees there, all nodes of a level at once.  Of a larger fit, a group
of trees first grows its upper nodes over all blocks: tasks sum their rows into cells (node, slot, bin), as for boosting, until a
node's rows fit into a task, which then grows what is below it as a piece of the tree.  So no task holds more than ``TASK_ROWS`` rows, and
a table row holds what one task grew.

A tree draws its own bootstrap, and tries the square root of the number of slots, drawn anew in each node.  In larger fits a row is
drawn as often as a Poisson variable of mean 1 says, which needs no count of the rows elsewhere.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.ml import blocks as B
from churnkit.ml.features import LEVEL_BINS, NUMERIC_BINS, Encoder

#: Rows that a task grows trees from at most, or all that is below a node; trees of a group.
TASK_ROWS, GROUP_TREES = 1 << 18, 25
#: Rows a group of trees learns from: all of them.  With a number here each draws a sample of about so many; nothing in this package sets one.
BAG_ROWS: int | None = None
#: Whole weights of less than this in all are summed together with those of class 1, which are held in multiples of it.
LARGEST = 1 << 24
#: Codes of slots that are compared together: slots of few rows share one pass.
TOGETHER = 1 << 16
#: A tree, or a piece of one.  Piece 0 holds the root; the others hang where it has a leaf whose ``left`` is their number.
TREES = "fit int, tree int, feature binary, cut binary, `left` binary, value binary, cover binary, piece int"
_NAMES = [x.split()[0].strip("`") for x in TREES.split(", ")]


def grow(codes: np.ndarray, y: np.ndarray, numeric: int, r: np.random.Generator, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """One tree on bootstrapped rows: ``(feature, cut, left, value, cover)``.  Every node tries sqrt(slots) slots; if none of them
    splits it, the others are tried as well, so only nodes of one class or of equal rows become leaves."""
    n, slots = codes.shape
    codes = np.ascontiguousarray(codes)
    w = np.bincount(r.integers(0, n, n), minlength=n).astype(np.float64) if weight is None else weight
    rows = np.flatnonzero(w > 0)
    ww = w[rows]
    yy = ww * y[rows]
    local = np.zeros(len(rows), np.int64)
    total, pos = np.array([ww.sum()]), np.array([yy.sum()])
    features, cuts, lefts, covers, positives, made = [], [], [], [], [], 1
    tries = max(1, math.isqrt(slots))
    while True:
        m = len(total)
        covers.append(total)
        positives.append(pos)
        best_gain, best_slot, best_cut = np.full(m, -1.0), np.full(m, -1), np.zeros(m, np.int64)
        if len(rows):
            impure = (pos > 0) & (pos < total)
            pick = np.zeros((m, slots), np.int64)
            pick[impure] = np.argpartition(r.random((m, slots))[impure], min(tries, slots - 1), axis=1)
            todo = impure
            for some in (pick[:, :tries], pick[:, tries:]):
                if not todo.any():
                    break
                _try(codes, rows, local, ww, yy, some, todo, total, pos, numeric, best_gain, best_slot, best_cut)
                todo = impure & (best_slot < 0)
        split = np.flatnonzero(best_slot >= 0)
        left = np.zeros(m, np.int64)
        left[split] = made + 2 * np.arange(len(split))
        features.append(best_slot)
        cuts.append(np.where(best_slot >= 0, best_cut, 0))
        lefts.append(left)
        if not len(split):
            break
        on = np.flatnonzero(best_slot[local] >= 0)
        rows, local, ww, yy = rows[on], local[on], ww[on], yy[on]
        local = left[local] - made + (codes.ravel()[rows * slots + best_slot[local]] > best_cut[local])
        made += 2 * len(split)
        total, pos = (np.bincount(local, x, minlength=2 * len(split)) for x in (ww, yy))
    feature, cover = np.concatenate(features).astype(np.int16), np.concatenate(covers)
    value = np.where(feature < 0, np.concatenate(positives) / np.maximum(cover, 1e-12), 0.0)
    return feature, np.concatenate(cuts).astype(np.uint8), np.concatenate(lefts).astype(np.int32), value, cover


def _parted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sums that one number holds."""
    y = np.floor(both * (1 / LARGEST))
    return both - y * LARGEST, y


def _purity(c_w: np.ndarray, c_y: np.ndarray, t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What a cut that leaves ``c_w`` rows of ``t`` on its left, ``c_y`` of ``p`` positive ones, leads to; -1 where one side is empty."""
    r_w, r_y, c_n = t - c_w, p - c_y, c_w - c_y
    r_n = r_w - r_y
    purity = (c_y * c_y + c_n * c_n) / c_w + (r_y * r_y + r_n * r_n) / r_w
    purity[~((c_w > 0) & (r_w > 0))] = -1.0
    return purity


def _try(codes, rows, local, ww, yy, some, todo, total, pos, numeric, best_gain, best_slot, best_cut) -> None:
    """Best Gini cut of each node in ``todo`` among its slots ``some``; of equal ones a level's, then the first tried."""
    on = np.flatnonzero(todo[local])
    tried = some.shape[1]
    if not tried or not len(on):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        _cut(codes, on, rows, local, ww, yy, some, todo, total, pos, numeric, best_gain, best_slot, best_cut)


def _cut(codes, on, rows, local, ww, yy, some, todo, total, pos, numeric, best_gain, best_slot, best_cut) -> None:
    tried, nodes = some.shape[1], np.flatnonzero(todo)
    m, some, t, p = len(nodes), some[nodes], total[nodes], pos[nodes]
    flat, row, w, v = codes.ravel(), rows[on] * codes.shape[1], ww[on], yy[on]
    here = (np.cumsum(todo) - 1)[local[on]]
    # whole weights of either kind fit into one number, so one sum serves both
    kinds = [w, v]
    if numeric <= 16 and w.sum() < LARGEST and (w == np.floor(w)).all() and (v == np.floor(v)).all() and (v >= 0).all():
        kinds = [w + LARGEST * v]
    split = (lambda x: _parted(x[0])) if len(kinds) == 1 else (lambda x: x)
    before = (p**2 + (t - p) ** 2) / t
    gains, slots, cuts = np.full(m, -1.0), np.full(m, -1), np.zeros(m, np.int64)

    def offer(own: np.ndarray, purity: np.ndarray, slot: np.ndarray, cut: np.ndarray) -> None:
        gain = np.where(purity >= 0, np.maximum(purity - before[own], 0.0), -1.0)
        better = gain > gains[own]
        k = own[better]
        gains[k], slots[k], cuts[k] = gain[better], slot[better], cut[better]

    many, entries = some < numeric, []
    step = min(max(TOGETHER // len(on), 1), tried)
    for low in range(0, tried, step):
        own, number = np.ascontiguousarray(some[:, low:low + step]), many[:, low:low + step]
        wide = own.shape[1]
        pairs = m * wide
        at = own[here]
        at += row[:, None]
        code = flat[at]
        if number.any():
            at_k = np.flatnonzero(number[here])
            few = at_k // wide
            entries.append((few, here[few] * tried + low + at_k % wide, code.ravel()[at_k]))
            if number.all():
                continue
            np.minimum(code, LEVEL_BINS - 1, out=code)  # numeric entries stay in, unread
        np.multiply(code, pairs, out=at, dtype=np.int64)
        at += here[:, None] if wide == 1 else (here * wide)[:, None] + np.arange(wide)
        sums = [np.bincount(at.ravel(), x if wide == 1 else np.repeat(x, wide), minlength=LEVEL_BINS * pairs).reshape(LEVEL_BINS, pairs) for x in kinds]
        left, t_k, p_k = [x[0] for x in sums], np.repeat(t, wide), np.repeat(p, wide)
        found, cut = _purity(*split(left), t_k, p_k), np.zeros(pairs, np.int64)
        for b in range(1, LEVEL_BINS - 1):  # nothing lies beyond the last bin
            some_b = np.flatnonzero(sums[0][b])  # an empty bin leads to what the one before it did
            for x, y in zip(left, sums, strict=True):
                x[some_b] += y[b][some_b]
            purity = _purity(*split([x[some_b] for x in left]), t_k[some_b], p_k[some_b])
            better = np.flatnonzero(purity > found[some_b])
            found[some_b[better]], cut[some_b[better]] = purity[better], b
        found[number.ravel()] = -1.0
        gain = np.where(found >= 0, np.maximum(found - np.repeat(before, wide), 0.0), -1.0).reshape(m, wide)
        first = np.arange(m) * wide + gain.argmax(axis=1)  # of equal ones the first tried
        offer(np.arange(m), found[first], own.ravel()[first], cut[first])
    if entries:  # few, but with many bins: only the bins that occur
        few, pair, code = (np.concatenate(x) for x in zip(*entries, strict=True))
        key = pair * NUMERIC_BINS + code
        order = np.argsort(key, kind="stable")
        key, few = key[order], few[order]
        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
        pair, cut = key[last] // NUMERIC_BINS, key[last] % NUMERIC_BINS
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        sizes, own = np.diff(np.r_[begin, len(pair)]), pair // tried
        sums = [np.cumsum(x[few])[last] for x in kinds]
        left = [x - np.repeat(np.r_[0.0, x][begin], sizes) for x in sums]
        purity = _purity(*split(left), t[own], p[own])
        best = np.flatnonzero(purity == np.repeat(np.maximum.reduceat(purity, begin), sizes))
        best = best[np.r_[True, pair[best][1:] != pair[best][:-1]]]
        # a node's best pair, of equal ones the first tried, as pairs are in order
        gain = np.maximum(purity[best] - before[own[best]], 0.0)
        best = best[np.lexsort((-gain, own[best]))]
        best = best[np.r_[True, own[best][1:] != own[best][:-1]]]
        offer(own[best], purity[best], some.ravel()[pair[best]], cut[best])
    better = gains > best_gain[nodes]
    k = nodes[better]
    best_gain[k], best_slot[k], best_cut[k] = gains[better], slots[better], cuts[better]


def _packed(fit: int, tree: int, arrays: tuple[np.ndarray, ...], piece: int) -> list:
    f, c, x, v, w = arrays
    return [fit, tree, *(a.tobytes() for a in (f.astype("<i2"), c.astype("u1"), x.astype("<i4"), v.astype("<f8"), w.astype("<f8"))), piece]


def _batch(row: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
    return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=_NAMES)


def train(table: DataFrame, encoder: Encoder, fits: list[int], trees: int, seed: int, positive_weight: float = 1.0) -> DataFrame:
    """:data:`TREES`: the trees of forests for each of ``fits``."""
    return reduce(DataFrame.union, (job() for job in jobs(table, encoder, fits, trees, seed)))


def jobs(table: DataFrame, encoder: Encoder, fits: list[int], trees: int, seed: int) -> list[Callable[[], DataFrame]]:
    """Frames of trees, to be written one after another: one for all fits that a task can hold, one for each group of trees of any other."""
    sizes = _sizes(table, fits)
    held = [f for f in fits if BAG_ROWS or sizes.get(f, 0) <= TASK_ROWS]
    out = [lambda: _held(table, encoder, held, trees, seed)] if held or not fits else []
    for f in (f for f in fits if f not in held):
        out += [lambda f=f, low=low: _large(table, encoder, f, range(low, min(low + GROUP_TREES, trees)), seed) for low in range(0, trees, GROUP_TREES)]
    return out


def _sizes(table: DataFrame, fits: list[int]) -> dict[int, int]:
    """Rows of each fit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(fits), np.int64)
        for b in batches:
            for fold, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fold, own = np.frombuffer(fold, "i1"), np.frombuffer(own, "i1")
                n += [int(((own == f) | ((own == B.EVERY) & (fold != f))).sum()) for f in fits]
        yield pa.record_batch([pa.array(fits, pa.int32()), pa.array(n)], names=["of", "n"])

    found = table.select("fold", "fit").mapInArrow(count, "of int, n long").groupBy("of").agg(F.sum("n").alias("n")).collect()
    return {r["of"]: r["n"] for r in found}


def _held(table: DataFrame, encoder: Encoder, fits: list[int], trees: int, seed: int) -> DataFrame:
    """Trees of fits whose rows a task can hold, a task for each group."""
    groups = math.ceil(trees / GROUP_TREES)
    numeric, width = len(encoder.numeric), encoder.width
    n = (table.agg(F.sum("n")).first()[0] or 0) if BAG_ROWS else 0
    share = min(1.0, BAG_ROWS / n) if n else 1.0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in B.unpacked(encoder, b):
                codes = block.rows.codes()
                for fit in fits:
                    used = np.flatnonzero(block.used(fit))
                    if not len(used):
                        continue
                    own = [used]
                    if share < 1:
                        lots = np.random.default_rng([seed, fit, int(block.y.sum()), len(block.y)]).random((groups, len(used)))
                        own = [used[lots[g] < share] for g in range(groups)]
                    # slot by slot they take little room
                    packed = [pa.compress(codes[k].T.tobytes(), "zstd", asbytes=True) for k in own] * (groups // len(own))
                    y = [block.y[k].tobytes() for k in own] * (groups // len(own))
                    yield pa.record_batch([pa.array([fit] * groups, pa.int32()), pa.array(range(groups), pa.int32()), pa.array(packed, pa.binary()),
                                           pa.array(y, pa.binary()), pa.array([fits.index(fit) * groups + g for g in range(groups)], pa.int32())],
                                          names=["fit", "part", "codes", "y", "task"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        key = None
        for b in batches:
            for fit, group, packed, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is not None and key != (fit, group):
                    yield from grown(*key, held.pop(key))
                key = (fit, group)
                codes = np.frombuffer(pa.decompress(packed, len(y) * width, "zstd"), np.uint8).reshape(width, -1).T.tobytes() if y else b""
                held.setdefault(key, []).append((codes, y))
        if key is not None:
            yield from grown(*key, held.pop(key))

    def grown(fit: int, group: int, parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = sorted(parts)  # the order of the rows, and so the trees, do not depend on the shuffle
        codes = np.frombuffer(b"".join(c for c, _ in parts), np.uint8).reshape(-1, width)
        y = np.frombuffer(b"".join(v for _, v in parts), "u1").astype(np.float64)
        for tree in range(group * GROUP_TREES, min((group + 1) * GROUP_TREES, trees)):
            r = np.random.default_rng([seed, fit, tree])
            yield _batch(_packed(fit, tree, grow(codes, y, numeric, r), 0))

    dealt = table.mapInArrow(deal, "fit int, part int, codes binary, y binary, task int")
    # one group a task: by hash of fit and part, some tasks would get several and others none
    dealt = dealt.repartitionById(max(1, len(fits) * groups), F.col("task")).select("fit", "part", "codes", "y")
    return dealt.mapInArrow(learn, TREES)


class Top:
    """The upper nodes of one tree.  ``open`` holds the nodes to be cut, the slots to try next and those to try if none of them cuts it."""

    def __init__(self, slots: int, seed: list[int]) -> None:
        self.slots, self.seed = slots, seed
        self.feature, self.cut, self.left, self.total, self.pos = [], [], [], [], []
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.pieces: list[int] = []  # the node of each piece
        self.add(math.inf, math.nan)

    def add(self, total: float, pos: float) -> None:
        node = len(self.feature)
        for x, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.total, total), (self.pos, pos)):
            x.append(v)
        if total > TASK_ROWS:
            if not 0 < pos < total and node:
                return
            order, tries = np.random.default_rng([*self.seed, node]).permutation(self.slots), max(1, math.isqrt(self.slots))
            self.open[node] = order[:tries], order[tries:]
        elif 0 < pos < total:
            self.pieces.append(node)
            self.left[node] = len(self.pieces)

    def arrays(self) -> tuple[np.ndarray, ...]:
        cover, feature = np.array(self.total), np.array(self.feature, np.int16)
        leaf = (feature < 0) & (np.array(self.left) == 0)
        value = np.where(leaf, np.array(self.pos) / np.maximum(cover, 1e-12), 0.0)
        return feature, np.array(self.cut, np.uint8), np.array(self.left, np.int32), value, cover

    def choose(self, node: int, sums: np.ndarray) -> None:
        """Cut a node by its rows and positive rows ``(2, slots tried, bins)``: the best Gini cut, of equal ones the first tried."""
        tried, rest = self.open.pop(node)
        total, pos = sums[:, 0].sum(axis=1)
        self.total[node], self.pos[node] = float(total), float(pos)
        if not 0 < pos < total:
            return
        left = sums.cumsum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            purity = _purity(left[0], left[1], total, pos)
        best = int(purity.argmax())
        if purity.flat[best] < 0:
            if len(rest):
                self.open[node] = rest, rest[:0]
            return
        slot, cut = divmod(best, sums.shape[2])
        self.feature[node], self.cut[node], self.left[node] = int(tried[slot]), cut, len(self.feature)
        t, p = left[:, slot, cut]
        self.add(float(t), float(p))
        self.add(float(total - t), float(pos - p))


def _reached(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node that each row stops in."""
    node, at = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while len(at):
        own = node[at]
        inner = feature[own] >= 0
        at, own = at[inner], own[inner]
        node[at] = left[own] + (codes[at, feature[own]] > cut[own])
    return node


def _drawn(encoder: Encoder, record: pa.RecordBatch, seed: int, fit: int, trees: range) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]]:
    """Codes and labels of a fit's rows in each block, and how often each of ``trees`` draws them."""
    for block in B.unpacked(encoder, record):
        used = np.flatnonzero(block.used(fit))
        if len(used):
            codes, y = np.ascontiguousarray(block.rows.codes()[used]), block.y[used]
            number = zlib.crc32(codes.tobytes(), zlib.crc32(y.tobytes()))  # the draw does not depend on where a block is stored
            yield codes, y, (np.random.default_rng([seed, fit, tree, number]).poisson(1.0, len(used)).astype(np.uint8) for tree in trees)


def _tops(table: DataFrame, encoder: Encoder, fit: int, trees: range, seed: int) -> list[Top]:
    """The upper nodes of trees: a pass over the blocks sums the rows of all open nodes, whose cuts the driver picks."""
    tops = [Top(encoder.width, [seed, fit, tree]) for tree in trees]
    while any(t.open for t in tops):
        shape = [t.arrays()[:3] for t in tops]
        nodes = [(k, node) for k, t in enumerate(tops) for node in t.open]
        place = [np.full(len(t.feature), -1) for t in tops]
        for i, (k, node) in enumerate(nodes):
            place[k][node] = i
        tried = [tops[k].open[node][0] for k, node in nodes]
        count = np.array([len(s) for s in tried])
        first, slots = np.cumsum(count) - count, np.concatenate(tried)

        def add(batches: Iterator[pa.RecordBatch], shape=shape, place=place, count=count, first=first, slots=slots) -> Iterator[pa.RecordBatch]:
            cells = np.zeros((2, len(slots) * NUMERIC_BINS))
            for b in batches:
                for codes, y, draws in _drawn(encoder, b, seed, fit, trees):
                    for k, w in enumerate(draws):
                        on = np.flatnonzero(w)
                        own = place[k][_reached(codes[on], *shape[k])]
                        on, own = on[own >= 0], own[own >= 0]
                        n = count[own]
                        pair = np.arange(n.sum()) + np.repeat(first[own] - np.cumsum(n) + n, n)
                        row = np.repeat(on, n)
                        key, ww = pair * NUMERIC_BINS + codes[row, slots[pair]], w[row].astype(float)
                        cells[0] += np.bincount(key, ww, minlength=cells.shape[1])
                        cells[1] += np.bincount(key, ww * y[row], minlength=cells.shape[1])
            some = np.flatnonzero(cells[0])
            yield pa.record_batch([pa.array(some), pa.array(cells[0][some]), pa.array(cells[1][some])], names=["cell", "w", "y"])

        found = table.mapInArrow(add, "cell long, w double, y double").groupBy("cell").agg(F.sum("w").alias("w"), F.sum("y").alias("y")).toArrow()
        sums = np.zeros((2, len(slots) * NUMERIC_BINS))
        cell = found.column("cell").to_numpy()
        sums[0, cell], sums[1, cell] = found.column("w").to_numpy(), found.column("y").to_numpy()
        sums = sums.reshape(2, len(slots), NUMERIC_BINS)
        for (k, node), low, n in zip(nodes, first.tolist(), count.tolist(), strict=True):
            tops[k].choose(node, sums[:, low:low + n])
    return tops


def _large(table: DataFrame, encoder: Encoder, fit: int, trees: range, seed: int) -> DataFrame:
    """A group of trees of a fit that no task can hold."""
    tops = _tops(table, encoder, fit, trees, seed)
    shape, numeric, width = [t.arrays()[:3] for t in tops], len(encoder.numeric), encoder.width
    # pieces go to tasks in turn, each as many as it can hold
    task, room, tasks = [np.full(len(t.pieces) + 1, -1) for t in tops], 0.0, 0
    for k, t in enumerate(tops):
        for piece, node in enumerate(t.pieces, 1):
            if t.total[node] > room:
                room, tasks = float(TASK_ROWS), tasks + 1
            room -= t.total[node]
            task[k][piece] = tasks - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, y, draws in _drawn(encoder, b, seed, fit, trees):
                for k, w in enumerate(draws):
                    feature, _, left = shape[k]
                    node = _reached(codes, *shape[k])
                    piece = np.where(feature[node] < 0, left[node], 0)
                    on = np.flatnonzero((w > 0) & (piece > 0))
                    on = on[np.argsort(piece[on], kind="stable")]
                    if not len(on):
                        continue
                    edges = np.flatnonzero(np.r_[True, piece[on][1:] != piece[on][:-1]])
                    parts = np.split(on, edges[1:])
                    own = piece[on[edges]]
                    yield pa.record_batch([pa.array([trees[k]] * len(own), pa.int32()), pa.array(own, pa.int32()), *(pa.array([x[i].tobytes() for i in parts], pa.binary()) for x in (codes, y, w)),
                                           pa.array(task[k][own], pa.int32())], names=["tree", "piece", "codes", "y", "w", "task"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[bytes, bytes, bytes]]] = {}
        for b in batches:
            for tree, piece, *part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault((tree, piece), []).append(tuple(part))
        for tree, piece in sorted(held):
            parts = sorted(held.pop((tree, piece)))
            codes = np.frombuffer(b"".join(p[0] for p in parts), np.uint8).reshape(-1, width)
            y, w = (np.frombuffer(b"".join(p[i] for p in parts), "u1").astype(np.float64) for i in (1, 2))
            yield _batch(_packed(fit, tree, grow(codes, y, numeric, np.random.default_rng([seed, fit, tree, piece]), w), piece))

    upper = [_packed(fit, tree, t.arrays(), 0) for tree, t in zip(trees, tops, strict=True)]
    out = table.sparkSession.createDataFrame(pa.Table.from_batches([_batch(row) for row in upper]), TREES)
    if not tasks:
        return out
    dealt = table.mapInArrow(deal, "tree int, piece int, codes binary, y binary, w binary, task int")
    return out.union(dealt.repartitionById(tasks, F.col("task")).drop("task").mapInArrow(learn, TREES))
