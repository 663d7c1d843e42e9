"""Over-sampling of the rarer class by certified nearest neighbours (M4).

Within the training rows of each fit, rows of the rarer class get neighbours: the ``K_NEAR`` nearest other rows of that class, by
the Euclidean distance of the standardised slots (a differing category counts 2 in the square).  Made rows lie at a random
place between a row and one of its neighbours, as many as bring the classes level.

Neighbour search: equal rows are first merged (with their number).  Distinct rows go to the nearest of some pivots, which makes
cells with a radius.  Cells that lie beside each other make a group, whose rows are searched together, by one task: first among
themselves, then in the cells that may hold a nearer row.  A cell whose pivot is farther than its radius plus the k-th distance found so
far cannot (triangle inequality), so no open cell is left and results are those of comparing all pairs.  The cells of a group's search come
as a stream of blocks, nearest first; a task holds one group of rows, what was found for them and one block.  Blocks are compared in
single precision, with room for its error, and what passes is measured in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.ml import blocks as B
from churnkit.ml.features import Encoder, Rows
from churnkit.ml.linear import moments
from churnkit.ml.split import hash_cuts

K_NEAR = 5
#: Rows of a block of candidates; a fit has a pivot for every so many distinct rows, but no fewer and no more than the two bounds; cells
#: whose rows are searched together.
BLOCK, PIVOT_ROWS, FEWEST, MOST, OPENED = 2048, 512, 8, 4096, 8
#: Groups of a fit, about, once they have more than ``OPENED`` cells each; rows of a group; rows of it compared at once.
GROUPS, GROUP_ROWS, SOME = 32, 1 << 17, 1024


def minority(table: DataFrame, fits: list[int], encoder: Encoder) -> dict[int, tuple[int, int]]:
    """``fit -> (rarer class, rows to make)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(fits), 2), np.int64)
        for b in batches:
            for block in B.unpacked(encoder, b):
                for m, fit in enumerate(fits):
                    n[m] += np.bincount(block.y[block.used(fit)], minlength=2)
        yield pa.record_batch([pa.array([n.tobytes()], pa.binary())], names=["n"])

    total = sum((np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.mapInArrow(run, "n binary").toArrow().column(0).to_pylist()), np.zeros((len(fits), 2), np.int64))
    return {f: (int(np.argmin(t)), int(abs(t[1] - t[0]))) for f, t in zip(fits, total.tolist(), strict=True)}


def distinct_rows(table: DataFrame, encoder: Encoder, classes: dict[int, int]) -> DataFrame:
    """``(fit, row, copies)``: the different rows of each fit's rarer class, packed, and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in B.unpacked(encoder, b):
                packed = np.concatenate([block.rows.num.astype("<f8").view("u1").reshape(len(block.y), -1), block.rows.level.astype("<i2").view("u1").reshape(len(block.y), -1)], axis=1)
                for fit, c in classes.items():
                    own = packed[block.used(fit) & (block.y == c)]
                    if len(own):
                        yield pa.record_batch([pa.array([fit] * len(own), pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], names=["fit", "row"])

    return table.mapInArrow(run, "fit int, row binary").groupBy("fit", "row").agg(F.count(F.lit(1)).alias("copies"))


def unpack(encoder: Encoder, packed: list[bytes] | np.ndarray) -> Rows:
    k = len(encoder.numeric)
    raw = packed.view("u1") if isinstance(packed, np.ndarray) else np.frombuffer(b"".join(packed), "u1")
    raw = raw.reshape(len(packed), -1)
    return Rows(encoder, np.ascontiguousarray(raw[:, :8 * k]).view("<f8").reshape(len(packed), k), np.ascontiguousarray(raw[:, 8 * k:]).view("<i2").reshape(len(packed), -1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two blocks, without the loss of digits that multiplying out has near zero."""
    d = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
    near = np.nonzero(d < 1e-6 * (1 + (a * a).sum(axis=1)[:, None]))
    if len(near[0]):
        diff = a[near[0]] - b[near[1]]
        d[near] = (diff * diff).sum(axis=1)
    return d


def _least(at: np.ndarray, distance: np.ndarray, row: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of offers ``(at, distance, row, copies)``, for each ``at`` the nearest that together hold ``k`` rows; ties to the smaller row."""
    order = np.lexsort((row, distance, at))
    at, distance, row, copies = at[order], distance[order], row[order], copies[order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    total = np.cumsum(copies) - copies
    before = total - np.repeat(total[begin], np.diff(np.r_[begin, len(at)]))
    keep = before < k
    return at[keep], distance[keep], row[keep], copies[keep]


def _beside(centers: np.ndarray) -> list[int]:
    """The pivots in an order that keeps near ones together: halves by the direction of the farthest one, and halves of those."""
    out, todo = [], [np.arange(len(centers))]
    while todo:
        own = todo.pop()
        if len(own) < 3:
            out += own.tolist()
            continue
        far = centers[own] - centers[own].mean(axis=0)
        along = np.argsort(far @ far[int((far * far).sum(axis=1).argmax())], kind="stable")
        todo += [own[along[len(own) // 2:]], own[along[:len(own) // 2]]]
    return out


class Search:
    """The nearest rows found so far for a group's rows, which together hold ``k`` rows other than itself."""

    def __init__(self, values: np.ndarray, row: np.ndarray, k: int) -> None:
        n = len(row)
        self.values, self.row, self.k = values, row, k
        self.distance, self.near, self.copies = np.full((n, k), np.inf), np.zeros((n, k), row.dtype), np.zeros((n, k), np.int64)
        self.bound = np.full(n, np.inf)
        self.norm = (values * values).sum(axis=1)
        self.wide = np.c_[-2 * values, self.norm, np.ones(n)].astype(np.float32)

    def _room(self, square: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
        """What a square may be in single precision if it is at most ``square``."""
        return square + 2e-7 * (self.values.shape[1] + 4) * (1 + 2 * norm + 2 * most)

    def add(self, values: np.ndarray, row: np.ndarray, copies: np.ndarray, on: np.ndarray) -> None:
        """Compare the rows ``on`` with a block of candidates."""
        norm = (values * values).sum(axis=1)
        wide, most = np.c_[values, np.ones(len(row)), norm].astype(np.float32).T, float(norm.max(initial=0.0))
        for low in range(0, len(on), SOME):
            q = on[low:low + SOME]
            d = self.wide[q] @ wide
            bound = self.bound[q] ** 2
            new = np.flatnonzero(np.isinf(bound))
            if len(new) and d.shape[1] > self.k + 1:  # the k nearest and perhaps the row itself
                bound[new] = self._room(np.partition(d[new], self.k, axis=1)[:, self.k], self.norm[q][new], most)
            at, c = np.nonzero(d <= self._room(bound, self.norm[q], most).astype(np.float32)[:, None])
            if not len(at):
                continue
            diff = self.values[q[at]] - values[c]
            distance, left = np.sqrt((diff * diff).sum(axis=1)), copies[c].copy()
            left[self.row[q[at]] == row[c]] -= 1  # a row is no neighbour of its own
            keep = (left > 0) & (distance <= self.bound[q[at]])
            at, distance, c, left = q[at[keep]], distance[keep], c[keep], left[keep]
            some = np.unique(at)
            old, slot = np.nonzero(self.copies[some] > 0)
            old = some[old]
            at, distance, near, left = _least(np.r_[old, at], np.r_[self.distance[old, slot], distance], np.r_[self.near[old, slot], row[c]], np.r_[self.copies[old, slot], left], self.k)
            begin = np.searchsorted(at, some)
            slot = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            self.distance[some], self.copies[some] = np.inf, 0
            self.distance[at, slot], self.near[at, slot], self.copies[at, slot] = distance, near, left
            full = self.copies[some].cumsum(axis=1) >= self.k
            self.bound[some] = np.where(full[:, -1], self.distance[some, full.argmax(axis=1)], np.inf)


def neighbours(rows: DataFrame, encoder: Encoder, scaled: dict[int, Encoder], folder: str, k: int = K_NEAR, pivots: int = 0, opened: int = OPENED) -> DataFrame:
    """``(fit, row, copies, lot, near array<struct<distance, row, copies>>)``: for each distinct row, the nearest distinct rows that together hold
    ``k`` rows other than itself, by exact comparison; ties to the smaller packed row.  Equal rows are neighbours at distance zero.
    ``pivots`` of a fit follow from the number of its rows unless given; ``opened`` cells at least are searched together."""
    spark = rows.sparkSession
    rows = rows.withColumn("lot", F.xxhash64("fit", "row").bitwiseAND(F.lit((1 << 63) - 1)))
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    centers: dict[int, np.ndarray] = {}
    for r in rows.groupBy("fit").count().collect():
        f, some = r["fit"], pivots or min(max(r["count"] // PIVOT_ROWS, FEWEST), MOST)
        packed = [bytes(x["row"]) for x in rows.where(F.col("fit") == f).orderBy("lot", "row").limit(some).collect()]
        if packed:
            own = unpack(encoder, packed)
            own.encoder = scaled[f]
            centers[f] = own.values()
    sent = spark.sparkContext.broadcast((centers, scaled))

    def values(f: int, packed: list[bytes] | np.ndarray) -> np.ndarray:
        own = unpack(encoder, packed)
        own.encoder = sent.value[1][f]
        return own.values()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit, packed = b.column(0).to_numpy(), b.column(1).to_pylist()
            cell, far = np.zeros(len(fit), np.int32), np.zeros(len(fit))
            for f in np.unique(fit).tolist():
                own = np.flatnonzero(fit == f)
                for low in range(0, len(own), SOME):
                    some = own[low:low + SOME]
                    d = squared(values(f, [packed[i] for i in some]), sent.value[0][f])
                    cell[some] = d.argmin(axis=1)
                    far[some] = np.sqrt(d.min(axis=1))
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(far)], names=["fit", "row", "copies", "cell", "far"])

    placed = rows.select("fit", "row", "copies").mapInArrow(place, "fit int, row binary, copies long, cell int, far double")
    placed.write.mode("overwrite").parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    about = {(r["fit"], r["cell"]): r for r in placed.groupBy("fit", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius, pieces, blocks = {f: np.full(len(c), -np.inf) for f, c in centers.items()}, {f: np.ones(len(c), np.int64) for f, c in centers.items()}, []
    groups = 0
    for f, own in centers.items():
        least, cells, held = max(opened, -(-len(own) // GROUPS)), 0, 0
        groups += 1
        for c in _beside(own):
            r = about.get((f, c))
            if r is None:
                continue
            radius[f][c], pieces[f][c] = r["radius"], -(-r["n"] // BLOCK)
            for piece in range(int(pieces[f][c])):
                if held and (held >= GROUP_ROWS or (piece == 0 and cells >= least)):
                    groups, cells, held = groups + 1, 0, 0
                blocks.append((f, c, piece, groups))
                held += -(-r["n"] // int(pieces[f][c]))
            cells += 1
    tasks = max(1, min(groups, 4096))
    group_of = spark.createDataFrame(blocks, "fit int, cell int, piece int, group int")
    split = spark.createDataFrame([(f, c, int(n)) for f, own in pieces.items() for c, n in enumerate(own.tolist()) if n > 1], "fit int, cell int, pieces int")
    bounds = spark.sparkContext.broadcast((radius, pieces))
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))).cast("int")
    members = placed.join(F.broadcast(split), ["fit", "cell"], "left").withColumn("piece", piece).groupBy("fit", "cell", "piece").agg(F.collect_list(F.struct("row", "copies")).alias("members"))
    members.join(F.broadcast(group_of), ["fit", "cell", "piece"]).write.mode("overwrite").parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")

    def block(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        own = members.values
        packed = own.field("row").to_pylist()
        return np.array(packed, f"S{len(packed[0])}"), own.field("copies").to_numpy()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Search a group's rows among themselves; say which blocks of others may hold nearer ones."""
        def search(f: int, group: int, own: list[tuple]) -> pa.RecordBatch:
            row, copies = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
            at = values(f, row)
            found, ends = Search(at, row, k), np.cumsum([len(x) for x, _ in own])
            for i, e in enumerate(ends.tolist()):
                one = slice(e - len(own[i][0]), e)
                found.add(at[one], row[one], copies[one], np.r_[one, 0:one.start, e:len(row)])
            radius, pieces = (x[f] for x in bounds.value)
            nearest = np.full(len(radius), np.inf)
            for low in range(0, len(row), SOME):
                some = slice(low, low + SOME)
                least = np.maximum(np.sqrt(squared(at[some], sent.value[0][f])) - radius, 0) * (1 - 1e-9) - 1e-9
                np.minimum(nearest, np.where(least <= found.bound[some, None], least, np.inf).min(axis=0), out=nearest)
            cells = np.flatnonzero(nearest < np.inf)
            width = row.dtype.itemsize
            return pa.record_batch([pa.array([f], pa.int32()), pa.array([group], pa.int32()), pa.array([width], pa.int32()),
                                    *(pa.array([x.tobytes()], pa.large_binary()).cast(pa.binary()) for x in (row, found.distance, found.near, found.copies)),
                                    pa.array([[{"cell": int(c), "place": float(nearest[c])} for c in cells.tolist()]], pa.list_(pa.struct([("cell", pa.int32()), ("place", pa.float64())])))],
                                   names=["fit", "group", "width", "row", "distance", "near", "copies", "wanted"])

        key, own = None, []
        for b in batches:
            for i in range(b.num_rows):
                now = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if key not in (None, now):
                    yield search(*key, own)
                    own = []
                key = now
                own.append(block(b.column(2)[i]))
        if key is not None:
            yield search(*key, own)

    own = members.select("fit", "group", "members", "cell", "piece").repartition(tasks, "fit", "group").sortWithinPartitions("fit", "group", "cell", "piece").select("fit", "group", "members")
    own = own.mapInArrow(within, "fit int, group int, width int, row binary, distance binary, near binary, copies binary, wanted array<struct<cell: int, place: double>>")
    own.write.mode("overwrite").parquet(f"{folder}/within")
    own = spark.read.parquet(f"{folder}/within")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Go on with a group's search in the blocks of others."""
        key, found, far = None, None, None

        def result() -> Iterator[pa.RecordBatch]:
            for low in range(0, len(found.row), 8192):
                some = slice(low, low + 8192)
                got = found.copies[some] > 0
                width, offsets = found.row.dtype.itemsize, pa.array(np.r_[0, got.sum(axis=1).cumsum()].astype(np.int32))
                packed = lambda x, w=width: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * w).astype(np.int32)), pa.py_buffer(x.tobytes())])
                near = pa.StructArray.from_arrays([pa.array(found.distance[some][got]), packed(found.near[some][got]), pa.array(found.copies[some][got])], ["distance", "row", "copies"])
                yield pa.record_batch([pa.array(np.full(len(got), key[0], np.int32)), packed(found.row[some]), pa.ListArray.from_arrays(offsets, near)], names=["fit", "row", "near"])

        for b in batches:
            for i in range(b.num_rows):
                f, group, cell = (b.column(j)[i].as_py() for j in range(3))
                if key not in (None, (f, group)):
                    yield from result()
                key = (f, group)
                if cell < 0:
                    width, row, distance, near, copies = (b.column(j)[i].as_py() for j in range(3, 8))
                    row = np.frombuffer(row, f"S{width}")
                    found = Search(values(f, row), row, k)
                    found.distance, found.near, found.copies = np.frombuffer(distance).reshape(-1, k).copy(), np.frombuffer(near, row.dtype).reshape(-1, k).copy(), np.frombuffer(copies, np.int64).reshape(-1, k).copy()
                    full = found.copies.cumsum(axis=1) >= k
                    found.bound = np.where(full[:, -1], found.distance[np.arange(len(row)), full.argmax(axis=1)], np.inf)
                    continue
                diff = found.values - sent.value[0][f][cell]
                far = np.sqrt((diff * diff).sum(axis=1))
                on = np.flatnonzero(np.maximum(far - bounds.value[0][f][cell], 0) * (1 - 1e-9) - 1e-9 <= found.bound)
                if len(on):
                    there, n = block(b.column(8)[i])
                    found.add(values(f, there), there, n, on)
        if key is not None:
            yield from result()

    asked = own.select("fit", "group", F.explode("wanted").alias("w")).select("fit", F.col("group").alias("by"), "w.cell", "w.place")
    others = members.join(asked, ["fit", "cell"]).where("`group` <> by").select("fit", F.col("by").alias("group"), "cell", "place", "piece", "members")
    stream = own.select("fit", "group", F.lit(-1).alias("cell"), F.lit(-1.0).alias("place"), F.lit(0).alias("piece"), "width", "row", "distance", "near", "copies").unionByName(others, allowMissingColumns=True)
    stream = stream.repartition(tasks, "fit", "group").sortWithinPartitions("fit", "group", "place", "cell", "piece").select(
        "fit", "group", "cell", "width", "row", "distance", "near", "copies", "members")
    stream.mapInArrow(across, "fit int, row binary, near array<struct<distance: double, row: binary, copies: long>>").write.mode("overwrite").parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    return rows.select("fit", "row", "copies", "lot").join(found, ["fit", "row"], "left")


def oversampled(table: DataFrame, encoder: Encoder, fits: list[int], folder: str, seed: int) -> DataFrame:
    """Blocks of made rows of every fit; ``table`` holds the given rows."""
    need = {f: x for f, x in minority(table, fits, encoder).items() if x[1] > 0}
    scaled = {f: encoder.scaled_by(m, s) for f, (m, s, _) in zip(fits, moments(table, encoder, fits), strict=True)}
    rows = distinct_rows(table, encoder, {f: c for f, (c, _) in need.items()})
    near = neighbours(rows, encoder, {f: scaled[f] for f in need}, folder)
    near.write.mode("overwrite").parquet(f"{folder}/near")
    near = table.sparkSession.read.parquet(f"{folder}/near")
    total = {r["fit"]: r["n"] for r in near.groupBy("fit").agg(F.sum("copies").alias("n")).collect()}
    whole = F.lit(0)
    for f, n in total.items():
        whole = F.when(F.col("fit") == f, F.floor(F.col("copies") * F.lit(need[f][1]) / F.lit(n))).otherwise(whole)
    near = near.where(F.size("near") > 0).withColumn("times", whole.cast("long"))
    # every row makes its share of those needed; what is left over is made by the rows of the least hash
    left = {r["fit"]: need[r["fit"]][1] - r["n"] for r in near.groupBy("fit").agg(F.sum("times").alias("n")).collect()}
    more = F.lit(0)
    for f, (cut,) in hash_cuts(near.select("fit", "lot"), "fit", "lot", {f: [n] for f, n in left.items()}).items():
        more = F.when(F.col("fit") == f, (F.col("lot") <= F.lit(cut)).cast("int")).otherwise(more)
    near = near.withColumn("times", F.col("times") + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[int, list[tuple[bytes, bytes, float]]] = {}
            for f, row, times, found, lot in zip(*(b.column(c).to_pylist() for c in ("fit", "row", "times", "near", "lot")), strict=True):
                options = [o["row"] for o in found for _ in range(min(o["copies"], K_NEAR))][:K_NEAR]
                r = np.random.default_rng([seed, f, lot])
                made.setdefault(f, []).extend((row, options[int(k)], float(g)) for k, g in zip(r.integers(0, len(options), times), r.random(times), strict=True))
            for f, own in made.items():
                for low in range(0, len(own), B.BLOCK_ROWS):
                    a, c, g = zip(*own[low:low + B.BLOCK_ROWS], strict=True)
                    one, two, gap = unpack(encoder, list(a)), unpack(encoder, list(c)), np.array(g)
                    num = one.num + gap[:, None] * (two.num - one.num)
                    rows = Rows(encoder, num, one.level, two.level, gap)
                    yield B.batch([B.Block(rows, np.full(len(gap), need[f][0], "u1"), np.full(len(gap), -1, "i1"), np.full(len(gap), f, "i1"))])

    # a block holds rows of one fit: bring them together
    return near.select("fit", "row", "times", "near", "lot").repartition("fit", F.pmod(F.xxhash64("row"), F.lit(8))).sortWithinPartitions("fit").mapInArrow(run, B.BLOCKS)
