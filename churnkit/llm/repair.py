"""Conversation structure repair (operator 12).

Method: Hirschberg divide and conquer.  The rows of a conversation pass an automaton with four
states (nothing yet, after system, after user, after assistant); keeping, changing, deleting and
inserting have costs.  A forward vector holds the least cost of reaching each state from the left
and the order of the least audits that reach them so; a backward vector holds the least cost of
ending well from each state.  Where they meet, the crossing is the state of least total cost and,
among those, of the least audit; then both halves are treated alike.  Space is linear in the rows.

A crossing lies directly behind a row, inserts belong to the row after them.  Two audits for the
same rows are then never prefixes of one another, so the order of the audits up to the crossing
decides the order of the whole audits, and a rank for each state stands for its audit.

Conversations of any size: rows are ordered by ranges of (conversation, turn, role, text) and cut
into blocks.  A block that is not a whole conversation is summed up by the least cost and rank of
every way from one state to another; one forward and one backward stream over these sums find the
crossing between any two blocks, and every block is then repaired by itself.

Defined results: nulls read as one space, a null ``conv_id`` is a conversation of its own, null
turns come first, rows of one turn are ordered by role, then by the MD5 digest of the text; equal
rows count as often as they occur; a role that does not begin with s, u or a (also an empty one) can
only be changed or deleted; a conversation without rows needs no edits; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import prepare, stash

BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("none", "truncated", "blank", "duplicate")  # rows with one of the last two must go
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: States are 0 nothing yet, 1 after system, 2 after user, 3 after assistant; GOES[state][initial] is the next one, FORCED[state] that of
#: a changed or inserted row, END the least cost and the inserts that end well.
GOES = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
FORCED = (2, 2, 3, 2)
END = ((0, ""), (6, "II"), (3, "I"), (0, ""))
CHANGE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows, or characters, after which a block is cut.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 20
FAR = 1 << 60

BLOCKS = ("conv_id long, part int, piece long, whole boolean, codes binary, roles array<string>, texts array<string>, "
          "turn_first long, turn_last long, turns long")
PIECES = ("conv_id long, part int, piece long, audit string, repaired string, lines long, cost long, codes binary, "
          "turn_first long, turn_last long, turns long")
CONVERSATIONS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                 "repaired_sha256 string")


@cache
def moves(code: int) -> list[tuple[int, int, int, str]]:
    """``(state, next state, cost, edits)`` for a row with ``code`` = 4 * fault + initial: the cheapest, then least, edits for each
    pair of states.  More than two inserts before a row lead nowhere new."""
    fault, initial = divmod(code, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(x: int, y: int, cost: int, edits: str) -> None:
        best[x, y] = min(best.get((x, y), (FAR, "")), (cost, edits))

    for x in range(4):
        offer(x, x, DELETE, "D")
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
        state = x
        for inserts in range(3):
            if initial in GOES[state]:
                offer(x, GOES[state][initial], INSERT * inserts + extra, "I" * inserts + "K")
            offer(x, FORCED[state], INSERT * inserts + CHANGE + extra, "I" * inserts + "R")
            state = FORCED[state]
    return [(x, y, cost, edits) for (x, y), (cost, edits) in sorted(best.items())]


@cache
def edits_between(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    return {(x, y): (cost, edits) for x, y, cost, edits in moves(code)}


Vector = tuple[list[int], list[int]]


def start(state: int) -> Vector:
    return [0 if s == state else FAR for s in range(4)], [0] * 4


def _ranked(best: list[tuple | None]) -> Vector:
    """Costs and ranks from (cost, rank before, order after) for each state."""
    order = sorted((b[1:], y) for y, b in enumerate(best) if b is not None)
    cost, rank = [FAR if b is None else b[0] for b in best], [0] * 4
    for k, (_, y) in enumerate(order):
        rank[y] = k
    return cost, rank


def forward(vector: Vector, codes: bytes) -> Vector:
    for code in codes:
        cost, rank = vector
        best: list[tuple | None] = [None] * 4
        for x, y, c, edits in moves(code):
            if cost[x] < FAR:
                offer = (cost[x] + c, rank[x], edits)
                if best[y] is None or offer < best[y]:
                    best[y] = offer
        vector = _ranked(best)
    return vector


def backward(after: list[int], codes: bytes) -> list[int]:
    for code in reversed(codes):
        before = [FAR] * 4
        for x, y, c, _ in moves(code):
            before[x] = min(before[x], after[y] + c)
        after = before
    return after


def crossing(vector: Vector, after: list[int]) -> int:
    """The state of least total cost, ties to the least audit up to here."""
    cost, rank = vector
    return min((s for s in range(4) if cost[s] < FAR), key=lambda s: (cost[s] + after[s], rank[s]))


def edits(codes: bytes, entry: int, after: list[int]) -> tuple[list[str], int]:
    """The edits of each row on the least of the cheapest ways from ``entry`` on, and the state in which they leave."""
    leave = crossing(forward(start(entry), codes), after)

    def solve(low: int, high: int, x: int, y: int) -> list[str]:
        if high - low == 1:
            return [edits_between(codes[low])[x, y][1]]
        mid = (low + high) // 2
        target = [FAR] * 4
        target[y] = 0
        s = crossing(forward(start(x), codes[low:mid]), backward(target, codes[mid:high]))
        return solve(low, mid, x, s) + solve(mid, high, s, y)

    return (solve(0, len(codes), entry, leave) if codes else []), leave


def damage(df: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: rows with the faults that the CRC-32 of ``conv_id:turn`` deals out; ``n`` equal rows are one."""
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    given = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(given(conv_id), F.lit(":"), given(turn)).cast("binary")) % 20
    text = given(F.col("text"))
    rows = df.select(conv_id.alias("conv_id"), turn.alias("turn"), lot.alias("lot"),
                     F.when(lot == 4, "user").otherwise(given(F.col("role"))).alias("role"),
                     F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    copies = F.sum(F.when(F.col("lot") == 3, 2).otherwise(1))
    return rows.where("lot != 0").groupBy("conv_id", "turn", "role", "text").agg(copies.alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``code`` for the first of the ``n`` equal rows and ``again`` for the others.

    What was said earlier is found by the least turn of equal (conversation, role, text), so no task sees a conversation as a whole.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    said = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.withColumn("said", said).withColumn("at", at).withColumn("empty", body == "")
    first = rows.where("NOT empty").groupBy("said").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    rows = rows.join(first.select("said", "first"), "said", "left")
    initial = F.lit(3)
    for k, letter in enumerate(INITIALS):
        initial = F.when(F.substring("role", 1, 1) == letter, k).otherwise(initial)
    later = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    ends = F.substring(body, -1, 1).isin(".", "!", "?")
    fault = F.when(F.col("empty"), 2).when(later, 3).when(ends, 0).otherwise(1)
    again = F.when(F.col("empty"), 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", "text", "n", (fault * 4 + initial).cast("int").alias("code"), (again * 4 + initial).cast("int").alias("again"))


class _Block:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.roles, self.texts, self.chars = conv_id, bytearray(), [], [], 0
        self.first = self.last = None
        self.turns = 0

    def at(self, turn: int | None) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def row(self, part: int, piece: int, whole: bool) -> tuple:
        return (self.conv_id, part, piece, whole, bytes(self.codes), self.roles, self.texts, self.first, self.last, self.turns)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def blocks(rows: DataFrame) -> DataFrame:
    """Ordered blocks of conversations: see ``BLOCKS``; (part, piece) gives the order.  ``whole`` says that a block is surely a
    conversation by itself; the first and the last one of a range may go on in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, out, chars = TaskContext.get().partitionId(), 0, [], 0
        held: _Block | None = None
        begins = False  # whether the held block begins a conversation that is not the first of this range

        def close(whole: bool) -> None:
            nonlocal piece, chars
            out.append(held.row(part, piece, whole))
            piece, chars = piece + 1, chars + held.chars

        for batch in batches:
            for conv_id, turn, role, text, n, code, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        close(begins)
                    begins, held = held is not None, _Block(conv_id)
                left = n
                while left:
                    if len(held.codes) >= BLOCK_ROWS or held.chars >= BLOCK_CHARS:
                        close(False)
                        begins, held = False, _Block(conv_id)
                    held.at(turn)
                    if left == n:
                        held.codes.append(code)
                        if code < 8:
                            held.roles.append(role)
                            held.texts.append(text)
                            held.chars += len(text) + len(role)
                        left -= 1
                    else:
                        k = min(left, BLOCK_ROWS - len(held.codes))
                        held.codes += bytes([again]) * k
                        left -= k
                    if chars > BLOCK_CHARS or len(out) >= 4096:
                        yield _batch(out, BLOCKS)
                        out.clear()
                        chars = 0
        if held is not None:
            close(False)
            yield _batch(out, BLOCKS)

    order = ["conv_id", "turn", "role", F.md5("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv_id", "turn", "role", "text", "n", "code", "again").mapInArrow(run, BLOCKS)


def ways(codes: bytes) -> list[list[int]]:
    """Least costs and ranks of all ways through a block: eight numbers for each state it may be entered in."""
    return [cost + rank for cost, rank in (forward(start(e), codes) for e in range(4))]


def along(vector: Vector, through: list[list[int]]) -> Vector:
    """The forward vector after a block, from that before it and the block's :func:`ways`."""
    best: list[tuple | None] = [None] * 4
    for e in range(4):
        for y in range(4):
            if vector[0][e] < FAR and through[e][y] < FAR:
                offer = (vector[0][e] + through[e][y], vector[1][e], through[e][4 + y])
                if best[y] is None or offer < best[y]:
                    best[y] = offer
    return _ranked(best)


def crossings(cut: DataFrame) -> DataFrame:
    """``(part, piece, entry, left)`` for blocks of conversations that have several or may: the state in which the least of the
    cheapest repairs enters a block, and the least costs of ending well from each state behind it.  Each conversation is streamed
    once forward and once backward, a few numbers a block."""
    sums = "conv_id long, part int, piece long, ways array<array<long>>, cost array<long>, rank array<long>"
    names = [x.split()[0] for x in sums.split(", ")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([ways(c) for c in b.column(3).to_pylist()], pa.list_(pa.list_(pa.int64())))],
                                  names=names[:4])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vector = (), start(0)
        for b in batches:
            cost, rank = [], []
            for conv_id, through in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key != (conv_id,):
                    key, vector = (conv_id,), start(0)
                cost.append(vector[0])
                rank.append(vector[1])
                vector = along(vector, through)
            yield pa.record_batch([*b.columns[:4], pa.array(cost, pa.list_(pa.int64())), pa.array(rank, pa.list_(pa.int64()))], names=names)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, after = (), []
        for b in batches:
            entry, left = [], []
            for conv_id, through, cost, rank in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if key != (conv_id,):
                    key, after = (conv_id,), [c for c, _ in END]
                left.append(after)
                after = [min(through[e][y] + after[y] for y in range(4)) for e in range(4)]
                entry.append(crossing((cost, rank), after))
            yield pa.record_batch([b.column(1), b.column(2), pa.array(entry, pa.int32()), pa.array(left, pa.list_(pa.int64()))],
                                  names=["part", "piece", "entry", "left"])

    own = cut.select("conv_id", "part", "piece", "codes").mapInArrow(summed, ", ".join(sums.split(", ")[:4]))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(ahead, sums)
    own = own.sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece"))
    return own.mapInArrow(back, "part int, piece long, entry int, left array<long>")


def repaired(cut: DataFrame) -> DataFrame:
    """Repaired pieces of blocks with ``entry`` and ``left``: see ``PIECES``.  ``repaired`` holds ``lines`` lines ``role:text``."""

    def piece(codes: bytes, roles: list[str], texts: list[str], entry: int, left: list[int]) -> tuple[str, str, int, int]:
        by_row, state = edits(codes, entry, left)
        ends = left == [c for c, _ in END]  # nothing follows
        lines, cost, x = [], 0, entry
        said = zip(roles, texts, strict=True)
        for code, own in zip(codes, by_row, strict=True):
            role, text = next(said) if code < 8 else ("", "")
            for op in own:
                if op in "IR":
                    x = FORCED[x]
                    lines.append(("user:" if x == 2 else "assistant:") + (text if op == "R" else ""))
                    cost += INSERT if op == "I" else CHANGE
                elif op == "K":
                    x = GOES[x][code % 4]
                    lines.append(f"{role}:{text}")
                else:
                    cost += DELETE
            if code // 4 == 1 and own != "D":
                cost += TRUNCATED
        audit = "".join(by_row)
        if ends:
            more = END[state][1]
            for _ in more:
                state = FORCED[state]
                lines.append("user:" if state == 2 else "assistant:")
            audit, cost = audit + more, cost + INSERT * len(more)
        return audit, "\n".join(lines), len(lines), cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(conv_id, part, number, *piece(codes, roles, texts, entry, left), codes, first, last, turns)
                   for conv_id, part, number, codes, roles, texts, first, last, turns, entry, left in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if out:
                yield _batch(out, PIECES)

    return cut.select("conv_id", "part", "piece", "codes", "roles", "texts", "turn_first", "turn_last", "turns", "entry", "left").mapInArrow(run, PIECES)


def _signed(x: int) -> int:
    """As 64-bit arithmetic has it."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def summed_up(pieces: DataFrame) -> DataFrame:
    """One row a conversation from its pieces in order (see ``CONVERSATIONS``), one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, audit, digest, out = None, [], [], None, []
        lines = cost = illegal = turns = 0
        before = low = high = None

        def row() -> tuple:
            gaps = 0 if low is None else _signed(high - low + 1 - turns)
            return (key[0], gaps, counts[2], counts[3], counts[1], illegal, cost, "".join(audit), digest.hexdigest())

        for b in batches:
            for conv_id, _, _, own, text, n, c, codes, first, last, distinct in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if key != (conv_id,):
                    if key is not None:
                        out.append(row())
                    key, counts, audit, digest = (conv_id,), [0] * 4, [], hashlib.sha256()
                    lines = cost = illegal = turns = 0
                    before = low = high = None
                if n:
                    digest.update((("\n" if lines else "") + text).encode("utf-8"))
                lines, cost = lines + n, cost + c
                audit.append(own)
                for code in codes:
                    counts[code // 4] += 1
                    illegal += before is not None and (before, code % 4) not in LEGAL
                    before = code % 4
                if first is not None:
                    turns += distinct - (first == high)
                    low, high = first if low is None else low, last
            if len(out) >= 4096:
                yield _batch(out, CONVERSATIONS)
                out.clear()
        if key is not None:
            out.append(row())
        if out:
            yield _batch(out, CONVERSATIONS)

    return pieces.mapInArrow(run, CONVERSATIONS)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired pieces (see ``PIECES``) of rows ``(conv_id, turn, role, text, n)``: those that are conversations by themselves, and those
    of conversations that may have several, in order of (part, piece)."""
    prepare(rows.sparkSession)
    cut = stash(blocks(faults(rows)), "blocks")
    end = F.array(*[F.lit(c).cast("long") for c, _ in END])
    alone = cut.where("whole").withColumn("entry", F.lit(0)).withColumn("left", end)
    shared = cut.where("NOT whole")
    return repaired(alone), repaired(shared.join(crossings(shared), ["part", "piece"]))


def repaired_conversations(df: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``(conv_id, turn, role, text)``, damaged and repaired: see ``CONVERSATIONS``."""
    alone, shared = repair(damage(df))
    shared = shared.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    found = summed_up(alone).unionByName(summed_up(shared)).withColumnRenamed("conv_id", "of")
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.select("conv_id", *[F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in
                                     (x.split()[0] for x in CONVERSATIONS.split(", ")) if c != "conv_id"])
