"""Conversation repair: Hirschberg against a search over whole audits, blocks against whole conversations, damage and faults."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnkit.llm import queries, repair
from churnkit.llm.common import table
from tests.conftest import SF

ROWS = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def least(rows):
    """Cost and audit of the cheapest, then least, edits for rows (initial, fault), by holding a whole audit for each last initial."""
    best = {"": (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for state, (cost, audit) in list(out.items()):
                for nxt in NEXT[state].values():
                    if nxt != "s":
                        out[nxt] = min(out.get(nxt, (10**9, "")), (cost + 3, audit + "I"))
        return out

    # an audit that is worse at one state may not be dropped for another state's, so states are kept apart
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in inserted(best).items():
            def offer(to, c, op):
                new[to] = min(new.get(to, (10**9, "")), (cost + c, audit + op))  # noqa: B023
            offer(state, 4, "D")
            if fault in ("none", "truncated"):
                extra = 3 * (fault == "truncated")
                if initial in NEXT[state]:
                    offer(NEXT[state][initial], extra, "K")
                for to in NEXT[state].values():
                    if to != "s":
                        offer(to, 3 + extra, "R")
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


CODED = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(repair.FAULTS)), max_size=14)


def code(initial, fault):
    return 4 * repair.FAULTS.index(fault) + "suax".index(initial)


def solved(codes):
    by_row, state = repair.edits(codes, 0, [c for c, _ in repair.END])
    return "".join(by_row) + repair.END[state][1]


@given(CODED)
@settings(max_examples=400, deadline=None)
def test_least_of_the_cheapest_edits(rows):
    assert solved(bytes(code(*r) for r in rows)) == least(rows)[1]


@given(CODED, st.lists(st.integers(0, 14), max_size=4))
@settings(max_examples=300, deadline=None)
def test_blocks_meet_where_the_whole_crosses(rows, cuts):
    codes = bytes(code(*r) for r in rows)
    at = sorted({0, len(codes), *(min(c, len(codes)) for c in cuts)})
    parts = [codes[a:b] for a, b in zip(at, at[1:])]
    vector, before = repair.start(0), []
    for p in parts:
        before.append(vector)
        vector = repair.along(vector, repair.ways(p))
    left, audit = [c for c, _ in repair.END], []
    for p, v in zip(reversed(parts), reversed(before)):
        through = repair.ways(p)
        reach = [min(through[e][y] + left[y] for y in range(4)) for e in range(4)]
        by_row, state = repair.edits(p, repair.crossing(v, reach), left)
        if not audit:
            by_row.append(repair.END[state][1])
        audit, left = by_row + audit, reach
    assert "".join(audit) == least(rows)[1]


def expected(rows):
    """The contract, one conversation after another."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if lot == 0:
                continue
            text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
            damaged += [(turn, "user" if lot == 4 else role, text)] * (1 + (lot == 3))
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in damaged if t is not None}
        seen, coded = set(), []
        for _, role, text in damaged:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "none" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            coded.append((role[:1] if role[:1] in tuple("sua") else "x", fault))
        cost, audit = least(coded)
        lines, state, k = [], "", 0
        for op in audit:
            if op == "D":
                k += 1
                continue
            nxt = coded[k][0] if op == "K" else next(x for x in NEXT[state].values() if x != "s")
            state = nxt
            own = {"u": "user", "a": "assistant"}.get(nxt)
            if op != "I":
                lines.append(f"{damaged[k][1] if op == 'K' else own}:{damaged[k][2]}")
                k += 1
            else:
                lines.append(f"{own}:")
        pairs = zip(damaged, damaged[1:])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == x for _, f in coded) for x in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(df):
    found = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len(found) == len({r[0] for r in found})
    return {r[0]: r[1:] for r in found}


def made(n, seed):
    r = random.Random(seed)
    texts = ["Yes.", "Yes", "no!", " \t", "", None, "é?", "A long line. And more", "x\ny."]
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, *range(40)]), r.choice(["user", "assistant", "system", "tool", "", None, "use"]), r.choice(texts)) for _ in range(n)]
    return rows + [(9, k, ("user", "assistant")[k % 2], f"said {k}.") for k in range(3000)] + [(7, 1, "user", "same")] * 50


@pytest.mark.parametrize("limit", [7, 2048])
def test_operator_on_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(repair, "BLOCK_ROWS", limit)
    rows = made(600, limit)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS part", "'x' AS piece", "'x' AS codes", "'x' AS said", "1 AS n", "'x' AS entry")
    assert rows_of(repair.repaired_conversations(df.repartition(5))) == expected(rows)


def test_one_conversation_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_CHARS", 100)
    rows = [(1, k, r, t) for k, (r, t) in enumerate(random.Random(4).choices([("user", "Hi."), ("assistant", "Ho."), ("system", "S"), ("user", "")], k=500))]
    rows += [(None, 2**62, "user", "far."), (None, -2**62, "user", "near."), (3, 1, "user", "long " * 50_000)]
    df = spark.createDataFrame([(a, b, c, f"{t} {b}." if t else t) for a, b, c, t in rows], ROWS)
    assert rows_of(repair.repaired_conversations(df)) == expected([tuple(r) for r in df.collect()])


def test_empty_table_and_dropped_conversations(spark):
    assert repair.repaired_conversations(spark.createDataFrame([], ROWS)).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found = repair.repaired_conversations(spark.createDataFrame([(conv, 1, "user", "Hi.")], ROWS)).collect()
    assert [tuple(r) for r in found] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_conversation_repair(spark, SF)) == expected(rows)
