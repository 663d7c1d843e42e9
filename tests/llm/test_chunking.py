"""Content-defined chunking: cuts, containment, and the order of documents."""

import hashlib
import random

import numpy as np

from churnkit.llm import chunking, queries
from tests.conftest import SF
from tests.llm.helpers import docs, words


def slow_cuts(data):
    """The rule, byte by byte."""
    gear = chunking.GEAR.tolist()
    h, at, out = [], 0, []
    for i in range(len(data)):
        h.append(sum(gear[data[i - j]] << j for j in range(min(i + 1, 32))) % 2**32)
    while len(data) - at > chunking.LEAST:
        end = at + chunking.LEAST
        while end < min(len(data), at + chunking.MOST):
            bits = chunking.HARD_BITS if end < at + chunking.NORMAL else chunking.EASY_BITS
            if h[end - 1] >> (32 - bits) == 0:
                break
            end += 1
        at = min(end, len(data))
        out.append(at)
    return out + [len(data)] * (at < len(data))


def test_cuts_follow_the_rule():
    r = random.Random(4)
    for n in [0, 1, 12, 13, 31, 33, 500, 5000]:
        data = bytes(r.choice(b"the quick brown fox, ") for _ in range(n))
        assert chunking.cuts(data) == slow_cuts(data)
    assert chunking.cuts(b"a" * 1000) == slow_cuts(b"a" * 1000)


def test_insertions_move_few_cuts_and_strings_round_trip():
    text = words(3000, 1)
    own, moved = chunking.chunk_set(text), chunking.chunk_set("some more words " + text)
    assert chunking.containment(own, moved) > 0.99
    assert (chunking.from_string(chunking.as_string(own)) == own).all()
    none = chunking.chunk_set("")
    assert chunking.containment(none, none) == 1 and chunking.containment(none, own) == 0 and chunking.containment(own, none) == 0


def expected(rows):
    import xxhash

    as_long = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, as_long(r[1])))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 4
        e = t[:len(t) - m] + u[:m]
        a, b, c = map(chunking.chunk_set, (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), chunking.as_string(a), chunking.as_string(b),
                    chunking.containment(a, b), chunking.containment(a, c)))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    docs(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op7_fingerprints(spark, str(tmp_path)).collect()), key=str)


def test_frame_cases(spark, tmp_path):
    rows = [(5, words(40, 1)), (7, None), (8, ""), (9, words(9000, 2)), (10, "日本語テキスト"), (10, "日本語テキスト"), (11, "a"), (-3, "é" * 400), (None, "no id")]
    assert run(spark, tmp_path / "a", rows) == expected(rows)
    assert run(spark, tmp_path / "b", [(1, words(50, 3))]) == expected([(1, words(50, 3))])
    assert run(spark, tmp_path / "c", []) == []
    many = [(i * 3, f"{i} " + words(30, i)) for i in range(200)]
    assert run(spark, tmp_path / "d", many) == expected(many)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op7_fingerprints(spark, SF).collect()), key=str)
    assert got == expected(rows)
    assert np.median([r[5] for r in got]) > 0.65
