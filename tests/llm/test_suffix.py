"""Suffix-array dedup against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from churnkit.llm import queries, suffix
from tests.conftest import SF
from tests.llm.helpers import docs, words


def brute(rows, length=100):
    """Covered bytes of each text by a dictionary of all strings."""
    first, out = {}, []
    rows = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in sorted(rows):
        for a in range(len(raw) - length + 1):
            s = raw[a:a + length]
            first[s] = min(first.get(s, (i, a)), (i, a))
    for i, raw in rows:
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - length + 1):
            if first[raw[a:a + length]] < (i, a):
                gone[a:a + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((None if i == -(1 << 63) else i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, name="a"):
    docs(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r) for r in queries.op2_suffix_dedup(spark, f"{tmp_path}/{name}").collect()), key=str)


@pytest.mark.parametrize("length", [1, 3, 8, 100])
def test_intervals_hold_equal_prefixes(length):
    r = random.Random(length)
    symbols = np.array([r.choice([5, 6, 7]) for _ in range(400)] + [0])
    order, bwt = suffix.transform(symbols)
    text = symbols.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    got = suffix.expand(bwt, length)
    prefix = [tuple(text[i:i + length]) for i in order]
    assert [a == b for a, b in zip(got[1:], got[:-1])] == [a == b for a, b in zip(prefix[1:], prefix[:-1])]


def test_phrases_cover_each_string_once_and_follow_content():
    r = random.Random(3)
    texts = [bytes(r.choice(b"abc ") for _ in range(n)) for n in (0, 99, 100, 101, 500, 70_000, 3, 150)] + [b"a" * 400]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    data = memoryview(b"".join(texts))
    text, begin, strings, anchor = suffix.phrases(data, bounds)
    anchor_of = {}
    seen = set()
    for t, b, n, h in zip(text.tolist(), begin.tolist(), strings.tolist(), anchor.tolist()):
        for a in range(b, b + n):
            assert bounds[t] <= a and a + 100 <= bounds[t + 1] and a not in seen
            seen.add(a)
            assert anchor_of.setdefault(bytes(data[a:a + 100]), h) == h
    assert len(seen) == sum(max(0, len(t) - 99) for t in texts)


@pytest.fixture(params=["usual", "crowded", "small blocks"])
def limits(request, monkeypatch):
    if request.param == "crowded":
        monkeypatch.setattr(suffix, "CROWDED", 1)
    elif request.param == "small blocks":
        monkeypatch.setattr(suffix, "BLOCK_BYTES", 500)


def test_frame_cases(spark, tmp_path, limits):
    line = words(25, 99)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 350), (5, "ab" * 200), (6, words(600, 1)), (7, words(600, 1)), (8, words(300, 2) + " " + line + words(40, 3)),
            (9, line), (10, "x" + line + "é"), (11, "日本語" * 60), (12, "語" + "日本語" * 60), (None, line + "null"), (20, "z" * 99), (21, "z" * 100), (22, "z" * 100),
            (30, words(50, 5)), (30, words(50, 5)), (31, words(80, 6) + " " + words(80, 6)), (-4, words(30, 5) + " tail")]
    rows += [(100 + i, words(20, 1000 + i) + line + words(20, 2000 + i)) for i in range(12)]
    assert run(spark, tmp_path, rows) == brute(rows)
    assert run(spark, tmp_path, [], "none") == []


def test_cut_keeps_columns_and_whole_characters(spark):
    rows = [(1, "日本語" * 60), (2, "語" + "日本語" * 60 + " end"), (3, None), (4, words(60, 1)), (5, words(60, 1))]
    frame = docs(spark, rows)
    got = suffix.cut(frame)
    assert got.columns == frame.columns and got.dtypes == frame.dtypes
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[3] is None and text[4] == words(60, 1) and text[5] == "" and text[2].endswith(" end") and len(text[2]) < 20
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op2_suffix_dedup(spark, SF).collect()), key=str) == brute(rows)


def test_expansion_tells_rows_apart_by_their_first_symbols():
    for seed in range(6):
        r = np.random.default_rng(seed)
        base = r.integers(0, 3, 120).astype(np.int64) + 40
        parts = [np.r_[base[:r.integers(20, 120)], r.integers(40, 44, r.integers(1, 30)), k] for k in range(12)]
        symbols = np.concatenate(parts)
        order, bwt = suffix.transform(symbols)
        for length in (1, 2, 7, 40, 100):
            heads = [symbols[i:i + length].tolist() for i in order.tolist()]
            want = np.cumsum([False] + [a != b for a, b in zip(heads, heads[1:])])
            assert (suffix.expand(bwt, length) == want).all()
