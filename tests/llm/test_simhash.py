"""SimHash: fingerprints, covering, links and components against all pairs."""

import random
import re

import numpy as np
import xxhash

from churnkit.llm import queries, simhash
from churnkit.llm.components import components
from tests.conftest import SF
from tests.llm.helpers import docs, words


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_anchors_cover_and_are_within_two_bits():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**31, 500, dtype=np.uint64)
    index, words_ = simhash.anchors(x)
    assert (simhash._syndromes(words_) == 0).all() and (np.bitwise_count(words_ ^ x[index]) <= 2).all()
    assert len({(i, w) for i, w in zip(index.tolist(), words_.tolist())}) == len(index)
    y = x ^ (np.uint64(1) << r.integers(0, 31, 500).astype(np.uint64))
    own = {}
    for i, w in zip(index.tolist(), words_.tolist()):
        own.setdefault(i, set()).add(w)
    other = {}
    for i, w in zip(*(v.tolist() for v in simhash.anchors(y))):
        other.setdefault(i, set()).add(w)
    assert all(own[i] & other[i] for i in range(500))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(-5, 7000), (7000, -5), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000), -5: -5, 7000: -5}


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(200)}
    for _ in range(5):  # crowded balls: more than one block at some anchors, and small groups
        center = r.getrandbits(64)
        for _ in range(120):
            x = center
            for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5, 7])):
                x ^= 1 << b
            fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    want = slow_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    for block in (16, 2048):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = dict.fromkeys(signed)
        got = {x: x for x in got} | {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
        assert got == want


def brute(rows):
    fp = [(i, slow_fingerprint(t)) for i, t in rows]
    class_of = slow_components(sorted({f for _, f in fp}), lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, f in fp:
        if i is not None:
            least[class_of[f]] = min(i, least.get(class_of[f], i))
    return sorted(((i, f"{f:016x}", least.get(class_of[f])) for i, f in fp), key=str)


def test_frame_cases(spark, tmp_path):
    base = words(300, 1)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, base), (8, base.upper()), (9, base + " end"),
            (10, words(8000, 3)), (11, "É é\x1fx\x85y\xa0z"), (12, "a a a a a"), (12, "a a a a a"), (None, base), (None, "alone")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op8_simhash(spark, str(tmp_path)).collect()), key=str) == brute(rows)
    kept = simhash.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for i, _, c in brute(rows) if c == i and c is not None}, key=str) + [None]  # the other row without an id is a copy
    docs(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op8_simhash(spark, f"{tmp_path}/none").count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op8_simhash(spark, SF).collect()), key=str) == brute(rows)
