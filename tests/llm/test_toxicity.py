"""Toxicity: the kernel against counted subsequences, folding, the machine, tolerance of odd spellings, held-out accuracy."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnkit.llm import queries, toxicity
from churnkit.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import docs

WORD = st.text(st.sampled_from("abcxé"), min_size=1, max_size=9)
INSULTS = ["worthless", "moron", "pathetic"]


def subsequences(word):
    """Weights of the subsequences of a word, counted one by one."""
    full, out = f"\x01{word}\x02", Counter()
    for order in toxicity.ORDERS:
        for places in combinations(range(len(full)), order):
            if places[-1] - places[0] < toxicity.SPAN:
                out["".join(full[p] for p in places)] += toxicity.DECAY ** (places[-1] - places[0] + 1)
    return out


@given(st.lists(WORD, min_size=1, max_size=5, unique=True), st.lists(WORD, min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_kernel_counts_gapped_subsequences(marks, words):
    found = toxicity.Landmarks(marks).kernel(words)
    norm = lambda w: float(toxicity.scale(np.array([len(w)]))[0])
    alphabet = set("".join(marks)) | {"\x01", "\x02"}
    for i, w in enumerate(words):
        own = {k: v for k, v in subsequences(w).items() if set(k) <= alphabet}
        for j, m in enumerate(marks):
            other = subsequences(m)
            assert found[i, j] == pytest.approx(sum(v * other[k] for k, v in own.items()) / norm(w) / norm(m))


def test_scale_is_the_norm_of_words_without_equal_subsequences():
    for w in ("a", "abc", "abcdefghijkl"):
        assert toxicity.scale(np.array([len(w)]))[0] ** 2 == pytest.approx(sum(v * v for v in subsequences(w).values()))


def test_folded_weights_are_the_weighted_kernel():
    r = np.random.default_rng(1)
    marks = toxicity.Landmarks(["moron", "the", "of", "pathetic"])
    alpha = r.normal(size=4)
    m = toxicity.Machine(marks.numbers, marks.keys, {o: (v @ alpha).astype(np.float32) for o, v in marks.weights.items()}, 0.5, np.ones(2), 0.0, -1.0)
    words = ["moron", "mo-ron", "path", "thetic", "日本", "", "...", "x" * 5000]
    assert m.word_scores(words) == pytest.approx(marks.kernel(words) @ alpha, abs=1e-5)
    assert m.sentence_scores([[{"moron", "of"}], []]) == [[pytest.approx(float((marks.kernel(["moron", "of"]) @ alpha).sum() + 0.5), abs=1e-5)], []]
    assert m.described([[]]).tolist() == [[-1.0, 0.0]] and not any(len(w) > toxicity.MEMO_CHARS for w in m.memo)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO_SIZE", 20)
    marks = toxicity.Landmarks(["moron"])
    m = toxicity.Machine(marks.numbers, marks.keys, {o: v[:, 0].astype(np.float32) for o, v in marks.weights.items()}, 0.0, np.ones(2), 0.0, -1.0)
    bags = [[{f"w{k}", "moron", f"v{k}"}] for k in range(50)]
    assert [m.sentence_scores([b])[0] for b in bags] == m.sentence_scores(bags) and len(m.memo) <= 101


def test_machine_is_at_its_least():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(200, 5)), np.sign(r.normal(size=200))
    weight = np.full(200, 1 / 200)
    w, b = toxicity.hinge_machine(x, y, weight, 50.0)
    cost = lambda w, b: w @ w / 2 + 50 * float(weight @ np.maximum(0, 1 - y * (x @ w + b)) ** 2)
    assert all(cost(w, b) <= cost(w + r.normal(size=5) * s, b + r.normal() * s) + 1e-6 for s in (1e-3, 1e-1) for _ in range(50))


def test_sentences():
    assert toxicity.sentences("You  IDIOT. i d i o t! a b\nx") == [{"you", "idiot"}, {"idiot"}, {"a", "b"}, {"x"}]
    assert toxicity.sentences("v1.5 of it") == [{"v1.5", "of", "it"}] and toxicity.sentences(" \n") == []
    assert [len(s) for s in toxicity.sentences(" ".join(f"w{k}" for k in range(40)))] == [16, 16, 8]


def made(n, seed, rate=0.3):
    """Documents of invented words, some with an insult; and their labels."""
    r = random.Random(seed)
    syllables = ["ba", "do", "ti", "ren", "lo", "sha", "mi", "tor", "the", "on", "ing", "ly"]
    out, y = [], []
    for _ in range(n):
        parts = [["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(3, 12))] for _ in range(r.randint(1, 10))]
        toxic = r.random() < rate
        if toxic:
            parts[r.randrange(len(parts))].insert(1, r.choice(INSULTS))
        out.append(" ".join(" ".join(p).capitalize() + "." for p in parts))
        y.append(int(toxic))
    return out, np.array(y)


@pytest.fixture(scope="module")
def machine():
    said, y = made(600, 1)
    return toxicity.fit([toxicity.sentences(t) for t in said], y, float(y.mean()))


def test_held_out_documents(machine):
    said, y = made(400, 2)
    s = machine.score(machine.described([toxicity.sentences(t) for t in said]))
    assert ((s >= 0.5) == y).mean() > 0.98


@pytest.mark.parametrize("spelling", ["m.o.r.o.n", "mor-on", "m o r o n", "MORON!!!", "worth-less", "wortthless", "worthl3ss", "patheetic", "pathxetic"])
def test_odd_spellings_are_nearer_than_plain_words(machine, spelling):
    odd, plain = (max(machine.sentence_scores([toxicity.sentences(f"Badoti lo {w} rensha mi.")])[0]) for w in (spelling, "torlydo"))
    whole = max(machine.sentence_scores([toxicity.sentences("Badoti lo worthless rensha mi.")])[0])
    assert odd > plain + 0.3 * (whole - plain)


def test_one_class_and_few_documents():
    bags = [toxicity.sentences(t) for t in ("One two.", "Three.")]
    assert toxicity.fit(bags, np.array([1, 1]), 0.25) == 0.25 and toxicity.fit([], np.zeros(0), 0.5) == 0.5
    found = toxicity.fit(bags, np.array([1, 0]), 0.5)
    s = found.score(found.described(bags)) if isinstance(found, toxicity.Machine) else np.array([found] * 2)
    assert ((s >= 0) & (s <= 1)).all()


LABELS = "doc_id long, quality int, toxic int"


def test_operator_on_odd_rows(spark):
    said, y = made(300, 3)
    rows = [*enumerate(said), (1000, None), (1001, ""), (1002, " "), (1003, "x" * 200_000), (1004, "worthless " * 20_000), (5, said[5]), (None, "A moron.")]
    labels = [(k, 1, int(v)) for k, v in enumerate(y)] + [(1, None, None), (7, 0, 1), (None, 1, 1), (1002, 1, 5), (99999, 1, 1)]
    found = toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' AS label", "1 AS lot")).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((k for k, _ in rows), key=str)
    by = {r["doc_id"]: r for r in found}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert by[1004]["predicted"] == 1 and by[None]["predicted"] == 1 and by[1001]["predicted"] == by[1000]["predicted"] == 0


def test_held_out_labels_change_nothing(spark):
    said, y = made(200, 4)
    apart = [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(200)]
    frame = docs(spark, list(enumerate(said)))
    scores = [sorted(tuple(r) for r in toxicity.classify(frame, spark.createDataFrame([(k, 1, int(v ^ (off and flip))) for k, (v, off) in enumerate(zip(y, apart))], LABELS)).collect())
              for flip in (False, True)]
    assert scores[0] == scores[1]


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.classify(docs(spark, [(1, "x")]), none).collect()] == [0.5]
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS)
    assert {r["score"] for r in toxicity.classify(docs(spark, [(1, "x"), (2, "y")]), one).collect()} <= {0.5, 1.0}
    assert toxicity.classify(docs(spark, []), none).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 8000)
    said, y = made(300, 5)
    frame, labels = docs(spark, [*enumerate(said), (3, "a second text")]), spark.createDataFrame([(k, 1, int(v)) for k, v in enumerate(y)], LABELS)
    texts, label = toxicity.sample(frame, toxicity.known_labels(labels))
    assert all(sum(len(t) for t, v in zip(texts, label) if v == c) <= 8000 and (label == c).sum() <= 40 for c in (0, 1))
    assert max(map(len, texts)) <= 400 and set(label) == {0, 1}
    assert toxicity.sample(frame.repartition(7), toxicity.known_labels(labels))[0] == texts


def test_query_over_the_whole_table(spark):
    found = queries.op13_toxicity(spark, SF)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in table(spark, SF, "documents").collect())


def test_query_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    rows = queries.op13_toxicity(spark, sf).where("held_out").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("toxic IS NOT NULL").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    wins = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + (s[y == 1][:, None] == s[y == 0][None, :]).mean() / 2
    # some 350 toxic documents in four languages to learn from; ten times as many give 0.99
    assert len(y) > 600 and wins > 0.94
    assert (s[y == 1] >= 0.5).mean() > 0.75 and (s[y == 0] >= 0.5).mean() < 0.03
