"""Toxicity (operator 13).

Method: a support vector machine over a subsequence string kernel with Nystroem landmarks.  Two words are
alike by the subsequences of three and four characters they share; one that spans s characters counts
``DECAY ** s``, up to ``SPAN`` characters, so gapped and inserted-character spellings of a word stay
near it.  Word ends count as characters.  The kernel of two sentences is the sum over their distinct words, each
scaled by what its length alone makes of it.  Landmarks are words that tell toxic documents from
others, the usual words of the others, and those of them nearest to the former.  A sentence becomes the vector of its kernels with the landmarks, whitened
by the landmarks' own kernel matrix, and a linear support vector machine (squared hinge) is trained
on sentences.

Labels are those of documents, so the sentences of a toxic document are a bag: one of them, first
that with the most telling word, then the one of the highest score, stands for it.  A document
scores by its highest sentences (a soft maximum) and by how many are high, through a logistic fitted to
training documents that the machine has not seen.

The machine is linear in the kernel, so landmarks, whitening and weights fold into one number for
each subsequence: scoring looks up a word's subsequences in two arrays, once for each distinct word.

Defined results: fitting uses at most ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` characters of
each class, those of the least hash; scoring reads every word of every text.  A null or empty text has
no sentence and the score of the lowest one; a document with several labels counts once, with the
largest; null labels are ignored; rows of a repeated ``doc_id`` are scored one by one; without
documents of both classes every score is the share of class 1 among those known, or 0.5 without
any; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, discard, prepare, stash, texts

SPAN, DECAY, ORDERS = 7, 0.8, (3, 4)
#: Characters of landmarks that may match; bits of a character's number; the numbers of word begin and end.
ALPHABET, BITS, BEGIN, END = 60, 6, 1, 2
#: Words of a sentence at most; longer runs without an end are cut there.
SENTENCE_WORDS = 16
#: Landmarks: telling words, usual words, and those of the most usual ``OTHERS`` that are nearest to the telling ones.
TELLING, USUAL, NEAR, OTHERS = 240, 64, 96, 20_000
#: Training documents, and their characters, of each class at most; words up to so many characters are remembered, so many of them.
SAMPLE_DOCS, SAMPLE_CHARS, MEMO_CHARS, MEMO_SIZE = 4000, 6_000_000, 48, 400_000
#: Characters of texts that are scored at once.
BLOCK_CHARS = 2 << 20
#: Rounds of choosing sentences, sentences of a document that is not toxic added in each, and the weight of the loss.
ROUNDS, HARD, LOSS_WEIGHT = 4, 2, 300.0

#: Sharpness of the soft maximum of sentence scores, and the score above which they count.
SOFT, FLOOR = 8.0, -0.5

_ENDS = re.compile(r"[.!?…。！？]+(?=\s|$)|\n+")
_SYMBOLS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\w)")


def sentences(text: str) -> list[set[str]]:
    """The distinct words of each sentence, in lower case; letters that stand alone one after another are one word."""
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text.lower())
    out = []
    for part in _ENDS.split(text):
        words = part.split()
        out += [set(words[k:k + SENTENCE_WORDS]) for k in range(0, len(words), SENTENCE_WORDS)]
    return out


def patterns(order: int) -> list[tuple[int, ...]]:
    """Places of the further characters of a subsequence behind its first one."""
    return [(*inner, last) for last in range(order - 1, SPAN) for inner in combinations(range(1, last), order - 2)]


_PATTERNS = [p for order in ORDERS for p in patterns(order)]


def scale(lengths: np.ndarray) -> np.ndarray:
    """The norm of a word of so many characters whose subsequences all differ."""
    places = lengths[:, None] + 2 - np.array([p[-1] for p in _PATTERNS])
    return np.sqrt(np.maximum(places, 0) @ np.array([DECAY ** (2 * (p[-1] + 1)) for p in _PATTERNS]) + 1e-9)


@dataclass
class Words:
    """Words as numbers of characters, one after another, with their ends as characters of their own."""

    code: np.ndarray
    begin: np.ndarray
    left: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, words: list[str], numbers: np.ndarray) -> Words:
        words = [w if w.isalnum() else _SYMBOLS.sub("", w) for w in words]
        size = np.array([len(w) for w in words], np.int64)
        begin = np.r_[0, np.cumsum(size + 2)]
        code = numbers[np.frombuffer(" ".join(["", *("".join((w, " ")) for w in words)]).encode("utf-32-le", "surrogatepass"), "<u4")[:begin[-1]]]
        code[begin[:-1]], code[begin[1:] - 1] = BEGIN, END
        left = np.repeat(begin[1:], size + 2) - np.arange(begin[-1])
        return cls(code, begin[:-1], left, scale(size))

    def keys(self) -> Iterable[tuple[int, float, np.ndarray, np.ndarray]]:
        """For each pattern: its order, its weight, where it begins and the number of the subsequence there."""
        code, at = self.code, {}
        for p in _PATTERNS:
            if p[-1] not in at:
                at[p[-1]] = np.flatnonzero(self.left > p[-1])
            own = at[p[-1]]
            key = code[own]
            for step in p:
                key = key << BITS | code[own + step]
            yield len(p) + 1, DECAY ** (p[-1] + 1), own, key


def _sums(values: np.ndarray, words: Words) -> np.ndarray:
    return np.add.reduceat(values, words.begin, axis=0) if len(words.begin) else values


@dataclass
class Landmarks:
    """Landmark words and, for each subsequence that some of them have, its weight in each."""

    words: list[str]
    numbers: np.ndarray = field(init=False)
    keys: dict[int, np.ndarray] = field(init=False)
    weights: dict[int, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        common = Counter(c for w in self.words for c in w if ord(c) < 0x110000)
        self.numbers = np.zeros(0x110000, np.int32)
        for k, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]):
            self.numbers[ord(c)] = k + 3
        own = Words.of(self.words, self.numbers)
        word_of = np.repeat(np.arange(len(self.words)), np.diff(np.r_[own.begin, len(own.code)]))
        found: dict[int, list[tuple[np.ndarray, np.ndarray, float]]] = {order: [] for order in ORDERS}
        for order, weight, at, key in own.keys():
            found[order].append((key, word_of[at], weight))
        self.keys, self.weights = {}, {}
        for order, parts in found.items():
            key = np.concatenate([k for k, _, _ in parts])
            full = np.ones(len(key), bool)
            for place in range(order):
                full &= (key >> BITS * place & (1 << BITS) - 1) > 0
            names, row = np.unique(key[full], return_inverse=True)
            w = np.zeros((len(names), len(self.words)))
            np.add.at(w, (row, np.concatenate([x for _, x, _ in parts])[full]), np.concatenate([np.full(len(k), v) for k, _, v in parts])[full])
            self.keys[order], self.weights[order] = names, w / own.norm

    def kernel(self, words: list[str], block: int = 200) -> np.ndarray:
        """Kernels of words with the landmarks."""
        out = np.zeros((len(words), len(self.words)))
        row = {}
        for order, names in self.keys.items():
            row[order] = np.full(1 << BITS * order, -1, np.int32)
            row[order][names] = np.arange(len(names))
        for low in range(0, len(words), block):
            own = Words.of(words[low:low + block], self.numbers)
            word_of = np.repeat(np.arange(len(own.begin)), np.diff(np.r_[own.begin, len(own.code)]))
            sums = {o: np.zeros((len(own.begin), 0)) for o in ORDERS}
            for order in ORDERS:
                cells, values = [], []
                for o, weight, at, key in own.keys():
                    if o == order:
                        hit = row[order][key]
                        some = hit >= 0
                        cells.append(word_of[at[some]] * len(self.keys[order]) + hit[some])
                        values.append(np.full(len(cells[-1]), weight))
                cell, where = np.unique(np.concatenate(cells), return_inverse=True)
                value = np.bincount(where, np.concatenate(values), minlength=len(cell))
                word, name = np.divmod(cell, max(len(self.keys[order]), 1))
                total = np.zeros((len(own.begin), len(self.words)))
                if len(cell):
                    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                    total[word[first]] = np.add.reduceat(self.weights[order][name] * value[:, None], first, axis=0)
                sums[order] = total
            out[low:low + block] = sum(sums.values()) / own.norm[:, None]
        return out


def hinge_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: float, steps: int = 30, block: int = 4096) -> tuple[np.ndarray, float]:
    """Least |w|^2 / 2 + loss * sum of weight * max(0, 1 - y (x w + b))^2, by Newton steps on the rows inside the margin."""
    n, m = x.shape
    ridge = np.r_[np.ones(m), 1e-6]
    w = np.zeros(m + 1)

    def slack(w: np.ndarray) -> np.ndarray:
        return 1 - y * (np.concatenate([x[k:k + block].astype(np.float64) @ w[:-1] for k in range(0, n, block)]) + w[-1])

    def cost(w: np.ndarray) -> float:
        return float(ridge @ (w * w)) / 2 + loss * float(weight @ np.maximum(0, slack(w)) ** 2)

    now = cost(w)
    for _ in range(steps):
        left = slack(w)
        gradient, curve = ridge * w, np.diag(ridge)
        on = np.flatnonzero(left > 0)
        for k in range(0, len(on), block):
            rows = on[k:k + block]
            own = np.c_[x[rows], np.ones(len(rows))].astype(np.float64)
            share = own * (2 * loss * weight[rows])[:, None]
            gradient = gradient - share.T @ (y[rows] * left[rows])
            curve = curve + share.T @ own
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-4 and cost(w - size * step) > now:
            size /= 2
        new = cost(w - size * step)
        if new > now * (1 - 1e-7):
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


@dataclass
class Machine:
    """Weights of subsequences, the sentence bias, and the logistic of what :func:`document` says of a document's sentences; ``lowest`` stands
    for the only sentence where it has none."""

    numbers: np.ndarray
    keys: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    bias: float
    slopes: np.ndarray
    offset: float
    lowest: float
    memo: dict[str, float] = field(default_factory=dict, repr=False)
    tables: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "tables": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence."""
        if not self.tables:
            for order, names in self.keys.items():
                self.tables[order] = np.zeros(1 << BITS * order, np.float32)
                self.tables[order][names] = self.values[order]
        own = Words.of(words, self.numbers)
        total = np.zeros(len(own.code), np.float32)
        for order, weight, at, key in own.keys():
            total[at] += np.float32(weight) * self.tables[order][key]
        return _sums(total, own) / own.norm

    def sentence_scores(self, bags: list[list[set[str]]]) -> list[list[float]]:
        """Scores of the sentences of each document."""
        memo = self.memo
        new = [w for w in set().union(*(s for bag in bags for s in bag)) if w not in memo]
        now = {}
        for low in range(0, len(new), 20_000):
            now.update(zip(new[low:low + 20_000], self.word_scores(new[low:low + 20_000]).tolist(), strict=True))
        if len(memo) + len(now) > MEMO_SIZE:
            now.update((w, memo[w]) for bag in bags for s in bag for w in s if w in memo)
            memo.clear()
        memo.update(now)
        out = [[sum([memo[w] for w in s]) + self.bias for s in bag] for bag in bags]
        for w in [w for w in now if len(w) > MEMO_CHARS]:
            del memo[w]
        return out

    def described(self, bags: list[list[set[str]]]) -> np.ndarray:
        return np.array([document(s or [self.lowest]) for s in self.sentence_scores(bags)], np.float64).reshape(-1, 2)

    def score(self, described: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(described @ self.slopes + self.offset, -500, 500)))


def document(scores: list[float]) -> tuple[float, float]:
    """Soft maximum of a document's sentence scores, and how far they rise above ``FLOOR``, over the root of their number."""
    top = max(scores)
    soft = top + math.log(sum([math.exp(SOFT * (s - top)) for s in scores])) / SOFT
    return soft, sum([s - FLOOR for s in scores if s > FLOOR]) / math.sqrt(len(scores))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Slopes, none below zero, and offset of a logistic, by Newton steps with a slight pull to zero."""
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.c_[x[:, used], np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-3 * w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = w[:-1]
            return out, float(w[-1])
        used[np.flatnonzero(used)[np.argmin(w[:-1])]] = False


@dataclass
class Bags:
    """Documents as bags of sentences: ``word`` numbers in ``names``, where each sentence begins, and the document of each sentence."""

    names: list[str]
    word: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    docs: int

    @classmethod
    def of(cls, bags: Iterable[list[set[str]]]) -> Bags:
        place: dict[str, int] = {}
        word, begin, doc, n = array("i"), array("q", [0]), array("i"), 0
        for bag in bags:
            for s in bag:
                word.extend([place.setdefault(w, len(place)) for w in sorted(s)])
                begin.append(len(word))
                doc.append(n)
            n += 1
        return cls(list(place), np.array(word, np.int64), np.array(begin, np.int64), np.array(doc, np.int64), n)

    @property
    def sentence(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc)), np.diff(self.begin))

    def summed(self, each: np.ndarray) -> np.ndarray:
        """The sum over each sentence's words of ``each`` name's value."""
        return np.bincount(self.sentence, each[self.word], minlength=len(self.doc))


def telling_words(bags: Bags, y: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each word's share of toxic documents lies above that of the others, in standard errors (0 for single letters and very long
    words); and how many of the others have it.  Only documents in ``seen`` count."""
    pair = np.unique(bags.doc[bags.sentence] * len(bags.names) + bags.word)
    doc, word = pair // max(len(bags.names), 1), pair % max(len(bags.names), 1)
    have = [np.bincount(word[seen[doc] & (y[doc] == c)], minlength=len(bags.names)) for c in (0, 1)]
    n = [int((seen & (y == c)).sum()) for c in (0, 1)]
    p, q = (have[1] + 0.5) / (n[1] + 1), (have[0] + 0.5) / (n[0] + 1)
    lift = (p - q) / np.sqrt(p * (1 - p) / n[1] + q * (1 - q) / n[0])
    plain = np.array([1 < len(w) <= MEMO_CHARS for w in bags.names], bool)
    return np.where(plain & (have[1] > 0), lift, 0.0), np.where(plain, have[0], 0)


def fit(documents: Iterable[list[set[str]]], y: np.ndarray, share: float) -> Machine | float:
    """The machine of documents, given as bags of sentences, with labels 0 and 1; ``share``, that of class 1 among all known labels, if one
    class is missing.  Every fourth document is kept from the machine and fits the logistic, in which the classes weigh
    midway between equally and as in all labels (their odds are the square root of those).

    Each round adds the highest sentences of every document that is not toxic to the negative rows and chooses the sentences that
    stand for the toxic ones anew.
    """
    if not len(y) or y.min() == y.max():
        return share
    bags = Bags.of(documents)
    apart = np.zeros(len(y), bool)
    for c in (0, 1):
        apart[np.flatnonzero(y == c)[3::4]] = True
    lift, usual = telling_words(bags, y, ~apart)
    order = sorted(np.flatnonzero(lift > 2).tolist(), key=lambda k: (-lift[k], bags.names[k]))[:TELLING]
    telling = [bags.names[k] for k in order]
    skip = set(order)
    plain = [bags.names[k] for k in sorted(np.flatnonzero(usual).tolist(), key=lambda k: (-usual[k], bags.names[k]))[:OTHERS + TELLING] if k not in skip]
    chosen = telling + plain[:USUAL]
    if telling:
        others = plain[USUAL:OTHERS]
        close = Landmarks(telling).kernel(others).max(axis=1) if others else np.zeros(0)
        chosen += [others[k] for k in np.lexsort((np.arange(len(others)), -close))[:NEAR]]
    marks = Landmarks(chosen or ["-"])
    own = marks.kernel(marks.words)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > 1e-6 * values.max(initial=1e-9)
    white = vectors[:, kept] / np.sqrt(values[kept])

    def machine(alpha: np.ndarray, bias: float) -> Machine:
        return Machine(marks.numbers, marks.keys, {o: (v @ alpha).astype(np.float32) for o, v in marks.weights.items()}, bias, np.zeros(2), 0.0, 0.0)

    def ranked(m: Machine) -> np.ndarray:
        each = np.concatenate([m.word_scores(bags.names[k:k + 20_000]) for k in range(0, len(bags.names), 20_000)] or [np.zeros(0)])
        return bags.summed(each) + m.bias

    def features(rows: list[int]) -> np.ndarray:
        """Whitened kernels of sentences with the landmarks."""
        out = np.zeros((len(rows), white.shape[1]), np.float32)
        for low in range(0, len(rows), 1024):
            some = rows[low:low + 1024]
            words = [bags.word[bags.begin[r]:bags.begin[r + 1]] for r in some]
            names, where = np.unique(np.concatenate(words), return_inverse=True)
            vector = marks.kernel([bags.names[k] for k in names.tolist()]) @ white
            first = np.cumsum([0, *map(len, words)])[:-1]
            out[low:low + len(some)] = np.add.reduceat(vector[where], first, axis=0)
        return out

    toxic, learned = y[bags.doc] == 1, ~apart[bags.doc]
    near = np.zeros(len(marks.words))
    near[:len(telling)] = 1 / max(len(telling), 1)
    told = np.zeros(len(bags.doc))
    np.maximum.at(told, bags.sentence, lift[bags.word])
    rank = np.where(toxic, told, ranked(machine(near, 0.0)))
    known, x = {}, np.zeros((0, white.shape[1]), np.float32)
    negative: set[int] = set()
    found = None
    for _ in range(ROUNDS):
        order = np.lexsort((np.arange(len(bags.doc)), -rank, bags.doc))
        order = order[learned[order]]
        begin = np.flatnonzero(np.r_[True, bags.doc[order][1:] != bags.doc[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        place_in_doc = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        positive = order[(place_in_doc == 0) & toxic[order]].tolist()
        negative.update(order[(place_in_doc < HARD) & ~toxic[order]].tolist())
        if not positive or not negative:
            return share
        rows = positive + sorted(negative)
        new = [r for r in rows if r not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        x = np.concatenate([x, features(new)])
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        weight = np.where(sign > 0, 0.5 / len(positive), 0.5 / len(negative))
        w, b = hinge_machine(x[[known[r] for r in rows]], sign, weight, LOSS_WEIGHT)
        found = machine(white @ w, b)
        rank = ranked(found)
    if len(set(y[apart].tolist())) < 2:
        apart[:] = True  # too few documents to keep any from the machine
    found.lowest = float(rank.min(initial=0.0))
    edges = np.searchsorted(bags.doc, np.arange(bags.docs + 1))
    described = np.array([document(rank[edges[k]:edges[k + 1]].tolist() or [found.lowest]) for k in np.flatnonzero(apart)]).reshape(-1, 2)
    kept_y, odds = y[apart], math.sqrt(share / (1 - share))
    weight = np.where(kept_y == 1, odds / kept_y.mean(), 1 / (1 - kept_y.mean())) / (1 + odds)
    found.slopes, found.offset = logistic(described, kept_y.astype(float), weight)
    return found


def held_out(doc_id) -> F.Column:
    """Rows whose labels no fit may see: CRC-32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``(doc_id, label)``: one label, 0 or 1, for each document that is not held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return rows.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(documents: DataFrame, known: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from: of each class the ``SAMPLE_DOCS`` documents of the least hash, as far as ``SAMPLE_CHARS`` characters
    go.  Documents of over a twentieth of these are left out, and one id counts once, with its least text."""
    lot = F.xxhash64(F.lit("sample"), "doc_id")
    known = known.withColumn("lot", lot)
    ids = known.where("label = 1").orderBy("lot", "doc_id").limit(SAMPLE_DOCS).unionByName(known.where("label = 0").orderBy("lot", "doc_id").limit(SAMPLE_DOCS))
    rows = texts(documents).join(F.broadcast(ids), "doc_id").where(F.length("text") <= SAMPLE_CHARS // 20)
    rows = stash(rows.groupBy("doc_id", "label", "lot").agg(F.min("text").alias("text")), "sample")
    sizes = rows.select("label", "lot", "doc_id", F.length("text").alias("n")).collect()
    last = {}
    for c in (0, 1):
        total = 0
        for r in sorted((r for r in sizes if r["label"] == c), key=lambda r: (r["lot"], r["doc_id"])):
            total += r["n"]
            if total > SAMPLE_CHARS:
                break
            last[c] = r["lot"]
    taken = rows.where(" OR ".join(f"label = {c} AND lot <= {lot}" for c, lot in last.items()) or "false").orderBy("label", "lot", "doc_id").toArrow()
    discard(rows)
    return taken.column("text").to_pylist(), np.array(taken.column("label").to_pylist(), np.int64)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine | float:
    """The machine learned from the labels that are not held out, or a constant score."""
    known = known_labels(labels, label)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    said, y = sample(documents, known) if len(counts) == 2 else ([], np.zeros(0, np.int64))
    return fit(map(sentences, said), y, share)


def classify(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted, sentence)`` for every row of ``documents``; ``sentence`` is the soft maximum of the
    sentence scores, before the logistic."""
    spark = documents.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(train(documents, labels, label))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, said = sent.value, batch.column(1).to_pylist()
        if isinstance(machine, Machine):
            described, low, size = [], 0, 0
            for k, t in enumerate(said):
                size += len(t)
                if size > BLOCK_CHARS or k + 1 == len(said):
                    described.append(machine.described([sentences(x) for x in said[low:k + 1]]))
                    low, size = k + 1, 0
            found = np.concatenate(described)
            top, score = found[:, 0], machine.score(found)
        else:
            top, score = np.zeros(len(said)), np.full(len(said), machine)
        return pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32()), pa.array(top, pa.float64())],
                               names=["doc_id", "score", "predicted", "sentence"])

    scored = arrow_map(texts(documents), rows, "doc_id long, score double, predicted int, sentence double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "sentence")
