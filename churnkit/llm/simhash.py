"""SimHash near-duplicates (operator 8).

Method: anchor-point covering.  Fingerprints have 64 bits.  Of two that differ in at most 3 bits,
one of two disjoint parts of 31 bits differs in at most one.  On each part the anchors are the words
of the Hamming code of length 31, whose covering radius is 1: replicating a fingerprint to every
anchor within 1 + 1 bits (one anchor, or 16) makes each such pair meet at the anchor nearest to
either.  Fingerprints are compared at their anchors, and each anchor passes on no more links than
connect what it has linked.

Equal texts share a fingerprint, and only distinct fingerprints are replicated and compared.  An
anchor with very many of them is cut into blocks, and each pair of blocks is compared by itself.

Defined results: null and empty texts have fingerprint zero; every document belongs to a component,
which may be itself alone; rows of a repeated ``doc_id`` are kept, each with its own fingerprint;
rows with a null ``doc_id`` are kept and name no component unless all of it is null; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, fresh, prepare, stash, texts
from churnkit.llm.components import components

SHINGLE, SEED, PART_BITS = 3, 42, 31
#: Fingerprints of a block of a crowded anchor.
BLOCK = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, h)`` for documents ``(doc_id, text)``; ``fp`` holds the 64 bits in a signed long, ``h`` is a hash of the whole text."""
    prepare(df.sparkSession)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fp, pa.int64()), batch.column(2)], names=["doc_id", "fp", "h"])

    return arrow_map(texts(df).withColumn("h", F.xxhash64("text")), rows, "doc_id long, fp long, h long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Exclusive or of the places (1 to 31) of the bits that are set."""
    out = np.zeros(len(x), np.uint64)
    for place in range(1, PART_BITS + 1):
        out ^= (x >> np.uint64(place - 1) & np.uint64(1)) * np.uint64(place)
    return out


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words within two bits of words of 31 bits: (index of the word, code word).

    A code word has syndrome 0.  Else the nearest one is one bit away, at the place the syndrome names, and those two
    bits away are at the pairs of places whose exclusive or is the syndrome.
    """
    s = _syndromes(x)
    index, words = [np.flatnonzero(s == 0)], [x[s == 0]]
    off = np.flatnonzero(s)
    bit = lambda place: np.uint64(1) << (place - np.uint64(1))
    index.append(off)
    words.append(x[off] ^ bit(s[off]))
    for place in range(1, PART_BITS + 1):
        a = np.uint64(place)
        b = s[off] ^ a
        some = (b > a)
        index.append(off[some])
        words.append(x[off][some] ^ bit(a) ^ bit(b[some]))
    return np.concatenate(index), np.concatenate(words)


def replicate(fps: DataFrame) -> DataFrame:
    """``(anchor, fp)`` for distinct fingerprints ``(fp)``."""

    def rows(batch: pa.RecordBatch) -> pa.Table:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        bits, keys, own = fp.view(np.uint64), [], []
        for part in (0, 1):
            index, words = anchors((bits >> np.uint64(part * PART_BITS)) & np.uint64((1 << PART_BITS) - 1))
            keys.append(words.astype(np.int64) | (part << PART_BITS))
            own.append(fp[index])
        return pa.table({"anchor": np.concatenate(keys), "fp": np.concatenate(own)})

    return arrow_map(fps.select("fp"), rows, "anchor long, fp long")


def _roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least row each row is connected to, by links (i, j), on top of what ``label`` has."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``bits`` in each run of equal keys."""
    n = len(fp)
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[begin, n])
    label, x = np.arange(n), fp.view(np.uint64)
    left = np.repeat(begin + size, size) - np.arange(n)  # rows of the run from here on
    small = np.repeat(size <= 64, size)
    i_all, j_all = [], []
    rows = np.flatnonzero(small & (left > 1))
    step = 1
    while len(rows):
        near = np.bitwise_count(x[rows] ^ x[rows + step]) <= bits
        i_all.append(rows[near])
        j_all.append(rows[near] + step)
        step += 1
        rows = rows[left[rows] > step]
    if i_all:
        label = _roots(n, np.concatenate(i_all), np.concatenate(j_all), label)
    for b, s in zip(begin[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        own = x[b:b + s]
        for at in range(0, s, 256):
            i, j = np.nonzero(np.bitwise_count(own[at:at + 256, None] ^ own[None, :]) <= bits)
            i += at
            keep = i < j
            label = np.concatenate([label[:b], _roots(s, i[keep], j[keep], label[b:b + s] - b) + b, label[b + s:]])
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fp)`` whose connections are those of all pairs within ``bits`` (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("two parts of 31 bits serve distances up to 3 bits")
    dealt = replicate(fps)
    crowded = dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"))))
    dealt = dealt.join(crowded, "anchor", "left").select("anchor", F.explode(pairs).alias("p"), "fp").select("anchor", "p.i", "p.j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([held, new])
            if not len(rows):
                continue
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held, rows = rows[last:], rows[:last]
            yield from found(rows)
        yield from found(held)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            runs = np.cumsum(np.r_[0, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            a, b = _compare(runs, np.ascontiguousarray(rows[:, 3]), bits)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, bits: int = 3) -> DataFrame:
    """``(doc_id, fp, h, component_id, root)``: the smallest ``doc_id`` that links of at most ``bits`` bits lead to, itself included, and the
    smallest fingerprint of the component."""
    own = stash(fingerprints(df, shingle), "fingerprints")
    roots = components(links(own.select("fp").distinct(), bits))
    roots = own.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, F.col("fp") == F.col("node"), "left")
    roots = roots.select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(roots.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "h", "component_id", "root")


def deduplicate(df: DataFrame, shingle: int = SHINGLE, bits: int = 3) -> DataFrame:
    """One row of ``df`` for each component: that with the smallest ``doc_id`` (null last); of several texts with that id the one of the least
    hash, of several rows with that text the one whose JSON has the least hash."""
    found = near_duplicates(df, shingle, bits)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    kept = found.groupBy("root").agg(F.min(place).alias("p")).select("p.doc_id", "p.h")
    rows = found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    kept = stash(kept.join(rows, kept["doc_id"].eqNullSafe(rows["doc_id"]) & (kept["h"] == rows["h"])).select(kept["doc_id"], kept["h"], "rows"), "kept")
    key, text, times, lot = fresh(df, "kept_id", "kept_h", "kept_rows", "kept_lot")
    kept = kept.toDF(key, text, times)
    said = F.xxhash64(F.coalesce(df["text"].cast("string"), F.lit("")))
    joined = lambda keys: df.join(keys, df["doc_id"].cast("long").eqNullSafe(keys[key]) & (said == keys[text]))
    out = joined(kept.where(F.col(times) == 1)).select(*[df[c] for c in df.columns])
    repeated = kept.where(F.col(times) > 1)
    if repeated.isEmpty():
        return out
    whole = F.struct(*[df[c] for c in df.columns])
    least = joined(repeated).select(key, text, whole.alias(lot)).groupBy(key, text).agg(F.min_by(lot, F.xxhash64(F.to_json(lot))).alias(lot))
    return out.union(least.select(f"{lot}.*"))
