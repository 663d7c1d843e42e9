"""Suffix-array dedup (operator 2): removes every byte that a string of a given length covers which
also starts earlier, in an earlier document or earlier in the same one.

Method: threshold-bounded interval expansion.  Texts are cut into phrases, whose Burrows-Wheeler
transform is taken in blocks; a breadth-first backward extension refines the intervals of suffixes
by one symbol a level, so common prefixes are found by increasing length, and stops at the asked
length: what still shares an interval is a repeated string.

What brings equal strings into one block: each string of the length is assigned to the anchor with
the smallest hash among its substrings of ``GRAM`` bytes, and a phrase is a run of strings with the
same anchor, in one document.  Equal strings have equal anchors.  So

1. anchors that occur once are left out: they are counted, and a bitmap of fixed size holds the
   slots of those that occur more often (a full bitmap lets more through, never less);
2. equal phrases are one phrase, with the place of its first use; all strings of its later uses are
   repeated;
3. anchors that different phrases share go to a block by the anchor's hash, once for each phrase,
   and the expansion says which of their strings are equal: all but the earliest are repeated;
4. an anchor that very many different phrases share is not put into a block: its strings become
   phrases of their own, as in 2, which leaves nothing to compare.

Defined results: a null or empty text, or one shorter than the length, loses nothing; a null
``doc_id`` counts as the smallest long; rows that repeat a ``doc_id`` are not earlier than one another
at the same start; an empty table gives an empty table; other columns are ignored, or kept by
:func:`cut`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, discard, fresh, prepare, stash

LENGTH, GRAM = 100, 32
#: Slots of a bitmap (16 MB), phrases an anchor may have in a block, bytes of a block.
SLOTS, CROWDED, BLOCK_BYTES = 1 << 27, 4096, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OCC = "anchor long, k1 long, k2 long, doc_id long, h long, start long, strings int"


def _rows(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.crc32(text.cast("binary")).alias("h"), text.alias("text"))


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a column of strings, one after the other, and where each text begins, and the last one ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data if data is not None else b"")[at[0]:at[-1]], at - at[0]


def phrases(data: memoryview, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, begin, strings, anchor hash) of the runs of strings that share an anchor, within each text."""
    raw = np.frombuffer(data, np.uint8)
    width, step, found = length - gram + 1, 1 << 16, []
    for low in range(0, max(0, len(raw) - length + 1), step):
        high = min(low + step, len(raw) - length + 1)  # strings that begin in [low, high)
        h = (raw[low:high + length - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        k, power = 1, _BASE
        while k < gram:  # hashes of 2k bytes from those of k
            h = h[:-k] * power + h[k:]
            with np.errstate(over="ignore"):
                power = power * power
            k *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        best = (h & ~np.uint64(0x1FFFF)) | np.arange(len(h), dtype=np.uint64)  # smallest hash, then leftmost
        k = 1
        while 2 * k <= width:
            best = np.minimum(best[:-k], best[k:])
            k *= 2
        best = np.minimum(best[:high - low], best[width - k:width - k + high - low])
        at = (best & np.uint64(0x1FFFF)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        found.append((begin + low, h[at[begin]].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    begin, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    # runs end where texts do: cut them there, and leave out strings that reach into the next text
    cuts = np.unique(bounds[1:-1])
    cuts = cuts[cuts < len(raw) - length + 1]
    cuts = cuts[~np.isin(cuts, begin)]
    own = np.searchsorted(begin, cuts, side="right") - 1
    begin, anchor = np.concatenate([begin, cuts]), np.concatenate([anchor, anchor[own]])
    order = np.argsort(begin, kind="stable")
    begin, anchor = begin[order], anchor[order]
    text = np.searchsorted(bounds, begin, side="right") - 1
    last = np.minimum(np.append(begin[1:], len(raw) - length + 1), bounds[text + 1] - length + 1)
    keep = last > begin
    return text[keep], begin[keep], (last - begin)[keep], anchor[keep]


def _in(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = anchor & (SLOTS - 1)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _bitmap(spark, anchors: DataFrame):
    """A broadcast bitmap of the slots of ``anchors``; its size does not depend on theirs."""
    slot = F.col("anchor").bitwiseAND(F.lit(SLOTS - 1))
    words = anchors.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((anchor & {SLOTS - 1}) & 63 as int))").alias("b"))
    bits = np.zeros(SLOTS >> 6, np.uint64)
    for batch in words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _digests(data: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _occurrences(rows: DataFrame, bitmap, length: int, single: bool) -> DataFrame:
    """Phrases whose anchor's slot is in the bitmap: as they are, or their strings one by one."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        data, bounds = _bytes(batch.column(2))
        text, begin, strings, anchor = phrases(data, bounds, length)
        keep = _in(bitmap.value, anchor)
        text, begin, strings, anchor = text[keep], begin[keep], strings[keep], anchor[keep]
        if not len(text):
            return None
        if single:
            begin = np.repeat(begin - np.r_[0, np.cumsum(strings)[:-1]], strings) + np.arange(strings.sum())
            text, anchor, strings = np.repeat(text, strings), np.repeat(anchor, strings), np.ones(strings.sum(), np.int64)
        k = _digests(data, begin, begin + strings - 1 + length)
        take = pa.array(text)
        return pa.table({"anchor": anchor, "k1": k[:, 0], "k2": k[:, 1], "doc_id": batch.column(0).take(take), "h": batch.column(1).take(take),
                         "start": begin - bounds[text], "strings": strings.astype(np.int32)})

    return arrow_map(rows, run, _OCC)


def _phrase_texts(rows: DataFrame, bitmap, length: int) -> DataFrame:
    """One row a phrase and batch, with its bytes."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        data, bounds = _bytes(batch.column(2))
        text, begin, strings, anchor = phrases(data, bounds, length)
        keep = np.flatnonzero(_in(bitmap.value, anchor))
        if not len(keep):
            return None
        k = _digests(data, begin[keep], begin[keep] + strings[keep] - 1 + length)
        _, one = np.unique(k, axis=0, return_index=True)
        keep, k = keep[one], k[one]
        raw = [bytes(data[a:b]) for a, b in zip(begin[keep].tolist(), (begin[keep] + strings[keep] - 1 + length).tolist(), strict=True)]
        return pa.table({"anchor": anchor[keep], "k1": k[:, 0], "k2": k[:, 1], "phrase": pa.array(raw, pa.binary())})

    return arrow_map(rows, run, "anchor long, k1 long, k2 long, phrase binary")


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of symbols that end with a unique one, by prefix doubling."""
    n = len(symbols)
    base = int(symbols.max()) + 2
    rank, k = symbols.astype(np.int64) + 1, 1
    while True:
        reach = 1
        key = rank
        while reach < 4 and base ** (reach + 1) < 2**62 and (reach + 1) * k < 2 * n:
            key = key * base + np.append(rank[reach * k:], np.zeros(min(n, reach * k), np.int64))[:n]
            reach += 1
        order = np.argsort(key)
        new = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order, symbols[order - 1]
        k *= reach
        base = int(new[-1]) + 2


def expand(bwt: np.ndarray, length: int) -> np.ndarray:
    """Number of the interval of each row once suffixes are told apart by their first ``length`` symbols.

    Level by level, the interval of a symbol before a string is found from that string's interval by backward extension;
    rows whose border was found (their common prefix with the row before is shorter) are left out once they are an eighth of all.
    """
    symbols = bwt.astype(np.uint16) if bwt.max() < 1 << 16 else bwt  # a radix sort serves short symbols
    forward = np.argsort(symbols, kind="stable").astype(np.int32)  # row of a suffix -> row of what follows its first symbol
    first = bwt[forward]
    border = np.r_[True, first[1:] != first[:-1]]
    active = np.flatnonzero(~border).astype(np.int32)
    own, before, known = forward.take(active).astype(np.int64), forward.take(active - 1).astype(np.int64), 0  # 64-bit places are taken fastest
    for _ in range(1, length):
        interval = np.cumsum(border, dtype=np.int32)
        apart = interval.take(own) != interval.take(before)
        found = np.count_nonzero(apart)
        if found == known:  # those found before stay apart
            break
        border[active[apart]] = True
        known = found
        if 8 * known > len(active):
            stay, known = ~apart, 0
            active, own, before = active[stay], own[stay], before[stay]
    return np.cumsum(border) - 1


def late_strings(texts: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, offset) of the strings of phrases that another one of these phrases has at an earlier place; ``place`` has, for
    each phrase, its document and start."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
    symbols[ends] = np.arange(len(texts))  # each phrase ends with a symbol of its own
    order, bwt = transform(symbols)
    interval = expand(bwt, length)
    some = np.bincount(interval)[interval] > 1
    at, interval = order[some], interval[some]
    phrase = np.searchsorted(ends, at)
    offset = at - (ends[phrase] - size[phrase])
    by = np.lexsort((place[phrase, 1] + offset, place[phrase, 0], interval))
    interval, phrase, offset = interval[by], phrase[by], offset[by]
    late = np.flatnonzero(interval[1:] == interval[:-1]) + 1
    return phrase[late], offset[late]


def _blocks(chosen: DataFrame, length: int) -> DataFrame:
    """``(k1, k2, late)`` for phrases with strings that are earlier in another phrase; ``late`` has their offsets, as runs."""
    schema = "k1 long, k2 long, late array<struct<offset:int,strings:int>>"
    kind = pa.list_(pa.struct([("offset", pa.int32()), ("strings", pa.int32())]))

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        _, k1, k2, doc, start, texts = zip(*rows, strict=True)
        phrase, offset = late_strings(list(texts), np.array([doc, start], dtype=np.int64).T, length)
        if not len(phrase):
            return None
        by = np.lexsort((offset, phrase))
        phrase, offset = phrase[by], offset[by]
        cut = np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (offset[1:] != offset[:-1] + 1)])
        runs = np.diff(np.append(cut, len(phrase)))
        out: dict[int, list] = {}
        for p, o, n in zip(phrase[cut].tolist(), offset[cut].tolist(), runs.tolist(), strict=True):
            out.setdefault(p, []).append({"offset": o, "strings": n})
        return pa.record_batch([pa.array([k1[p] for p in out], pa.int64()), pa.array([k2[p] for p in out], pa.int64()),
                                pa.array(list(out.values()), kind)], names=["k1", "k2", "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := solve(held)) is not None:
            yield out

    return (chosen.repartition("block").sortWithinPartitions("block").select("block", "k1", "k2", "doc_id", "start", "phrase").mapInArrow(run, schema))


def repeated_spans(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, h, spans)``: for documents that lose bytes, their id (null as the smallest long), the CRC-32 of their text and the
    spans of bytes, as ``(start, end)``, that repeated strings cover.

    The driver sees bitmaps of ``SLOTS`` bits, and counts.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = _rows(df)

    def anchors(batch: pa.RecordBatch) -> pa.Table | None:
        anchor = phrases(*_bytes(batch.column(2)), length)[3]
        found, n = np.unique(anchor, return_counts=True)
        return pa.table({"anchor": found, "n": n}) if len(found) else None

    counted = arrow_map(rows, anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    used = _occurrences(rows, _bitmap(spark, counted.where("n > 1")), length, single=False)
    used = stash(used, "occurrences")
    place = F.struct("doc_id", "start")
    firsts = used.groupBy("anchor", "k1", "k2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("uses"))
    firsts = stash(firsts, "phrases")
    variants = stash(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "anchors")
    shared, crowded = variants.where(F.col("variants") <= CROWDED), variants.where(F.col("variants") > CROWDED)

    # phrases that share an anchor with others, by block
    total = shared.agg(F.sum("variants")).first()[0] or 0
    late, made = spark.createDataFrame([], "k1 long, k2 long, late array<struct<offset:int,strings:int>>"), [used, firsts, variants]
    if total:
        several = max(1, total * (length + length // 2) // BLOCK_BYTES)
        bytes_of = _phrase_texts(rows, _bitmap(spark, shared), length).groupBy("k1", "k2").agg(F.first("phrase").alias("phrase"))
        chosen = firsts.join(shared, "anchor").select("anchor", "k1", "k2", "p.doc_id", "p.start").join(bytes_of, ["k1", "k2"])
        late = stash(_blocks(chosen.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(several))), length), "late")
        made.append(late)

    # later uses of a phrase are repeated as a whole, its first use where another phrase came before
    answers = stash(firsts.join(late, ["k1", "k2"], "left").where("uses > 1 OR late IS NOT NULL").select("k1", "k2", F.col("p").alias("first"), "late"), "answers")
    made.append(answers)
    reached = used.join(answers, ["k1", "k2"])
    whole = F.array(F.struct(F.lit(0).alias("offset"), F.col("strings").alias("strings")))
    runs = F.when(place > F.col("first"), whole).otherwise(F.col("late"))
    spans = reached.select("doc_id", "h", "start", F.explode(runs).alias("r"))
    spans = spans.select("doc_id", "h", (F.col("start") + F.col("r.offset")).alias("start"), (F.col("start") + F.col("r.offset") + F.col("r.strings") + (length - 1)).alias("end"))
    if not crowded.isEmpty():
        singles = _occurrences(rows, _bitmap(spark, crowded), length, single=True).join(crowded.select("anchor"), "anchor")
        singles = stash(singles, "strings")
        made.append(singles)
        first = stash(singles.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("uses")).where("uses > 1").drop("uses"), "first-strings")
        made.append(first)
        again = singles.join(first, ["k1", "k2"]).where(place > F.col("first"))
        spans = spans.union(again.select("doc_id", "h", "start", (F.col("start") + length).alias("end")))
    out = stash(spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    discard(*made)
    return out


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def remove_repeats(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for documents ``(doc_id, text)``: the maximal runs of bytes that go, as
    ``(start, end)``, and the bytes that stay."""
    found = repeated_spans(df, length).withColumnsRenamed({"doc_id": "d", "h": "c"})
    joined = _rows(df).join(found, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("c")), "left").select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, spans, kept = [], [], []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, gone = text.encode("utf-8"), _merged(own)
            sizes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in gone])
            kept.append(_kept(raw, gone))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                               names=["doc_id", "n_bytes", "spans", "kept"])

    out = arrow_map(joined, run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def cut(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """``df`` with the repeated strings cut out of ``text``, and ``n_chars``, if it has that column, counted anew.  A character stays
    if any of its bytes stays; null texts stay null."""
    of, same_text, gone_from = fresh(df, "cut_id", "cut_hash", "cut_spans")
    found = repeated_spans(df, length).withColumnsRenamed({"doc_id": of, "h": same_text, "spans": gone_from})

    @F.pandas_udf("string")
    def kept(text, spans):
        import pandas as pd

        out = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            raw, gone = t.encode("utf-8"), []
            for a, b in _merged([{"start": int(s["start"]), "end": int(s["end"])} for s in own]):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1  # the first character keeps a byte
                while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1  # the last one does
                gone.append((a, b))
            out.append(_kept(raw, gone).decode("utf-8"))
        return pd.Series(out, dtype=object)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col(of)) & (F.crc32(text.cast("binary")) == F.col(same_text))
    out = df.join(found, same, "left").withColumn("text", F.when(F.col(gone_from).isNull(), F.col("text")).otherwise(kept("text", gone_from)))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_from).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)

