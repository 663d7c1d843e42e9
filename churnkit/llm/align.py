"""Cross-tokenizer alignment (operator 11).

Method: token-byte incidence matrices in hand-built compressed rows.  Row i of A has a one for each
byte that the i-th token of the first tokenizer covers, B alike; Gustavson's row products A x B^T
give the overlap links with the number of shared bytes.  Where both tokens of an overlap link end
together, the bytes are cut, which makes groups.  Token-group incidence matrices multiplied alike
give the links of tokens that share a group; with the rows of closing tokens only, those that end
together.  Everything of a batch lies in one block-diagonal matrix, so a product is a few array
operations whatever the number of texts.

Texts are cut before a single space between two other characters.  Neither tokenizer has a token
across such a place (checked when the files are loaded; if one may have, texts stay whole), so both
end a token there and what is found for the pieces, joined, is what holds for the text.  A bounded
memo per worker process keeps what is known of short pieces.

Two tokens that end together are each the end of the other's bytes, so the vocabularies alone bound
the id pairs that can be linked, whatever the input: under a million for the given files.  Pairs are
numbered once from the vocabularies; corpus-wide counts are an array of that length.

Defined results: a text that is null, empty or not restored by both tokenizers (blank + text) has no
tokens; repeated rows are aligned, and counted, as often as they occur; a null ``doc_id`` is carried
along; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, prepare, stash, texts
from churnkit.llm.packing import BYTE_LEVEL, settings

#: Pieces up to so many characters are remembered, up to twice so many of them; so many bytes of new pieces are aligned at once.
MEMO_CHARS, MEMO_SIZE, BLOCK_BYTES = 48, 100_000, 1 << 20
BLANK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)").split
_WIDTH = 40  # bits of a count within a packed sum of counts
KINDS = ("ends", "overlap", "group")


@dataclass
class Rows:
    """A sparse matrix in compressed rows: the columns and values of row i stand from ``begin[i]`` to ``begin[i + 1]``."""

    begin: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        begin = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))]
        return Rows(begin, self.row_numbers()[order], self.values[order], len(self.begin) - 1)

    def times(self, other: Rows) -> Rows:
        """Gustavson's product: row i is the sum of the rows of ``other`` that the entries of row i name, times these entries."""
        sizes = np.diff(other.begin)[self.columns]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(other.begin[self.columns] - (ends - sizes), sizes)
        key = np.repeat(self.row_numbers() * other.width, sizes) + other.columns[at]
        values = np.repeat(self.values, sizes) * other.values[at]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
        key, values = key[first], np.add.reduceat(values, first) if total else values
        rows, columns = np.divmod(key, max(other.width, 1))
        return Rows(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(self.begin) - 1))], columns, values, other.width)


def token_bytes(lengths: np.ndarray) -> Rows:
    """Incidence of consecutive tokens of given lengths with the bytes they cover."""
    begin = np.r_[0, np.cumsum(lengths)]
    n = int(begin[-1])
    return Rows(begin, np.arange(n), np.ones(n, np.int64), n)


def marked(columns: np.ndarray, on: np.ndarray, width: int) -> Rows:
    """One entry in ``columns`` for each row where ``on`` holds."""
    return Rows(np.r_[0, np.cumsum(on)], columns[on], np.ones(int(on.sum()), np.int64), width)


@dataclass
class Alignment:
    """What holds between the tokens of two tokenizers of the same bytes: overlap links with their shared bytes, the group of each
    token, and links by group."""

    overlap: Rows
    a_group: np.ndarray
    b_group: np.ndarray
    closing: Rows

    def shared_group(self) -> Rows:
        n = int(self.a_group[-1]) + 1 if len(self.a_group) else 0
        own = marked(self.a_group, np.ones(len(self.a_group), bool), n)
        return own.times(marked(self.b_group, np.ones(len(self.b_group), bool), n).transposed())

    def links(self, kind: str) -> Rows:
        return {"ends": lambda: self.closing, "overlap": lambda: self.overlap, "group": self.shared_group}[kind]()


def align_tokens(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """Alignment of two token sequences, given as lengths in bytes, of the same bytes."""
    a, b = token_bytes(a_lengths), token_bytes(b_lengths)
    overlap = a.times(b.transposed())
    a_end, b_end = a.begin[1:], b.begin[1:]
    own = a_end[overlap.row_numbers()]
    cuts = own[own == b_end[overlap.columns]]
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    closing = marked(a_group, cuts[a_group] == a_end, len(cuts)) if len(cuts) else marked(a_group, np.zeros(len(a_end), bool), 0)
    others = marked(b_group, cuts[b_group] == b_end, len(cuts)) if len(cuts) else marked(b_group, np.zeros(len(b_end), bool), 0)
    return Alignment(overlap, a_group, b_group, closing.times(others.transposed()))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and the row of each."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(size.sum())), np.repeat(np.arange(len(rows)), size)


class TokenBytes:
    """The bytes of each token of a vocabulary."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.length = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.all[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[ids] - (ends - size), size)]


class Codec:
    """Both tokenizers, their tokens' bytes and the numbered id pairs that can end together."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # control strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=b_path)
        level = {chr(c): b for b, c in BYTE_LEVEL.items()} | {chr(b): b for b in range(256) if b not in BYTE_LEVEL}
        vocabulary = self.a.get_vocab()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode("utf-8")
        self.a_bytes = TokenBytes(entries)
        self.b_bytes = TokenBytes([self._piece(i) for i in range(self.b.get_piece_size())])
        self.pair_codes = self._pairs()
        ids = [str(i) for i in range(max(len(self.a_bytes.entries), len(self.b_bytes.entries)))]
        marks = [x + m for own, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for x in ids[:len(own.entries)] for m in (",", last)]
        self.marked, self.marked_length = np.array(marks, dtype=object), np.array([len(x) for x in marks], np.int64)
        self.cuts = self._may_cut()
        self.known: dict[str, tuple[int, str | None, bytes]] = {}
        self.older: dict[str, tuple[int, str | None, bytes]] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode("utf-8")

    def _pairs(self) -> np.ndarray:
        """Sorted codes (A id * 2^32 + B id) of all pairs in which one token's bytes end with the other's."""
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for own, table in ((self.a_bytes, of_a), (self.b_bytes, of_b)):
            for i, x in enumerate(own.entries):
                if x:
                    table.setdefault(x, []).append(i)
        ends = chain(((i << 32) | j for i, x in enumerate(self.a_bytes.entries) for k in range(len(x)) for j in of_b.get(x[k:], ())),
                     ((i << 32) | j for j, x in enumerate(self.b_bytes.entries) for k in range(len(x)) for i in of_a.get(x[k:], ())))
        return np.unique(np.fromiter(ends, np.int64))

    def _may_cut(self) -> bool:
        """Whether no token can cross a single space between two other characters: the first tokenizer splits there by its pattern,
        the second changes no text, puts a blank before it and has no piece with a blank behind something else."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        spec, (normalizer, split, _) = model.normalizer_spec, settings(self.a)
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        inner = any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces)
        return bool(not normalizer and split.get("type") == "ByteLevel" and split.get("use_regex")
                    and not split.get("add_prefix_space") and plain and not inner)

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by both tokenizers of a blank and each piece; none where the joined bytes of one are not the piece's."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        raw = [b" " + p.encode("utf-8") for p in pieces]
        odd = {k for k, p in enumerate(pieces) if not p}
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        given = np.frombuffer(b"".join(raw), np.uint8)
        for ids, own in ((a, self.a_bytes), (b, self.b_bytes)):
            flat, of = _flat(ids)
            if not np.array_equal(np.bincount(of, own.length[flat], minlength=len(pieces)).astype(np.int64), size) or not np.array_equal(own.joined(flat), given):
                odd.update(k for k, x in enumerate(raw) if own.joined(np.array(ids[k], np.int64)).tobytes() != x)
        for k in odd:
            a[k], b[k] = [], []
        return a, b

    def aligned(self, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, Alignment]:
        flat_a, flat_b = _flat(a)[0], _flat(b)[0]
        return flat_a, flat_b, align_tokens(self.a_bytes.length[flat_a], self.b_bytes.length[flat_b])

    def study(self, pieces: list[str]) -> Iterator[tuple[str, tuple[int, str | None, bytes]]]:
        """For each piece, what is kept of it: packed counts of tokens and groups, its groups as text (none if a tokenizer does not
        restore it), and the numbers of its linked id pairs as little-endian 32-bit integers."""
        a, b = self.encode(pieces)
        flat_a, flat_b, found = self.aligned(a, b)
        link_a, link_b = found.closing.row_numbers(), found.closing.columns
        raw = np.searchsorted(self.pair_codes, (flat_a[link_a] << 32) | flat_b[link_b]).astype("<i4").tobytes()
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        # all tokens, by group, those of A before those of B, each with the mark that follows it
        group, last = np.concatenate([found.a_group, found.b_group]), np.zeros(len(flat_a) + len(flat_b), np.int64)
        last[link_a], last[len(flat_a) + link_b] = 1, 1
        order = np.argsort(2 * group + np.repeat((0, 1), (len(flat_a), len(flat_b))), kind="stable")
        number = (np.concatenate([flat_a, len(self.a_bytes.entries) + flat_b]) * 2 + last)[order]
        said = "".join(self.marked[number].tolist())
        stop = np.r_[0, np.cumsum(self.marked_length[number])][np.cumsum(n_a + n_b)].tolist()
        groups = np.r_[found.a_group + 1, 0][np.cumsum(n_a) - 1].tolist() if len(flat_a) else [0] * len(pieces)
        g = at = 0
        for p, x, y, end, until in zip(pieces, n_a.tolist(), n_b.tolist(), groups, stop, strict=True):
            if not x:
                yield p, (0, None, b"")
                continue
            yield p, (x | y << _WIDTH | (end - g) << 2 * _WIDTH, said[at:until - 1], raw[4 * g:4 * end])
            g, at = end, until

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, str | None, bytes]]:
        """What is kept of ``pieces``: remembered, moved back from the older half of the memo, or found now."""
        now = {}
        todo, size = [], 0
        for p in pieces:
            old = self.older.get(p)
            if old is not None:
                now[p] = old
                continue
            todo.append(p)
            size += len(p)
            if size > BLOCK_BYTES:
                now.update(self.study(todo))
                todo, size = [], 0
        if todo:
            now.update(self.study(todo))
        return now

    def results(self, batch: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """``(n_a, n_b, n_groups, groups, links)`` of each text."""
        gc.disable()  # many small acyclic objects
        try:
            return self._results(batch)
        finally:
            gc.enable()

    def _results(self, batch: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        known, new = self.known, set()
        split = [t.split(" ") if self.cuts else [t] for t in batch]
        for k, parts in enumerate(split):
            own = set(parts).difference(known)
            if self.cuts and any(p != p.strip() or not p for p in own):
                split[k] = _CUT(batch[k])  # a space beside other white space is no place to cut
                own = set(split[k]).difference(known)
            new |= own
        known.update(self.learn(new))
        out, mask = [], (1 << _WIDTH) - 1
        for parts in split:
            packed, groups, links = zip(*map(known.__getitem__, parts), strict=True)
            if None in groups:
                out.append((0, 0, 0, "", b""))
                continue
            n = sum(packed)
            out.append((n & mask, n >> _WIDTH & mask, n >> 2 * _WIDTH, ";".join(groups), b"".join(links)))
        for p in new:
            if len(p) > MEMO_CHARS or p != p.strip() or not p:
                del known[p]
        if len(known) > MEMO_SIZE:
            self.older = dict(list(known.items())[-MEMO_SIZE:])
            known.clear()
        return out


@lru_cache(maxsize=2)
def codec(a_path: str, b_path: str) -> Codec:
    """One pair of tokenizers per worker process.  The paths name files that every host has."""
    return Codec(a_path, b_path)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


def align(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment of documents ``(doc_id, text)``: see ``ALIGNED``.  ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``links`` numbers the id
    pairs of tokens that end together (:attr:`Codec.pair_codes`) in text order, as little-endian 32-bit integers."""
    prepare(df.sparkSession)
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, said = codec(a_path, b_path), batch.column(1).to_pylist()
        low, size = 0, 0
        for k, t in enumerate(said):
            size += len(t)
            if size > 2 * BLOCK_BYTES or k + 1 == len(said):
                n_a, n_b, n_groups, groups, links = zip(*own.results(said[low:k + 1]), strict=True)
                yield pa.record_batch([batch.column(0).slice(low, k + 1 - low), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
                                       pa.array(groups, pa.string()), pa.array(links, pa.binary())], names=names)
                low, size = k + 1, 0

    return arrow_map(texts(df), rows, ALIGNED)


def token_links(df: DataFrame, a_path: str, b_path: str, kind: str = "ends") -> DataFrame:
    """Links between the tokens of each document, one row a link: ``(doc_id, a_index, b_index, a_id, b_id, weight)``.  ``kind`` is one of
    ``KINDS``; ``weight`` is the number of shared bytes of overlap links, else 1."""
    if kind not in KINDS:
        raise ValueError(f"links are one of {KINDS}, not {kind!r}")
    prepare(df.sparkSession)
    names = ["doc_id", "a_index", "b_index", "a_id", "b_id", "weight"]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(a_path, b_path)
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b, found = own.aligned(*own.encode([text]))
            links = found.links(kind)
            i, j = links.row_numbers(), links.columns
            yield pa.record_batch([pa.array([doc_id] * len(i), pa.int64()), *(pa.array(x, pa.int64()) for x in (i, j, a[i], b[j], links.values))], names=names)

    return arrow_map(texts(df), rows, ", ".join(f"{n} long" for n in names))


def pair_counts(links: DataFrame, pairs: int) -> DataFrame:
    """``(pair, n)``: how often each of ``pairs`` numbered pairs occurs in ``links``, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(pairs, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=pairs)
        some = np.flatnonzero(n)
        for low in range(0, len(some), 1 << 16):
            own = some[low:low + (1 << 16)]
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array(n[own], pa.int64())], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def linked_documents(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``aligned`` rows with ``n_links``, ``n_best`` (links whose id pair is the most frequent one of its B id, ties included) and
    ``count_sum`` (the corpus-wide counts of the pairs of all links) instead of ``links``.

    The counts are as many numbers as the vocabularies have pairs that can end together, which bounds what the driver sees and sends.
    """
    spark = aligned.sparkSession
    codes = codec(a_path, b_path).pair_codes
    found = pair_counts(aligned, len(codes)).toArrow()
    n = np.zeros(len(codes), np.int64)
    n[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    b_id = codes & 0xFFFFFFFF
    most = np.zeros(int(b_id.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b_id, n)
    sent = spark.sparkContext.broadcast((n, n == most[b_id]))
    kept = [c for c in aligned.columns if c != "links"]
    schema = ", ".join([f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept] + ["n_links long", "n_best long", "count_sum long"])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, best = sent.value
        links = [np.frombuffer(x, "<i4") for x in batch.column(len(kept)).to_pylist()]
        new = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(n[x].sum()) for x in links]]
        return pa.record_batch([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in new)], names=[*kept, "n_links", "n_best", "count_sum"])

    return arrow_map(aligned.select(*kept, "links"), rows, schema)


def alignment_digests(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts and digests of the alignment of each document, with the corpus-wide counts of its links."""
    own = align(df, a_path, b_path)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    kept = stash(own.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"), "aligned")
    return linked_documents(kept, a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
