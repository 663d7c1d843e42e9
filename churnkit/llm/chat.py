"""Chat formatting with loss masks (operator 10).

Method: offset-aligned masks.  Turns are rendered into one text per block of a conversation, the
text is encoded once with the character offsets of its tokens, and the sorted spans of the
assistant's texts are intersected with the sorted token spans by binary search.  A token under the
mask contributes the part of its span that lies in such a text.

A conversation is rendered in blocks of turns, so that one that holds a large part of all rows is
encoded by many tasks.  Turns end with a line end after a non-blank and begin with a non-blank, so
the pre-tokens of the whole text never cross from one block into the next.

Control strings within texts are escaped: a backslash is doubled and a control string gets one
backslash after its first character.  No text can then hold a control string, and removing single
backslashes restores it.

Defined results: null roles and texts count as empty; null turns come first; rows of one turn are
ordered by role, then text, and repeated ones kept; a null ``conv_id`` is a conversation of its
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import prepare

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]\n", "assistant": " </s>\n", "system": " <</SYS>>\n"}
ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
RESTORE = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]\n|<s> (?P<assistant>.*?) </s>\n|<<SYS>> (?P<system>.*?) <</SYS>>\n"
                  r"|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<text>.*?) \[/ROLE\]\n", re.DOTALL)
#: Turns whose numbers share so many per block are rendered by one task; a block's text is cut at a turn's end beyond so many characters.
BLOCK_TURNS, BLOCK_CHARS = 64, 1 << 16

BLOCKS = ("conv_id long, block long, piece int, text string, ids array<int>, starts array<int>, ends array<int>, "
          "loss array<boolean>, loss_starts array<int>, loss_ends array<int>")


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return RESTORE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text, and where the escaped text stands in it."""
    body = escape(text)
    head = OPEN.get(role) or f"[ROLE] {escape(role)} [TEXT] "
    return head + body + CLOSE.get(role, " [/ROLE]\n"), len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # blanks belong to their tokens
    t.encode_special_tokens = True
    return t


def under_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token span meets one of the sorted, disjoint spans: the first span that ends after the token begins
    must begin before the token ends."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    k = np.searchsorted(spans[:, 1], starts, side="right")
    first = np.append(spans[:, 0], np.iinfo(np.int64).max)[k]
    return first < ends


def masked_pieces(starts: list[int], ends: list[int], loss: list[bool], spans: list[tuple[int, int]]) -> list[list[int]]:
    """What the tokens under the mask cover of each span, as runs; tokens may share a character."""
    runs: list[list[int]] = []
    k, done = 0, 0
    for a, b, on in zip(starts, ends, loss, strict=True):
        if not on:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        i = k
        while i < len(spans) and spans[i][0] < b:
            low, high = max(a, spans[i][0], done), min(b, spans[i][1])
            if low < high:
                if runs and runs[-1][1] == low and runs[-1][0] >= spans[i][0]:
                    runs[-1][1] = high
                else:
                    runs.append([low, high])
                done = high
            i += 1
    return runs


def format_conversations(df: DataFrame, path: str) -> DataFrame:
    """Formatted blocks of conversations ``(conv_id, turn, role, text)``: see ``BLOCKS``.  ``starts`` and ``ends`` are the
    character offsets of the tokens, ``loss`` says which of them are under the mask, ``loss_starts`` and ``loss_ends``
    hold the spans of the assistant's texts.  Blocks of a conversation follow one another by ``block``, then ``piece``.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, parts, spans, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            text, at = "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)
            found = tokenizer(path).encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
            loss = under_mask(offsets[:, 0], offsets[:, 1], at)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.record_batch([
                pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([piece], pa.int32()), pa.array([text]),
                one(found.ids, pa.int32()), one(offsets[:, 0].astype(np.int32), pa.int32()), one(offsets[:, 1].astype(np.int32), pa.int32()),
                one(loss, pa.bool_()), one(at[:, 0].astype(np.int32), pa.int32()), one(at[:, 1].astype(np.int32), pa.int32())],
                names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for conv, block, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and ((conv, block) != key or size > BLOCK_CHARS):
                    yield flush()
                    piece = piece + 1 if (conv, block) == key else 0
                    parts, spans, size = [], [], 0
                key = (conv, block)
                turn, a, b = render(role, text)
                if role == "assistant" and a < b:
                    spans.append((size + a, size + b))
                parts.append(turn)
                size += len(turn)
        if parts:
            yield flush()

    return (rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
            .select("conv_id", "block", "role", "text").mapInArrow(run, BLOCKS))


def read_back(blocks: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted texts and masks alone: ``(conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars)``.  A digest over one conversation needs its blocks in order; they are
    streamed, one block at a time."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key = False, None
        n = chars = loss_chars = 0
        turns, losses = hashlib.sha256(), hashlib.sha256()

        def row() -> pa.RecordBatch:
            values = [key, n, turns.hexdigest(), loss_chars, losses.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for conv, text, starts, ends, loss, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != key:
                    yield row()
                    n = chars = loss_chars = 0
                    turns, losses = hashlib.sha256(), hashlib.sha256()
                begun, key = True, conv
                chars += len(text)
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8"))
                for low, high in masked_pieces(starts, ends, loss, list(zip(a, b, strict=True))):
                    said = unescape(text[low:high])
                    loss_chars += len(said)
                    losses.update(said.encode("utf-8"))
        if begun:
            yield row()

    columns = ["conv_id", "text", "starts", "ends", "loss", "loss_starts", "loss_ends"]
    return (blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece").select(*columns).mapInArrow(run, schema))
