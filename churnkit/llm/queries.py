"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm import align, ann, bpe, chat, chunking, packing, pages, quality, repair, simhash, suffix, toxicity, windows
from churnkit.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with the byte-level vocabulary, then decode the ids."""
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove what strings of 100 bytes that also start earlier cover."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that near-duplicate passages of at least 50 words connect."""
    return windows.passage_classes(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learned from the labels that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text, and compare with that and with the next document."""

    def prepared(doc_id, text):
        return doc_id, text, chunking.chunk_set(text)

    def pair(this, after):
        doc_id, text, own = this
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[1][:quarter]
        other = chunking.chunk_set(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), chunking.as_string(own), chunking.as_string(other),
                chunking.containment(own, other), chunking.containment(own, after[2]))

    return chunking.with_next(table(spark, sf_dir, "documents"), prepared, pair, "doc_id long, n_chars long, edited_sha256 string, "
                              "fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link documents whose fingerprints over 3-word shingles differ in at most 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one made of control strings, and read them back."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of every document by two tokenizers, and count how often their ids are linked."""
    return align.alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations and repair them with the cheapest edits."""
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity, learned from the labels that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_byte_bpe, op2_suffix_dedup, op3_compact_windows, op4_html, op5_packing, op6_quality, op7_fingerprints, op8_simhash, op9_ann, op10_chat_format,
    op11_token_alignment, op12_conversation_repair, op13_toxicity)}
#: None of these results can be stated in SQL that is fast on whole tables; tests/llm holds them against brute force.
SQL: dict[str, str] = {}
