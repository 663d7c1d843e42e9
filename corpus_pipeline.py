"""Corpus pipeline over a documents table: drop what the quality classifier rejects, keep one document
of each group of near-duplicates, cut repeated strings out of the texts, pack the rest into sequences.

Each stage reads what its predecessor kept, written as Parquet in the shared folder, so a lost
executor costs no more than its tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm import packing, quality, simhash, suffix
from churnkit.llm.common import prepare, stash, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that are not held out, does not reject."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of fingerprints within 3 bits."""
    prepare(spark)
    return simhash.deduplicate(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without what strings of 100 bytes that also start earlier cover."""
    prepare(spark)
    return suffix.cut(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    prepare(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to", "ids")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("suffix_dedup", suffix_stage), ("packing", packing_stage)]

#: The classifier, the fingerprints and the tokenizer cannot be stated in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
