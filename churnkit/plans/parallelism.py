"""Task parallelism for CPU-heavy Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_slot: int = 2) -> DataFrame:
    """Give a CPU-heavy stage (``mapInPandas`` kernels, model scoring) at least
    ``per_slot`` tasks per task slot.  A table with enough partitions (any
    cluster-sized input) passes through untouched; only a small input read as a
    handful of splits is round-robin repartitioned, so the extra shuffle happens
    exactly when the rows are few.  Only for a bare scan: counting the partitions of
    a plan with an exchange would run it."""
    if df.isStreaming:  # micro-batches are spread inside foreachBatch, not on the stream
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots * per_slot)
    return df
