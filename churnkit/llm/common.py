"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.session import ship_package, work_dir

#: Rows of a batch sent to a Python worker are limited by bytes, since single texts may be long.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and bound Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of a documents table, null texts as empty ones."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back: it cuts the lineage,
    survives lost executors and lets several readers share one computation."""
    spark = df.sparkSession
    path = work_dir(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "lz4").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of stashed frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, which returns one table or batch, or several by and by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch) if batch.num_rows else None
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif isinstance(out, Iterator):
                yield from out
            elif out is not None:
                yield out

    return df.mapInArrow(run, schema)


def task_count(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
