"""Model artifacts, comparison table and run log.

Everything is written through Spark / Hadoop FS to a shared folder, so the same
code works on a laptop and on a cluster with object storage.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import threading
import time
import traceback
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file, whole or not at all: under another name first, then renamed."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part, final = fs_path(f"{path}.{uuid.uuid4().hex}.tmp"), fs_path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(final):
        fs.delete(final, False)
    fs.rename(part, final)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Seconds between signs of life of a lease's holder, and without one after which another may take it.
LEASE_BEAT, LEASE_STALE = 5.0, 60.0
_LEASES: dict[str, tuple[threading.RLock, list[int]]] = {}
_LEASES_LOCK = threading.Lock()


@contextmanager
def lease(spark: SparkSession, path: str) -> Iterator[None]:
    """Only one process at a time is within a lease of a path, so work that several need is done once.  Its holder touches the file every few
    seconds; a holder that was killed is succeeded after ``LEASE_STALE`` seconds by the waiting process's own clock.  A process may enter again
    while it is within."""
    with _LEASES_LOCK:
        lock, depth = _LEASES.setdefault(path, (threading.RLock(), [0]))
    with lock:
        depth[0] += 1
        try:
            if depth[0] > 1:
                yield
                return
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            seen, since, own = None, time.monotonic(), uuid.uuid4().hex.encode()

            def taken() -> bool:
                """Whether the file is now this process's: where two make it at once, the one whose mark stays has it."""
                try:
                    out = fs.create(target, False)
                    out.write(bytearray(own))
                    out.close()
                    time.sleep(0.2)
                    return read_bytes(spark, path) == own
                except Py4JJavaError:
                    if "FileAlreadyExists" in traceback.format_exc() or fs.exists(target):
                        return False
                    raise

            while fs.exists(target) or not taken():
                now = fs.getFileStatus(target).getModificationTime() if fs.exists(target) else None
                if now != seen:
                    seen, since = now, time.monotonic()
                elif time.monotonic() - since > LEASE_STALE:
                    fs.delete(target, False)
                time.sleep(0.5)
            over = threading.Event()

            def beat() -> None:
                while not over.wait(LEASE_BEAT):
                    fs.setTimes(target, int(time.time() * 1000), -1)

            alive = threading.Thread(target=beat, daemon=True)
            alive.start()
            try:
                yield
            finally:
                over.set()
                alive.join()
                fs.delete(target, False)
        finally:
            depth[0] -= 1


def file_stamp(spark: SparkSession, *paths: str) -> str:
    """Names, lengths and times of the files below paths, as a digest."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        p = fs_path(p)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """Digest of a frame's schema and rows that does not depend on their order: the number of rows, and sum and exclusive or of the rows' hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha1(f"{[(f.name, f.dataType.simpleString()) for f in df.schema]} {r['n']} {r['s']} {r['x']}".encode()).hexdigest()[:12]


def save_sidecar(spark: SparkSession, path: str, model_name: str, metrics: dict, extra: dict | None = None) -> None:
    """One-row JSON sidecar of a model (name, UTC time, numeric metrics, feature columns, target column, and ``extra``)."""
    meta = {
        "model_name": model_name,
        "trained_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "metrics": {k: float(v) for k, v in metrics.items()
                    if isinstance(v, (int, float)) and not isinstance(v, bool)},
        "feature_columns": list(K.FEATURE_COLUMNS),
        "target_column": K.TARGET_COLUMN,
        **(extra or {}),
    }
    write_bytes(spark, f"{path}/metadata.json", json.dumps(meta, indent=1).encode())


def load_metadata(spark: SparkSession, path: str) -> dict:
    if not path_exists(spark, f"{path}/metadata.json"):
        raise FileNotFoundError(f"no model metadata at {path}; train a model first")
    return json.loads(read_bytes(spark, f"{path}/metadata.json"))


def check_fresh(meta: dict, df: DataFrame, data_fingerprint: str) -> None:
    """Refuse a model whose feature columns ``df`` does not have, or that was made from other data."""
    missing = [c for c in meta["feature_columns"] if c not in df.columns]
    if missing:
        raise ValueError(f"the model {meta['model_name']} was trained with columns that are gone: {missing}; train it again")
    if meta.get("data_fingerprint") not in (None, data_fingerprint):
        raise ValueError(f"the model {meta['model_name']} was trained on other data; train it again")


def save_comparison(table: DataFrame, path: str) -> None:
    """Comparison table as CSV (header), run id never included."""
    table.drop("run_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Read the comparison CSV with a contract: missing file or columns fail,
    result sorted by cv_auc_mean descending."""
    from churnkit.ml.train import COMPARISON_SCHEMA

    if not path_exists(spark, path):
        raise FileNotFoundError(f"no model comparison at {path}; run the training job first")
    df = spark.read.option("header", True).schema(COMPARISON_SCHEMA).csv(path)
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in K.LEADERBOARD_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"model comparison is missing columns: {missing}")
    return df.orderBy(F.desc("cv_auc_mean"), "name")


def format_leaderboard(df: DataFrame) -> DataFrame:
    """Display copy -- 4 dp, Yes/No target flag, renamed and selected columns."""
    cols = []
    for c, label in K.DISPLAY_COLUMNS.items():
        if c == "name":
            cols.append(F.col(c).alias(label))
        elif c == "meets_target_auc":
            cols.append(F.when(F.col(c), "Yes").otherwise("No").alias(label))
        else:
            cols.append(F.bround(F.col(c), 4).alias(label))
    return df.select(*cols)


def leaderboard_chart_data(df: DataFrame) -> DataFrame:
    """H9: long (model, metric, value) for the higher-is-better metrics (Brier excluded)."""
    stack = ", ".join(f"'{m}', {m}" for m in K.CHART_METRICS)
    return df.selectExpr("name AS model", f"stack({len(K.CHART_METRICS)}, {stack}) AS (metric, value)")


CALIBRATION_METRICS = ("base_model_name string, calibration_method string, brier_raw double, brier_calibrated double, auc_raw double, auc_calibrated double, "
                       "ece_raw double, ece_calibrated double")


def save_calibration_metrics(report: DataFrame, path: str) -> None:
    """The one-row raw-vs-calibrated report as a JSON file next to the
    calibrated model."""
    report.coalesce(1).write.mode("overwrite").json(path)


def load_calibration_metrics(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no calibration metrics at {path}; run the calibration job first")
    return spark.read.schema(CALIBRATION_METRICS).json(path)
