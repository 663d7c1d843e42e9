"""Session helpers: build a session for local runs/tests and locate the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a local run or test needs; on a cluster these come from the deployment.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.scheduler.mode": "FAIR",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``churnkit`` importable on the executors' Python workers: the
    ``mapInPandas`` kernels pickle references to its functions.  The package is
    zipped once per application on the driver and distributed by Spark itself
    (``addPyFile``), so executors added later receive it as well."""
    import zipfile

    import churnkit

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(churnkit.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="churnkit-pyfiles-"), "churnkit.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "churnkit") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, reading it from the session.

    Only when the session names none (tests, a laptop) do we create our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return _parent_of_checkpoint(current, spark)
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="churnkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured) if _is_modifiable(spark) else None
    sc.setCheckpointDir(configured)
    return configured


def _is_modifiable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - older API
        return False


def _parent_of_checkpoint(current: str, spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        return configured
    return os.path.dirname(current.rstrip("/"))


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables / models."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), "churnkit", *parts])
