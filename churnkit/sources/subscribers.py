"""Subscriber sources.

The production input is a subscriber snapshot (CSV or Parquet).  For the test
tables in ``/root/testdata`` we derive the same 21-column shape from ``orders``
joined to ``customer`` (one subscriber per order); the derivation is a plain
DataFrame plan, so column pruning and the join strategy are Catalyst's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.constants import RAW_COLUMNS
from churnkit.plans.parallelism import spread
from churnkit.sources import artifacts

RAW_SCHEMA = T.StructType(
    [T.StructField("customerID", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("gender",)]
    + [T.StructField("SeniorCitizen", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("Partner", "Dependents")]
    + [T.StructField("tenure", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in RAW_COLUMNS[6:18]]
    + [T.StructField("MonthlyCharges", T.DoubleType()),
       T.StructField("TotalCharges", T.StringType()),
       T.StructField("Churn", T.StringType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pct_below(expr: str, pct: int) -> Column:
    """``expr % 100 < pct`` for a deterministic, key-derived Bernoulli flag."""
    return F.expr(f"({expr}) % 100") < pct


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def _addon(inet: Column, expr: str, pct: int) -> Column:
    return (F.when(inet == "No", "No internet service")
            .when(_pct_below(expr, pct), "Yes").otherwise("No"))


def raw_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 over the test tables: raw 21-column subscriber rows, TotalCharges as string."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey"), F.col("o_totalprice").alias("p"),
        F.col("o_orderpriority").alias("pr"), F.col("o_orderdate"))
    # a table stored as one or two splits would leave every downstream stage single-task;
    # cluster-sized input already has enough partitions and passes through untouched
    orders = spread(orders)
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"))
    # Both sides are large at scale: equi-join on the customer key and let
    # Catalyst/AQE choose (broadcast only when the size estimate allows it).
    b = orders.join(customers, orders.o_custkey == customers.ck).select(
        "k", "p", "pr", "ck", "nk", "seg",
        (F.lit(12) * (F.lit(2001) - F.year("o_orderdate")) + (F.lit(8) - F.month("o_orderdate")))
        .cast("int").alias("tenure"))
    inet = (F.when(F.col("nk") <= 10, "Fiber optic").when(F.col("nk") <= 18, "DSL").otherwise("No"))
    b = b.withColumn("inet", inet).withColumn("phone", _yes_no(_pct_below("k * 31 + 7", 90)))
    i = F.col("inet")
    contract = (F.when(F.col("pr") == "4-NOT SPECIFIED", "One year")
                .when(F.col("pr") == "5-LOW", "Two year").otherwise("Month-to-month"))
    payment = (F.when(F.col("seg") == "AUTOMOBILE", "Bank transfer (automatic)")
               .when(F.col("seg") == "BUILDING", "Credit card (automatic)")
               .when(F.col("seg") == "HOUSEHOLD", "Mailed check").otherwise("Electronic check"))
    inet_cents = F.when(i == "Fiber optic", 4500).when(i == "DSL", 2000).otherwise(0)
    s = b.select(
        "k", "p", "ck", "tenure",
        F.when(F.col("k") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(_pct_below("ck * 13", 16), 1).otherwise(0).cast("int").alias("SeniorCitizen"),
        _yes_no(_pct_below("ck * 7", 48)).alias("Partner"),
        _yes_no(_pct_below("ck * 11", 30)).alias("Dependents"),
        F.col("phone").alias("PhoneService"),
        F.when(F.col("phone") == "No", "No phone service")
        .when(_pct_below("k * 17", 42), "Yes").otherwise("No").alias("MultipleLines"),
        i.alias("InternetService"),
        _addon(i, "k * 19 + tenure", 29).alias("OnlineSecurity"),
        _addon(i, "k * 23 + tenure", 34).alias("OnlineBackup"),
        _addon(i, "k * 29 + tenure", 34).alias("DeviceProtection"),
        _addon(i, "k * 37 + tenure", 29).alias("TechSupport"),
        _addon(i, "k * 41", 38).alias("StreamingTV"),
        _addon(i, "k * 43", 39).alias("StreamingMovies"),
        contract.alias("Contract"),
        _yes_no(_pct_below("k * 47", 59)).alias("PaperlessBilling"),
        payment.alias("PaymentMethod"),
        (F.lit(1825) + inet_cents + F.floor("p").cast("bigint") % 3000).alias("cents"),
    )
    cents_x_tenure = F.col("cents") * F.col("tenure")
    total_charges = (F.when(F.col("tenure") == 0, F.lit(" "))
                     .otherwise(F.concat(F.floor(cents_x_tenure / 100).cast("bigint").cast("string"), F.lit("."),
                                         F.lpad((cents_x_tenure % 100).cast("string"), 2, "0"))))
    score = (F.expr("(k * 97 + ck * 31) % 101")
             + F.when(F.col("Contract") == "Month-to-month", 30).otherwise(0)
             + F.when(F.col("InternetService") == "Fiber optic", 14)
             .when(F.col("InternetService") == "No", -12).otherwise(0)
             + F.when(F.col("PaymentMethod") == "Electronic check", 10).otherwise(0)
             + F.when(F.col("TechSupport") == "No", 8).otherwise(0)
             + F.when(F.col("OnlineSecurity") == "No", 8).otherwise(0)
             + F.when(F.col("tenure") <= 12, 22).when(F.col("tenure") >= 48, -14).otherwise(0))
    return s.select(
        F.concat(F.lit("C-"), F.col("k").cast("string")).alias("customerID"),
        *RAW_COLUMNS[1:18],
        (F.col("cents") / F.lit(100.0)).alias("MonthlyCharges"),
        total_charges.alias("TotalCharges"),
        F.when(score > 106, "Yes").otherwise("No").alias("Churn"),
    )


#: Column of a CSV line that does not fit the schema.
CORRUPT = "_corrupt_record"


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Read a raw subscriber CSV as-is (explicit schema, TotalCharges stays a string).  A line that does not fit keeps what could be read and is
    itself in ``_corrupt_record``, null for good lines."""
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(held).option("header", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)  # a line is judged by all its columns, whichever are read


def publish_clean(spark: SparkSession, df: DataFrame, out_dir: str, notes: Callable[[], dict] = dict) -> str:
    """S3: write the clean table as Parquet and CSV (header) into a folder of its own, then point ``CURRENT.json`` at it.  A reader sees the old
    version or the new one, never half of either; versions before the last two are deleted."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{out_dir}/{version}/clean.parquet")
    written = spark.read.parquet(f"{out_dir}/{version}/clean.parquet")
    written.write.option("header", True).csv(f"{out_dir}/{version}/clean.csv")
    old = current_clean(spark, out_dir)
    artifacts.write_bytes(spark, f"{out_dir}/CURRENT.json", json.dumps({"version": version, "before": old and old["version"], "notes": notes()}).encode())
    if old and old.get("before"):
        artifacts.remove(spark, f"{out_dir}/{old['before']}")
    return version


def current_clean(spark: SparkSession, out_dir: str) -> dict | None:
    path = f"{out_dir}/CURRENT.json"
    return json.loads(artifacts.read_bytes(spark, path)) if artifacts.path_exists(spark, path) else None


def load_clean(spark: SparkSession, out_dir: str, build_raw, rebuild: bool = False) -> DataFrame:
    """Cached clean read -- the current version if there is one, else rebuild from raw and publish it.

    ``build_raw`` is a zero-argument callable returning the raw DataFrame.  Corrupt lines of a CSV are left out and counted in the version's notes.
    """
    from churnkit.operators.clean import clean_data

    if rebuild or current_clean(spark, out_dir) is None:
        raw, seen = build_raw(), None
        if CORRUPT in raw.columns:
            seen = Observation()  # counted by the pass that writes
            raw = raw.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(CORRUPT).alias("corrupt_lines"))
            raw = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        publish_clean(spark, clean_data(raw), out_dir, lambda: seen.get if seen else {})
    return spark.read.parquet(f"{out_dir}/{current_clean(spark, out_dir)['version']}/clean.parquet")
