"""Tenure cohorts (A3), retention curve (A12) and lifecycle stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.columns import lifecycle_stage, risk_signal_count, service_count, tenure_cohort


def _dimension(spark, name: str, labels: list[str]) -> DataFrame:
    """A fixed label list as a (label, ord) dimension; joined from the left so
    empty groups still appear (J3).  The aggregate on the right has at most one row
    per label (a proven bound), so it is the broadcast side of the left outer join."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], f"{name} string, ord int")


def cohort_summary(df: DataFrame) -> DataFrame:
    """A3: one row per cohort (empty ones included, customers 0, rates NULL),
    churn_rate and retention_rate in %, 2 dp; out-of-range tenure excluded."""
    y = F.col(K.TARGET_COLUMN)
    agg = (df.select(tenure_cohort().alias("cohort"), y)
           .where(F.col("cohort").isNotNull())
           .groupBy("cohort").agg(F.count(F.lit(1)).alias("customers"), F.avg(y).alias("rate")))
    dim = _dimension(df.sparkSession, "cohort", K.TENURE_COHORT_LABELS)
    churn = F.bround(F.col("rate") * 100.0, 2)
    return (dim.join(F.broadcast(agg), "cohort", "left")
            .select("cohort", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                    churn.alias("churn_rate"), F.bround(100.0 - churn, 2).alias("retention_rate"), "ord")
            .orderBy("ord").drop("ord"))


def unassigned_cohort_count(df: DataFrame) -> DataFrame:
    """A3 side output: rows whose tenure falls outside the cohort edges."""
    return df.agg(F.count_if(tenure_cohort().isNull()).alias("unassigned"))


def empirical_retention_curve(df: DataFrame, max_month: int = K.MAX_OBSERVED_TENURE) -> DataFrame:
    """For m = 0..max_month, n_at_risk = #(tenure >= m), retention_pct = share of ALL rows.

    One scan to a tenure histogram (tenure above max folded into the top month,
    negative / NULL tenure kept only in the denominator), then a reverse running
    sum over at most max_month + 2 histogram rows -- never a scan per month.
    """
    spark = df.sparkSession
    t = F.col("tenure")
    bucket = F.when(t.isNull() | (t < 0), F.lit(-1)).otherwise(F.least(t, F.lit(max_month))).cast("int")
    hist = df.groupBy(bucket.alias("month")).agg(F.count(F.lit(1)).alias("c"))
    n = hist.agg(F.sum("c").alias("n")).select(F.coalesce("n", F.lit(0)).alias("n")).scalar()
    spine = spark.range(0, max_month + 1).select(F.col("id").cast("int").alias("month"))
    w = Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = (spine.join(F.broadcast(hist), "month", "left")
             .select("month", F.sum(F.coalesce("c", F.lit(0))).over(w).alias("n_at_risk")))
    return curve.select(
        "month",
        F.when(n > 0, F.col("n_at_risk").cast("double") / n.cast("double") * 100.0).otherwise(F.lit(0.0))
        .alias("retention_pct"),
        F.col("n_at_risk").cast("bigint").alias("n_at_risk")).orderBy("month")


def lifecycle_summary(df: DataFrame) -> DataFrame:
    """Per stage customers, avg tenure, avg services, churn % (all four stages, fixed order)."""
    y = F.col(K.TARGET_COLUMN)
    agg = df.groupBy(lifecycle_stage().alias("stage")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("tenure").alias("t"),
        F.avg(service_count()).alias("s"), F.avg(y).alias("r"))
    dim = _dimension(df.sparkSession, "stage", K.LIFECYCLE_STAGE_LABELS)
    return (dim.join(F.broadcast(agg), "stage", "left")
            .select("stage", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                    F.bround("t", 2).alias("avg_tenure"), F.bround("s", 2).alias("avg_service_count"),
                    F.bround(F.col("r") * 100.0, 2).alias("churn_rate"), "ord")
            .orderBy("ord").drop("ord"))


def risk_signal_diagnostic(df: DataFrame) -> DataFrame:
    """Churn % per risk-signal count 0..4, zero-filled."""
    y = F.col(K.TARGET_COLUMN)
    agg = df.groupBy(risk_signal_count().alias("risk_count")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(y).alias("r"))
    spine = df.sparkSession.range(0, K.N_RISK_SIGNALS + 1).select(F.col("id").cast("int").alias("risk_count"))
    return (spine.join(F.broadcast(agg), "risk_count", "left")
            .select("risk_count", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                    F.bround(F.col("r") * 100.0, 2).alias("churn_rate")).orderBy("risk_count"))


def derived_columns(df: DataFrame) -> DataFrame:
    """D1-D4 attached to the key."""
    return df.select(K.ID_COLUMN, service_count(), risk_signal_count(), tenure_cohort(), lifecycle_stage())
