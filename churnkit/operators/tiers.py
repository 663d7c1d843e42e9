"""Risk tiers over scored customers (D5, D6, A11, A18) and the model-free rule score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.columns import probability_pct, risk_signal_count, risk_tier  # noqa: F401


def rule_score(df: DataFrame) -> DataFrame:
    """A deterministic, model-free churn score from the risk signals and the key:
    p = (180 * RiskSignalCount + (k * 13) % 280) / 1000 with k the numeric part of the
    id.  Used to check metric, tier and action operators without any fitted model."""
    k = F.substring(F.col(K.ID_COLUMN), 3, 1 << 20).cast("bigint")
    p = (F.lit(180) * risk_signal_count() + (k * 13) % 280) / F.lit(1000.0)
    return df.withColumn("p", p)


def assign_risk_tiers(scored: DataFrame, probability_column: str = "churn_probability") -> DataFrame:
    """D5 vectorised: adds ``risk_tier`` from the (rounded) probability; an invalid
    probability anywhere fails the job naming the column."""
    if probability_column not in scored.columns:
        raise ValueError(f"tiers come from a column {probability_column!r}, which the frame does not have")
    return scored.withColumn("risk_tier", risk_tier(F.col(probability_column).cast("double")))


def risk_tier_summary(tiered: DataFrame) -> DataFrame:
    """Critical -> Low, zero-filled count and pct (2 dp; 0.0 when empty)."""
    spark = tiered.sparkSession
    counts = tiered.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(t, i) for i, t in enumerate(K.RISK_TIER_ORDER_DESC)], "risk_tier string, ord int")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    c = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return (dim.join(F.broadcast(counts), "risk_tier", "left")
            .select("risk_tier", c.alias("count"),
                    F.when(total > 0, F.bround(c / total * 100.0, 2)).otherwise(F.lit(0.0)).alias("pct"), "ord")
            .orderBy("ord").drop("ord"))


def observed_rate_by_tier(tiered: DataFrame, labels: DataFrame) -> DataFrame:
    """A18 (with J2): observed churn % per predicted tier -- the tiers are joined to the
    labels on the customer key (1:1 inner equi-join)."""
    j = tiered.select(K.ID_COLUMN, "risk_tier").join(labels.select(K.ID_COLUMN, K.TARGET_COLUMN), K.ID_COLUMN)
    return j.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"),
                                      F.bround(F.avg(K.TARGET_COLUMN) * 100.0, 2).alias("churn_rate"))
