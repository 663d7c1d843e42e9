"""Headline retention KPIs (A4, A5) and their chart data (H5, H6).

All KPIs come out of ONE aggregation pass (conditional sums), instead of one
scan per KPI.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.columns import service_count


def kpi_row(df: DataFrame) -> DataFrame:
    """A4: one-row KPI block.

    churn_rate %, total/lost/retained MRR, lost % (NULL when total is 0), CLV =
    ARPU / unrounded churn fraction (raises on 0 / empty), avg tenure, avg
    services and % of the 9 possible services; all 2 dp.
    """
    y = F.col(K.TARGET_COLUMN)
    mc = F.col("MonthlyCharges")
    g = df.agg(
        F.avg(y).alias("churn_fraction"),
        F.sum(mc).alias("total_mrr"),
        F.sum(F.when(y == 1, mc).otherwise(F.lit(0.0))).alias("lost_mrr"),
        F.avg(mc).alias("arpu"),
        F.avg("tenure").alias("avg_tenure"),
        F.avg(service_count()).alias("avg_services"),
    )
    cf = F.col("churn_fraction")
    clv = F.when(cf.isNull() | (cf == 0), F.raise_error(F.lit(
        "CLV divides by the churn rate, which is zero or missing here")).cast("double")).otherwise(
        F.col("arpu") / cf)
    r2 = lambda c: F.bround(c, 2)
    total, lost = F.col("total_mrr"), F.col("lost_mrr")
    return g.select(
        r2(cf * 100.0).alias("churn_rate"),
        r2(total).alias("total_mrr"),
        r2(lost).alias("lost_mrr"),
        r2(total - lost).alias("retained_mrr"),
        r2(F.try_divide(lost, F.when(total != 0, total)) * 100.0).alias("lost_mrr_pct"),
        r2(clv).alias("clv"),
        r2(F.col("avg_tenure")).alias("avg_tenure"),
        r2(F.col("avg_services")).alias("avg_services"),
        r2(F.col("avg_services") / K.SERVICE_ATTACH_MAX * 100.0).alias("pct_of_max"),
    )


def kpi_summary(df: DataFrame) -> DataFrame:
    """A5: the five headline KPIs as (kpi, value, unit) rows in fixed order (UNION ALL
    of the one-row block, expressed as a single ``stack``)."""
    row = kpi_row(df)
    unit_services = f"of {K.SERVICE_ATTACH_MAX} services"
    return row.selectExpr(
        "stack(5, "
        "'Churn Rate', CAST(churn_rate AS DOUBLE), '%', "
        "'MRR Loss', CAST(lost_mrr AS DOUBLE), '$/mo', "
        "'CLV', CAST(clv AS DOUBLE), '$', "
        "'Avg Tenure', CAST(avg_tenure AS DOUBLE), 'months', "
        f"'Service-Attach Rate', CAST(avg_services AS DOUBLE), '{unit_services}') AS (kpi, value, unit)")


def mrr_breakdown(df: DataFrame) -> DataFrame:
    """H5: retained vs lost MRR, two rows."""
    return kpi_row(df).selectExpr(
        "stack(2, 'Retained MRR', retained_mrr, 'Lost MRR', lost_mrr) AS (segment, mrr)")


def service_attach_distribution(df: DataFrame) -> DataFrame:
    """H6: customers per service count 0..9 (zero-filled from a 10-row spine)."""
    spark = df.sparkSession
    counts = df.groupBy(service_count().alias("services")).agg(F.count(F.lit(1)).alias("customers"))
    spine = spark.range(0, K.SERVICE_ATTACH_MAX + 1).select(F.col("id").cast("int").alias("services"))
    return spine.join(F.broadcast(counts), "services", "left").select(
        "services", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"))
