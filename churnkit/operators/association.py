"""Service x churn association: cross-tabs (A15) and chi-square / Cramer's V."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit import constants as K
from churnkit.operators.eda import _long


def service_crosstab(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, Churn, count) for every service column, one scan."""
    columns = columns or K.CHI_SQUARE_COLUMNS
    long = _long(df, columns, "string", keep=[K.TARGET_COLUMN])
    return long.groupBy("column", "value", K.TARGET_COLUMN).agg(F.count(F.lit(1)).alias("count"))


@F.pandas_udf(T.DoubleType())
def _chi2_sf(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper-tail chi-square probability for small integer dof (closed forms).

    Runs on the handful of aggregated rows (one per tested column), never per customer.
    """
    def sf(x: float, k: int) -> float:
        if x is None or math.isnan(x) or k is None or k <= 0:
            return float("nan")
        if k % 2 == 0:  # Poisson sum: exp(-x/2) * sum_{i<k/2} (x/2)^i / i!
            h, term, total = x / 2.0, 1.0, 1.0
            for i in range(1, k // 2):
                term *= h / i
                total += term
            return math.exp(-h) * total
        # odd dof: erfc(sqrt(x/2)) + exp(-x/2) * sum of half-integer terms
        h = x / 2.0
        total = math.erfc(math.sqrt(h))
        term = math.sqrt(h) * 2.0 / math.sqrt(math.pi)
        for i in range(1, (k + 1) // 2):
            total += math.exp(-h) * term
            term *= h / (i + 0.5)
        return total
    return pd.Series([sf(x, int(k) if k == k else None) for x, k in zip(chi2, dof)], dtype="float64")


def chi_square_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A16 (statistics): chi2 (Yates correction only for 2x2 tables), dof, Cramer's V.

    Both class counts of a level come out of the same group row (n1 = sum(label),
    n0 = count - n1), so zero cells are present without any cross product of levels.
    Marginals are windows over the few aggregated (column, level) rows.
    """
    columns = columns or K.CHI_SQUARE_COLUMNS
    long = _long(df, columns, "string", keep=[K.TARGET_COLUMN])
    g = long.groupBy("column", "value").agg(
        F.sum(K.TARGET_COLUMN).cast("double").alias("n1"),
        (F.count(F.lit(1)) - F.sum(K.TARGET_COLUMN)).cast("double").alias("n0"))
    w = Window.partitionBy("column")
    n = F.sum(F.col("n1") + F.col("n0")).over(w)
    e = g.select("column", "value", "n1", "n0",
                 ((F.col("n1") + F.col("n0")) * F.sum("n1").over(w) / n).alias("e1"),
                 ((F.col("n1") + F.col("n0")) * F.sum("n0").over(w) / n).alias("e0"),
                 n.alias("n"), F.count(F.lit(1)).over(w).alias("r"))

    def term(o: str, ex: str, yates: bool):
        d = F.abs(F.col(o) - F.col(ex))
        if yates:
            d = F.greatest(d - 0.5, F.lit(0.0))
        return F.pow(d, 2) / F.col(ex)

    cell = F.when(F.col("r") == 2, term("n1", "e1", True) + term("n0", "e0", True)).otherwise(
        term("n1", "e1", False) + term("n0", "e0", False))
    z = e.groupBy("column").agg(F.sum(cell).alias("chi2"), (F.max("r") - 1).cast("bigint").alias("dof"),
                                (F.least(F.max("r"), F.lit(2)) - 1).alias("md"), F.max("n").alias("n"))
    v = F.when(F.col("md") > 0, F.sqrt(F.col("chi2") / (F.col("n") * F.col("md"))))
    return z.select("column", F.bround("chi2", 4).alias("chi2"), "dof", F.bround(v, 4).alias("cramers_v"),
                    F.col("chi2").alias("_chi2_raw"))


def chi_square_service_association(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds p_value and the significance flag, sorted by Cramer's V desc."""
    stats = chi_square_statistics(df, columns)
    p = _chi2_sf(F.col("_chi2_raw"), F.col("dof"))
    return (stats.withColumn("p_value", p)
            .select("column", "chi2", "p_value", "dof", "cramers_v",
                    (F.col("p_value") < K.SIGNIFICANCE_ALPHA).alias("significant"))
            .orderBy(F.desc("cramers_v"), "column"))
