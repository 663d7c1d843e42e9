"""Per-customer churn drivers (T3, D7, D8, E2 aggregation).

A "contribution table" is a DataFrame with the key, the raw feature values and one
signed contribution column per source feature (``phi_<feature>``), e.g. the output
of the tree-SHAP kernel or of ``rule_contributions``.  Ranking happens inside each
row with array functions, so top-k drivers need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.columns import direction, reason

DRIVER_TYPE = ("struct<feature:string,customer_value:string,shap_value:double,"
               "direction:string,reason:string>")

# Model-free attribution rules over the documented churn signals: (feature, value, signed
# contribution); values not listed contribute 0.  Used to exercise the driver and
# action operators deterministically and as a transparent baseline explanation.
RULE_CONTRIBUTIONS = {
    "Contract": [("Month-to-month", 0.30), ("One year", -0.10), ("Two year", -0.15)],
    "tenure": None,  # <= 12: +0.22, >= 48: -0.14
    "InternetService": [("Fiber optic", 0.14), ("No", -0.12)],
    "PaymentMethod": [("Electronic check", 0.10), ("Bank transfer (automatic)", -0.02),
                      ("Credit card (automatic)", -0.02), ("Mailed check", -0.02)],
    "TechSupport": [("No", 0.08), ("Yes", -0.04)],
    "OnlineSecurity": [("No", 0.08), ("Yes", -0.04)],
}


def rule_contributions(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Key + ``keep`` + raw values + ``phi_<feature>`` from RULE_CONTRIBUTIONS."""
    cols = [K.ID_COLUMN, *keep]
    for feat, table in RULE_CONTRIBUTIONS.items():
        if table is None:
            t = F.col("tenure")
            phi = F.when(t <= 12, 0.22).when(t >= 48, -0.14).otherwise(0.0)
        else:
            phi = F.lit(0.0)
            for value, v in reversed(table):
                phi = F.when(F.col(feat) == value, F.lit(v)).otherwise(phi)
        cols += [F.col(feat), phi.cast("double").alias(f"phi_{feat}")]
    return df.select(*cols)


def top_drivers(contrib: DataFrame, features: list[str], top_n: int = K.TOP_N_LOCAL_DRIVERS,
                digits: int = 4) -> Column:
    """T3 + D7 + D8: array of the ``top_n`` drivers by |signed value|, ties kept in
    feature order (a stable sort), each with value, direction and reason."""
    items = [F.struct(F.abs(F.col(f"phi_{f}")).alias("a"), F.lit(i).alias("o"), F.lit(f).alias("feature"),
                      F.col(f).cast("string").alias("customer_value"), F.col(f"phi_{f}").alias("v"))
             for i, f in enumerate(features)]
    ranked = F.array_sort(F.array(*items), lambda x, y: F.when(x["a"] > y["a"], -1).when(x["a"] < y["a"], 1)
                          .when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    top = F.slice(ranked, 1, top_n)
    return F.transform(top, lambda d: F.struct(
        d["feature"].alias("feature"), d["customer_value"].alias("customer_value"),
        F.bround(d["v"], digits).alias("shap_value"), direction(d["v"]).alias("direction"),
        reason(d["feature"], d["customer_value"], d["v"]).alias("reason")))


def drivers_long(df: DataFrame, col: str = "shap_top_drivers") -> DataFrame:
    """Long form (key, rank, driver fields) of a driver array."""
    return df.select(K.ID_COLUMN, F.posexplode(col).alias("pos", "d")).select(
        K.ID_COLUMN, (F.col("pos") + 1).alias("rank"), "d.feature", "d.customer_value", "d.shap_value",
        "d.direction", "d.reason")


def global_importance(contrib: DataFrame, features: list[str], top_n: int = K.TOP_N_GLOBAL_FEATURES,
                      digits: int = 4) -> DataFrame:
    """E2 aggregation: per source column, mean over rows of |sum of its signed
    contributions| (grouping happens before the abs), ranked, top ``top_n``."""
    wide = contrib.agg(*[F.avg(F.abs(F.col(f"phi_{f}"))).alias(f) for f in features])
    items = [F.struct(F.lit(f).alias("column"), F.col(f).alias("v")) for f in features]
    long = wide.select(F.explode(F.array(*items)).alias("x")).select(
        "x.column", F.bround("x.v", digits).alias("mean_abs_shap"))
    return long.orderBy(F.desc("mean_abs_shap"), "column").limit(top_n)
