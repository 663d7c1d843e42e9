"""Classification metrics over a scored DataFrame.

Inputs are DataFrames with a label column ``y`` (0/1) and a probability column
``p``, and any number of grouping columns (fold, candidate, method): all groups are
measured together, from one scan of the scores.

Exact AUC / average precision need running sums over the distinct scores in
descending order.  Rows are first counted per (group, score).  Scores fall into ``BUCKETS`` equal
parts of [0, 1]; sums run within each part, by a window over (group, part), and the totals of the
parts above (at most ``BUCKETS`` numbers a group) are added, so no task holds a group's scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit import constants as K

METRIC_DIGITS = 6
#: Parts of [0, 1] within which scores are summed in order.
BUCKETS = 1 << 14


def threshold_grid() -> list[float]:
    """The 91-point F1 search grid, bit-identical to linspace(0.05, 0.95, 91)."""
    return [float(x) for x in np.linspace(K.THRESHOLD_GRID_START, K.THRESHOLD_GRID_STOP,
                                          K.THRESHOLD_GRID_POINTS)]


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: list[str] = ()) -> DataFrame:
    """(by, p, pos, neg) per distinct score -- map-side combined, one shuffle."""
    return df.groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y)).cast("double").alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(y))).cast("double").alias("neg"))


def running_counts(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """``counts`` with ``cum_pos`` and ``cum_neg``: how many of each class score at least ``p`` in the group."""
    part = F.least(F.floor(F.col("p") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    parts = counts.withColumn("_part", part)
    keys = [*by, "_part"]
    totals = parts.groupBy(*keys).agg(F.sum("pos").alias("_tp"), F.sum("neg").alias("_tn"))
    above = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(o) for c, o in (("_tp", "_op"), ("_tn", "_on"))])
    within = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # null-safe keys: a group or a score that is null is a group or a part of its own
    renamed = offsets.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_op", "_on")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    joined = parts.join(renamed, same)
    return joined.select(*counts.columns, (F.sum("pos").over(within) + F.col("_op")).alias("cum_pos"), (F.sum("neg").over(within) + F.col("_on")).alias("cum_neg"))


def classification_metrics(df: DataFrame, threshold: float | Column = K.DEFAULT_THRESHOLD, y: str = "y",
                           p: str = "p", digits: int = METRIC_DIGITS, by: list[str] = ()) -> DataFrame:
    """M7: auc, pr_auc (average precision, step-wise -- not the trapezoid
    ``areaUnderPR``), precision / recall / F1 at ``threshold`` (0 on zero division),
    Brier.  One row, or one for each group of ``by``; ``threshold`` may be a column that is constant in a group."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    r = running_counts(score_counts(df, y, p, by), by)
    tot = r.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)).alias("auc_num"),
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("ap_num"),
        F.sum(F.when(F.col("p") >= threshold, F.col("pos")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(F.col("p") >= threshold, F.col("neg")).otherwise(0.0)).alias("fp"),
        F.sum(F.col("pos") * F.pow(F.col("p") - 1.0, 2) + F.col("neg") * F.pow(F.col("p"), 2)).alias("sq"))
    P, N, tp, fp = F.col("P"), F.col("N"), F.col("tp"), F.col("fp")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(P > 0, tp / P).otherwise(0.0)
    f1 = F.when(2 * tp + fp + (P - tp) > 0, 2 * tp / (2 * tp + fp + (P - tp))).otherwise(0.0)
    rd = lambda c: F.bround(c, digits)
    return tot.select(*by,
        rd(F.col("auc_num") / (P * N)).alias("auc"), rd(F.col("ap_num") / P).alias("pr_auc"),
        rd(prec).alias("precision"), rd(rec).alias("recall"), rd(f1).alias("f1"),
        rd(F.col("sq") / (P + N)).alias("brier"))


def long_scores(df: DataFrame, scores: dict[str, str], y: str = "y") -> DataFrame:
    """``(method, y, p)``: the score columns of a row one below the other, named by method."""
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("p")) for m, c in scores.items()])
    return df.select(F.col(y).alias("y"), F.explode(items).alias("_s")).select("_s.method", "y", "_s.p")


def expected_calibration_error(df: DataFrame, n_bins: int = K.ECE_BINS, y: str = "y", p: str = "p",
                               digits: int = METRIC_DIGITS, by: list[str] = ()) -> DataFrame:
    """M8: bin = min(floor(p * n_bins), n_bins - 1); count-weighted |rate - confidence|;
    empty bins contribute 0, empty input gives 0.0."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    bins = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg(p).alias("conf"),
                                               F.avg(F.col(y).cast("double")).alias("acc"))
    tot = bins.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.abs(F.col("acc") - F.col("conf"))).alias("w"))
    return tot.select(*by, F.bround(F.coalesce(F.col("w") / F.col("n"), F.lit(0.0)), digits).alias("ece"))


def _grid_slot(p: Column, grid: list[float], strict: bool = False) -> Column:
    """Number of grid values t with t <= p (t < p when ``strict``), so comparisons
    agree bit for bit with the grid's own doubles.

    For an evenly spaced grid an arithmetic guess is corrected by comparing p with
    the neighbouring grid values themselves (the guess is off by at most one), so
    the expression stays inside whole-stage codegen; any other grid falls back to
    counting with a lambda."""
    n = len(grid)
    arr = F.array(*[F.lit(t) for t in grid])
    below = (lambda t, v: t < v) if strict else (lambda t, v: t <= v)
    step = (grid[-1] - grid[0]) / (n - 1) if n > 1 else 0.0
    even = n > 1 and step > 0 and all(abs(t - (grid[0] + i * step)) < step / 4 for i, t in enumerate(grid))
    if not even:
        return F.size(F.filter(arr, lambda t: below(t, p)))
    k = F.least(F.greatest(F.floor((p - F.lit(grid[0])) / F.lit(step)) + 1, F.lit(0)), F.lit(n)).cast("int")
    too_high = (k >= 1) & ~below(F.element_at(arr, F.greatest(k, F.lit(1))), p)
    too_low = (k < n) & below(F.element_at(arr, F.least(k + 1, F.lit(n))), p)
    return k - too_high.cast("int") + too_low.cast("int")


def threshold_curve(df: DataFrame, y: str = "y", p: str = "p", digits: int = METRIC_DIGITS,
                    grid: list[float] | None = None, by: list[str] = ()) -> DataFrame:
    """M9 support: F1 at each of the 91 grid thresholds, from ONE scan.

    Rows are counted per grid slot (at most 92 a group); each group then becomes one row with an entry for every
    slot, where running sums from the top give tp / fp at each threshold."""
    grid = [float(t) for t in grid] if grid is not None else threshold_grid()
    slots = df.groupBy(*by, _grid_slot(F.col(p), grid).alias("slot")).agg(
        F.sum(F.col(y)).cast("double").alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(y))).cast("double").alias("neg"))
    each = slots.groupBy(*by).agg(F.sum("pos").alias("P"), *[
        F.sum(F.when(F.col("slot") >= k + 1, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in range(len(grid)) for c in ("pos", "neg")])
    points = F.array(*[F.struct(F.lit(k + 1).alias("slot"), F.lit(t).alias("threshold"), F.coalesce(F.col(f"pos{k}"), F.lit(0.0)).alias("tp"),
                                F.coalesce(F.col(f"neg{k}"), F.lit(0.0)).alias("fp")) for k, t in enumerate(grid)])
    c = each.select(*by, F.coalesce("P", F.lit(0.0)).alias("P"), F.explode(points).alias("_t")).select(*by, "P", "_t.*")
    denom = 2 * F.col("tp") + F.col("fp") + (F.col("P") - F.col("tp"))
    return c.select(*by, "slot", "threshold",
                    F.bround(F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(0.0), digits).alias("f1"))


def tune_decision_threshold(df: DataFrame, y: str = "y", p: str = "p", digits: int = METRIC_DIGITS,
                            grid: list[float] | None = None, by: list[str] = ()) -> DataFrame:
    """M9: the grid threshold with the highest F1, the lowest threshold on ties (T5)."""
    curve = threshold_curve(df, y, p, digits=15, grid=grid, by=by)
    best = curve.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("tuned_threshold"),
                       F.bround("b.f1", digits).alias("best_f1"))


def reliability_curve(df: DataFrame, n_bins: int = K.ECE_BINS, y: str = "y", p: str = "p",
                      digits: int = METRIC_DIGITS, by: list[str] = ()) -> DataFrame:
    """H8: per uniform bin, mean predicted p and observed positive rate; empty bins
    omitted.  Bin = number of interior edges strictly below p (the searchsorted rule
    of a reliability diagram, deliberately different from the ECE floor rule)."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    b = _grid_slot(F.col(p), edges, strict=True)
    return df.groupBy(*by, b.alias("bin")).agg(
        F.bround(F.avg(p), digits).alias("mean_predicted"),
        F.bround(F.avg(F.col(y).cast("double")), digits).alias("fraction_positive"),
        F.count(F.lit(1)).alias("count"))


def check_auc_leakage_guard(auc: float, threshold: float = K.LEAKAGE_AUC_THRESHOLD) -> None:
    """Raise when AUC is suspiciously high (strictly above the threshold)."""
    if auc > threshold:
        raise ValueError(
            f"an AUC of {auc:.4f} is above {threshold}, too good to be true: look for the label, or what follows from it, among the features")


def method_metrics(df: DataFrame, scores: dict[str, str], y: str = "y") -> DataFrame:
    """``(method, brier, auc, ece)`` for several scores of the same rows, from one scan."""
    long = long_scores(df, scores, y)
    m = classification_metrics(long, by=["method"]).select("method", "brier", "auc")
    e = expected_calibration_error(long, by=["method"]).withColumnRenamed("method", "_m")
    return m.join(F.broadcast(e), F.col("method") == F.col("_m")).select("method", "brier", "auc", "ece")  # a row a method


def calibration_report(df: DataFrame, raw: str = "p_raw", cal: str = "p_cal", y: str = "y") -> DataFrame:
    """Brier, AUC and ECE for raw vs calibrated probabilities (one row)."""
    m = method_metrics(df, {"raw": raw, "calibrated": cal}, y)
    of = lambda c, method: F.max(F.when(F.col("method") == method, F.col(c))).alias(f"{c}_{method}")
    return m.agg(*[of(c, method) for c in ("brier", "auc", "ece") for method in ("raw", "calibrated")])
