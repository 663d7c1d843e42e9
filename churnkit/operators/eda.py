"""Exploratory aggregates (A1, A2, A6, A7, A13, A14, A17, A20) and chart data (H1, H3).

Each function is one or two declarative passes; per-column work is folded into a
single scan by exploding to a long (column, value) form before the shuffle, so
map-side partial aggregation keeps the shuffle at (#groups x #partitions) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators.quantiles import exact_quantiles


def _long(df: DataFrame, columns: list[str], value_type: str | None = None, keep: list[str] = ()) -> DataFrame:
    """(keep..., column, value) long form of ``columns`` via one explode (no union, one scan)."""
    items = [F.struct(F.lit(c).alias("column"),
                      (F.col(c).cast(value_type) if value_type else F.col(c)).alias("value"))
             for c in columns]
    return df.select(*keep, F.explode(F.array(*items)).alias("_kv")).select(*keep, "_kv.column", "_kv.value")


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    return F.bround(num / den * 100.0, digits)


def churn_rate_by_segment(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A1 for any set of segment columns at once: (segment_column, value, churn_rate, customers)."""
    columns = columns or K.SEGMENT_COLUMNS
    long = _long(df, columns, "string", keep=[K.TARGET_COLUMN])
    out = long.groupBy(F.col("column").alias("segment_column"), F.col("value")).agg(
        F.bround(F.avg(K.TARGET_COLUMN) * 100.0, 2).alias("churn_rate"),
        F.count(F.lit(1)).alias("customers"))
    return out.orderBy("segment_column", F.desc("churn_rate"), "value")


def class_balance(df: DataFrame) -> DataFrame:
    """A2: (class, count, pct) for No/Yes."""
    counts = df.groupBy(K.TARGET_COLUMN).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the <= 2 aggregated rows, never over customers
    total = F.sum("count").over(_whole())
    return counts.select(
        F.when(F.col(K.TARGET_COLUMN) == 1, "Yes").otherwise("No").alias("class"),
        F.col("count"), pct(F.col("count"), total).alias("pct")).orderBy(F.desc("count"))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def _approx_quartiles(c: Column, accuracy: int) -> Column:
    return F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), accuracy)


def summarize_outliers(df: DataFrame, columns: list[str] | None = None, k: float = K.IQR_MULTIPLIER,
                       accuracy: int | None = None) -> DataFrame:
    """Per column q1, q3, iqr, fences, n_outliers, pct_outliers (2dp; 0.0 when empty).

    Exact linear-interpolated quartiles by default (found by bounded-memory
    selection, ``operators.quantiles``); ``accuracy`` switches to one
    ``percentile_approx`` pass when approximate fences are enough.
    Pass 1 computes the fences per column (a handful of rows); pass 2 is one
    conditional count joined to those fences on the column name.
    """
    columns = K.NUMERIC_COLUMNS if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, q1 double, q3 double, iqr double, lower_bound double, "
                "upper_bound double, n_outliers bigint, pct_outliers double")
    long = _long(df, columns, "double")
    if accuracy:
        q = long.groupBy("column").agg(_approx_quartiles(F.col("value"), accuracy).alias("q"))
    else:
        q = exact_quantiles(long, ["column"], "value", [0.25, 0.75])
    fences = q.select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    fences = fences.select("column", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr")).select(
        "*", (F.col("q1") - k * F.col("iqr")).alias("lower_bound"),
        (F.col("q3") + k * F.col("iqr")).alias("upper_bound"))
    # fences has exactly len(columns) rows: a proven bound for the broadcast
    joined = long.join(F.broadcast(fences), "column")
    counts = joined.groupBy("column").agg(
        F.count_if((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
        .alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    out = fences.join(counts, "column", "left").select(
        "column", "q1", "q3", "iqr", "lower_bound", "upper_bound",
        F.coalesce("n_outliers", F.lit(0)).cast("bigint").alias("n_outliers"),
        F.coalesce(pct(F.col("n_outliers"), F.col("n")), F.lit(0.0)).alias("pct_outliers"))
    return out


def distribution_stats(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Mean, median, sample std, bias-adjusted skew (G1) and excess kurtosis (G2), min, max.

    Spark's ``skewness``/``kurtosis`` are population moments; the sample-adjusted
    forms are derived from them with the count (NULL when n < 3 / n < 4).
    Rounded to ``digits`` so the numbers do not depend on summation order.
    """
    columns = K.NUMERIC_COLUMNS if columns is None else columns
    long = _long(df, columns, "double")
    g = long.groupBy("column").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").cast("double").alias("n"))
    # medians: one row per column, a bounded broadcast
    med = exact_quantiles(long, ["column"], "value", [0.5]).select("column", F.col("q")[0].alias("median"))
    g = g.join(F.broadcast(med), "column", "left")
    n = F.col("n")
    skew = F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    r = lambda c: F.bround(c, digits)
    return g.select("column", r(F.col("mean")).alias("mean"), r(F.col("median")).alias("median"),
                    r(F.col("std")).alias("std"), r(skew).alias("skew"), r(kurt).alias("kurtosis"),
                    F.col("min"), F.col("max"))


def numeric_correlation_with_churn(df: DataFrame) -> DataFrame:
    """Pearson r of each numeric column with Churn, 4dp, ranked by |r|."""
    y = F.col(K.TARGET_COLUMN).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in K.NUMERIC_COLUMNS])
    long = _long(wide, K.NUMERIC_COLUMNS, "double")
    return long.select(F.col("column"), F.bround("value", 4).alias("correlation"),
                       F.abs(F.bround("value", 4)).alias("abs_correlation")).orderBy(F.desc("abs_correlation"))


def correlation_matrix(df: DataFrame, digits: int = 4) -> DataFrame:
    """Pairwise Pearson correlation of numerics + label, long form, one scan."""
    cols = K.NUMERIC_COLUMNS + [K.TARGET_COLUMN]
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                    for a, b in pairs])
    items = [F.struct(F.lit(a).alias("row_column"), F.lit(b).alias("col_column"),
                      F.col(f"`{a}|{b}`").alias("v")) for a, b in pairs]
    return wide.select(F.explode(F.array(*items)).alias("c")).select(
        "c.row_column", "c.col_column", F.bround("c.v", digits).alias("correlation"))


def group_means(df: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of each numeric column per label."""
    return df.groupBy(K.TARGET_COLUMN).agg(
        *[F.bround(F.avg(c), digits).alias(f"{c}_mean") for c in K.NUMERIC_COLUMNS])


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and most of each numeric column, long form by column."""
    columns = columns or list(K.NUMERIC_COLUMNS)
    long = _long(df, columns, "double")
    plain = long.groupBy("column").agg(F.count("value").alias("count"), F.bround(F.avg("value"), digits).alias("mean"), F.bround(F.stddev_samp("value"), digits).alias("std"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    return plain.join(F.broadcast(q), "column").select("column", "count", "mean", "std", "min", *[F.bround(F.col("q")[k], digits).alias(n) for k, n in enumerate(("q25", "q50", "q75"))], "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A20 helper: value counts of a column (e.g. contract mix of a filtered slice)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def tenure_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """H1: stacked histogram of tenure by label, ``bins`` equal-width bins over
    [min, max]; the max lands in the last bin.  Min/max are scalar subqueries."""
    t = F.col("tenure").cast("double")
    stats = df.agg(F.min("tenure").cast("double").alias("lo"), F.max("tenure").cast("double").alias("hi"))
    lo = stats.select("lo").scalar()
    hi = stats.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((t - lo) * bins / (hi - lo)), F.lit(bins - 1))).cast("int")
    g = df.where(F.col("tenure").isNotNull()).groupBy(b.alias("bin"), F.col(K.TARGET_COLUMN)).agg(
        F.count(F.lit(1)).alias("count"))
    return g.select("bin", F.bround(lo + F.col("bin") * width, 4).alias("bin_start"),
                    F.bround(lo + (F.col("bin") + 1) * width, 4).alias("bin_end"), K.TARGET_COLUMN, "count")


def boxplot_stats(df: DataFrame, columns: list[str] | None = None, k: float = K.IQR_MULTIPLIER) -> DataFrame:
    """H3: box-plot numbers per (column, label): quartiles, median, whiskers to the
    last point inside the fence, outlier count."""
    columns = K.NUMERIC_COLUMNS if columns is None else columns
    long = _long(df, columns, "double", keep=[K.TARGET_COLUMN])
    q = exact_quantiles(long, ["column", K.TARGET_COLUMN], "value", [0.25, 0.5, 0.75])
    q = q.select("column", K.TARGET_COLUMN, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    q = q.withColumn("lo_fence", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn(
        "hi_fence", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    # q has len(columns) x #labels rows: bounded broadcast
    j = long.join(F.broadcast(q), ["column", K.TARGET_COLUMN])
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    w = j.groupBy("column", K.TARGET_COLUMN).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    return q.join(w, ["column", K.TARGET_COLUMN]).select(
        "column", K.TARGET_COLUMN, "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")


def class_density(df: DataFrame, columns: list[str] | None = None, gridsize: int = 200, cut: float = 3.0,
                  resolution: int = 50) -> DataFrame:
    """H2: per-class Gaussian kernel density of each column (each class integrates to
    1, Scott bandwidth n^(-1/5) * sample std, never below a millionth of the largest value), on ``gridsize`` points spanning
    [min - cut*bw, max + cut*bw].

    Values are first counted per bin of width bw/``resolution`` (bounded by the
    range in bandwidths, not by rows); the kernel sum then runs over those bins x
    grid points, so the work does not grow with the number of customers.
    """
    columns = columns or ["MonthlyCharges", "TotalCharges"]
    long = _long(df, columns, "double", keep=[K.TARGET_COLUMN]).where(F.col("value").isNotNull())
    st = long.groupBy("column", K.TARGET_COLUMN).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"),
        F.max("value").alias("hi"))
    # a class without spread, or of one row, gets a kernel a millionth of its value (or of one) wide: a peak at that value
    least = F.greatest(F.abs(F.col("hi")), F.lit(1.0)) * 1e-6
    st = st.withColumn("bw", F.greatest(F.pow(F.col("n").cast("double"), -0.2) * F.coalesce("sd", F.lit(0.0)), least))
    # one stats row per (column, class): a proven bound for the broadcast
    binned = long.join(F.broadcast(st), ["column", K.TARGET_COLUMN]).withColumn(
        "b", F.floor((F.col("value") - F.col("lo")) / (F.col("bw") / resolution)))
    hist = binned.groupBy("column", K.TARGET_COLUMN, "b").agg(
        F.count(F.lit(1)).alias("c"), F.avg("value").alias("v"))
    hist = hist.join(F.broadcast(st), ["column", K.TARGET_COLUMN])
    start = F.col("lo") - cut * F.col("bw")
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (gridsize - 1)
    pts = hist.select("column", K.TARGET_COLUMN, "c", "v", "n", "bw", start.alias("g0"), step.alias("dg"),
                      F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("i"))
    z = (F.col("g0") + F.col("i") * F.col("dg") - F.col("v")) / F.col("bw")
    dens = pts.groupBy("column", K.TARGET_COLUMN, "i").agg(
        F.first(F.col("g0") + F.col("i") * F.col("dg")).alias("x"),
        F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("k"), F.first("n").alias("n"), F.first("bw").alias("bw"))
    return dens.select("column", K.TARGET_COLUMN, F.col("i").alias("point"), F.bround("x", 6).alias("x"),
                       F.bround(F.col("k") / (F.col("n") * F.col("bw") * (2 * 3.141592653589793) ** 0.5), 8)
                       .alias("density"))
