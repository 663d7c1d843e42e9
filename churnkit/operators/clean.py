"""Cleaning, projection, filters and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit import constants as K


# the characters of the regex class \s: space, tab, newline, vertical tab, form feed, return
_WHITESPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Strip leading/trailing whitespace (all kinds, not just blanks) with a
    plain character-set trim (no regex per value)."""
    return F.trim(c, F.lit(_WHITESPACE))


def total_charges_double(c: Column) -> Column:
    """TotalCharges -> double; unparsable / blank / NaN -> 0.0."""
    parsed = F.coalesce(strip(c.cast("string")).try_cast("double"), F.lit(0.0))
    return F.nanvl(parsed, F.lit(0.0))


def _clean_common(df: DataFrame) -> DataFrame:
    """C1 + C2 + C3 in one projection (no extra pass)."""
    out = []
    for field in df.schema.fields:
        name = field.name
        col = F.col(name)
        if name == "TotalCharges":
            out.append(total_charges_double(col).alias(name))
        elif name == "SeniorCitizen" and not isinstance(field.dataType, T.StringType):
            # 0/1 -> No/Yes only when the column is not already text; other codes -> NULL
            out.append(F.when(col == 0, "No").when(col == 1, "Yes").alias(name))
        elif isinstance(field.dataType, T.StringType):
            out.append(strip(col).alias(name))
        else:
            out.append(col)
    return df.select(*out)


def encode_label(c: Column) -> Column:
    """C4: Yes -> 1, No -> 0, anything else raises."""
    return (F.when(c == "Yes", 1).when(c == "No", 0)
            .otherwise(F.raise_error(F.concat(F.lit("unexpected Churn value: "), F.coalesce(c, F.lit("NULL")))))
            .cast("int"))


def clean_data(df: DataFrame, keep_id: bool = True) -> DataFrame:
    """C7 = C1..C5.  The Spark version keeps ``customerID`` as the row key by
    default (there is no positional index to realign on); ``keep_id=False`` is C5."""
    out = _clean_common(df).withColumn(K.TARGET_COLUMN, encode_label(F.col(K.TARGET_COLUMN)))
    return out if keep_id else out.drop(K.ID_COLUMN)


def prepare_scoring_input(df: DataFrame) -> DataFrame:
    """Clean unlabeled input; the label is dropped if present, the id (if any)
    is carried as a pass-through column."""
    return _clean_common(df).drop(K.TARGET_COLUMN)


def missing_total_charges_rows(raw: DataFrame) -> DataFrame:
    """Raw rows whose TotalCharges does not parse (blank) -- works on a string or
    an already numeric column."""
    v = F.col("TotalCharges")
    parsed = strip(v.cast("string")).try_cast("double")
    return raw.where(parsed.isNull() | F.isnan(parsed))


def null_audit(df: DataFrame) -> DataFrame:
    """Per-column null count, long form (column, n_null), one scan."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (`column`, n_null)")


def frame_audit(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_null) in column order: types and shape beside the nulls, one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    items = [F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_n").alias("n_rows"), F.col(f.name).alias("n_null"))
             for k, f in enumerate(df.schema.fields)]
    return counts.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """Driver-side schema check naming ALL missing columns at once."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required column(s): {missing}")


def validation_errors(df: DataFrame) -> Column:
    """C11: per-row array of rule violations; reasons name column + rule, never
    the rejected value."""
    checks = []
    for col, domain in K.CATEGORICAL_DOMAINS.items():
        if col not in df.columns:
            checks.append(F.lit(f"{col}: missing"))
            continue
        allowed = list(domain)
        if col == "SeniorCitizen" and not isinstance(df.schema[col].dataType, T.StringType):
            ok = F.col(col).isin(0, 1)
        else:
            ok = F.col(col).isin(*allowed)
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{col}: not in allowed values")))

    def bounded(col: str, hi: float, integral: bool, optional: bool) -> Column:
        if col not in df.columns:
            return F.lit(None if optional else f"{col}: missing")
        v = F.col(col).cast("double")
        bad = F.isnan(v) | (v < 0) | (v > hi) | (F.abs(v) == float("inf"))
        if integral:
            bad = bad | (v != F.floor(v))
        if not optional:
            bad = bad | v.isNull()
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{col}: must be a finite number in [0, {hi:g}]"))

    checks.append(bounded("tenure", K.MAX_TENURE_MONTHS, True, False))
    checks.append(bounded("MonthlyCharges", K.MAX_MONTHLY_CHARGES, False, False))
    tc = "TotalCharges"
    if tc in df.columns:
        # blank/absent TotalCharges means "not yet billed" (allowed, becomes 0.0)
        parsed = strip(F.col(tc).cast("string")).try_cast("double")
        raw_txt = strip(F.col(tc).cast("string"))
        bad = (parsed.isNull() & (raw_txt != "")) | F.isnan(parsed) | (parsed < 0) | (
            parsed > K.MAX_TOTAL_CHARGES) | (F.abs(parsed) == float("inf"))
        checks.append(F.when(F.coalesce(bad, F.lit(False)),
                             F.lit(f"{tc}: must be a finite number in [0, {K.MAX_TOTAL_CHARGES:g}]")))
    if K.ID_COLUMN in df.columns:
        checks.append(F.when(F.length(K.ID_COLUMN) > K.CUSTOMER_ID_MAX_LENGTH,
                             F.lit(f"{K.ID_COLUMN}: longer than {K.CUSTOMER_ID_MAX_LENGTH} characters")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def extra_columns(df: DataFrame) -> list[str]:
    """C11 (schema half): columns outside the feature contract, e.g. a leaked label."""
    allowed = set(K.FEATURE_COLUMNS) | {K.ID_COLUMN}
    return [c for c in df.columns if c not in allowed]


def validate(df: DataFrame, label_seen: str | None = None) -> DataFrame:
    """C11: add ``errors`` (array<string>) and ``is_valid``; an extra column such as a
    Churn label invalidates every row (leakage guard).  ``label_seen`` names a flag
    of the rows whose source held a label: it invalidates those."""
    extras = [c for c in extra_columns(df) if c != label_seen]
    errs = validation_errors(df)
    if label_seen:
        errs = F.concat(errs, F.when(F.col(label_seen), F.array(F.lit(f"{K.TARGET_COLUMN}: extra field not permitted")))
                        .otherwise(F.array().cast("array<string>")))
    if extras:
        errs = F.concat(errs, F.array(*[F.lit(f"{c}: extra field not permitted") for c in extras]))
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def to_customer_record(df: DataFrame) -> DataFrame:
    """Missing TotalCharges -> 0.0 (absent id stays absent)."""
    if "TotalCharges" not in df.columns:
        return df.withColumn("TotalCharges", F.lit(0.0))
    return df.withColumn("TotalCharges", total_charges_double(F.col("TotalCharges")))


def feature_projection(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Features without label and id (leakage guard); label must exist."""
    if K.TARGET_COLUMN not in df.columns:
        raise ValueError(f"expected a {K.TARGET_COLUMN!r} column to separate from the features")
    cols = columns or [c for c in df.columns if c not in (K.TARGET_COLUMN, K.ID_COLUMN)]
    return df.select(*cols)


def categorical_columns(df: DataFrame) -> list[str]:
    """C14: every column that is not one of the fixed numeric columns."""
    return [c for c in df.columns if c not in K.NUMERIC_COLUMNS and c not in (K.TARGET_COLUMN, K.ID_COLUMN)]


def iqr_outliers(df: DataFrame, column: str, k: float = K.IQR_MULTIPLIER) -> DataFrame:
    """Rows outside the Tukey fence of ``column``.  The fences come from the
    bounded-memory exact quartiles, so the filter is a plain predicate with two
    literals (pushed to the scan where the column is stored)."""
    from churnkit.operators.quantiles import exact_quantile_values

    q = exact_quantile_values(df, column, [0.25, 0.75])
    if q is None:
        return df.limit(0)
    q1, q3 = q
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return df.where((F.col(column) < F.lit(lo)) | (F.col(column) > F.lit(hi)))


def new_customers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """tenure == 0 slice with a column subset."""
    cols = columns or [K.ID_COLUMN, "tenure", "MonthlyCharges", "TotalCharges", "Contract", K.TARGET_COLUMN]
    return df.where(F.col("tenure") == 0).select(*cols)


def hash_sample(df: DataFrame, n: int, seed: int = K.RANDOM_STATE, key: str = K.ID_COLUMN) -> DataFrame:
    """A deterministic sample of ``n`` rows: the ``n`` smallest md5(seed:key)
    digests.  It does not depend on partitioning or row order; the plan is a
    per-partition top-n plus a merge of n rows per partition (no shuffle of the
    table), and md5 of the same text is the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_d", digest).orderBy("_d", key).limit(n).drop("_d")
