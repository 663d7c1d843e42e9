"""DuckDB oracle SQL for every oracle-checkable registered query.

Each statement starts from the same subscriber derivation over the ``orders``
and ``customer`` views (text identical in Spark SQL and DuckDB), cleans it the
way ``clean_data`` does, and then computes the operator independently of the
Spark code.  Rounding uses ``round_even`` (half-to-even, like ``bround``) and
counts are cast to BIGINT (DuckDB sums integers to HUGEINT).
"""

from __future__ import annotations

from churnkit import constants as K

SUBSCRIBER_CTES = """
b AS (
  SELECT o.o_orderkey AS k, o.o_totalprice AS p, o.o_orderpriority AS pr, c.c_custkey AS ck,
         c.c_nationkey AS nk, c.c_mktsegment AS seg,
         CAST(12 * (2001 - year(o.o_orderdate)) + (8 - month(o.o_orderdate)) AS INT) AS tenure
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
i AS (
  SELECT b.*, CASE WHEN nk <= 10 THEN 'Fiber optic' WHEN nk <= 18 THEN 'DSL' ELSE 'No' END AS inet,
         CASE WHEN (k * 31 + 7) % 100 < 90 THEN 'Yes' ELSE 'No' END AS phone
  FROM b),
s AS (
  SELECT k, p, ck, tenure,
    CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CAST(CASE WHEN (ck * 13) % 100 < 16 THEN 1 ELSE 0 END AS INT) AS SeniorCitizen,
    CASE WHEN (ck * 7) % 100 < 48 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN (ck * 11) % 100 < 30 THEN 'Yes' ELSE 'No' END AS Dependents,
    phone AS PhoneService,
    CASE WHEN phone = 'No' THEN 'No phone service' WHEN (k * 17) % 100 < 42 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    inet AS InternetService,
    CASE WHEN inet = 'No' THEN 'No internet service' WHEN (k * 19 + tenure) % 100 < 29 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN inet = 'No' THEN 'No internet service' WHEN (k * 23 + tenure) % 100 < 34 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN inet = 'No' THEN 'No internet service' WHEN (k * 29 + tenure) % 100 < 34 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN inet = 'No' THEN 'No internet service' WHEN (k * 37 + tenure) % 100 < 29 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN inet = 'No' THEN 'No internet service' WHEN (k * 41) % 100 < 38 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN inet = 'No' THEN 'No internet service' WHEN (k * 43) % 100 < 39 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE WHEN pr = '4-NOT SPECIFIED' THEN 'One year' WHEN pr = '5-LOW' THEN 'Two year' ELSE 'Month-to-month' END AS Contract,
    CASE WHEN (k * 47) % 100 < 59 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE seg WHEN 'AUTOMOBILE' THEN 'Bank transfer (automatic)' WHEN 'BUILDING' THEN 'Credit card (automatic)'
             WHEN 'HOUSEHOLD' THEN 'Mailed check' ELSE 'Electronic check' END AS PaymentMethod,
    1825 + CASE inet WHEN 'Fiber optic' THEN 4500 WHEN 'DSL' THEN 2000 ELSE 0 END
         + CAST(floor(p) AS BIGINT) % 3000 AS cents
  FROM i),
raw_subscribers AS (
SELECT concat('C-', CAST(k AS STRING)) AS customerID, gender, SeniorCitizen, Partner, Dependents, tenure,
  PhoneService, MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport,
  StreamingTV, StreamingMovies, Contract, PaperlessBilling, PaymentMethod,
  cents / CAST(100.0 AS DOUBLE) AS MonthlyCharges,
  CASE WHEN tenure = 0 THEN ' '
       ELSE concat(CAST(CAST(floor(cents * tenure / 100) AS BIGINT) AS STRING), '.', lpad(CAST(cents * tenure % 100 AS STRING), 2, '0')) END AS TotalCharges,
  CASE WHEN (k * 97 + ck * 31) % 101
     + CASE WHEN Contract = 'Month-to-month' THEN 30 ELSE 0 END
     + CASE WHEN InternetService = 'Fiber optic' THEN 14 WHEN InternetService = 'No' THEN -12 ELSE 0 END
     + CASE WHEN PaymentMethod = 'Electronic check' THEN 10 ELSE 0 END
     + CASE WHEN TechSupport = 'No' THEN 8 ELSE 0 END
     + CASE WHEN OnlineSecurity = 'No' THEN 8 ELSE 0 END
     + CASE WHEN tenure <= 12 THEN 22 WHEN tenure >= 48 THEN -14 ELSE 0 END > 106 THEN 'Yes' ELSE 'No' END AS Churn
FROM s)"""

_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_TEXT = [c for c in K.RAW_COLUMNS if c not in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn")]

CLEAN_CTE = "clean AS (SELECT " + ", ".join(
    [f"{_STRIP.format(c=c)} AS {c}" if c in _TEXT else
     ("CASE SeniorCitizen WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS SeniorCitizen" if c == "SeniorCitizen" else
      (f"COALESCE(TRY_CAST({_STRIP.format(c='TotalCharges')} AS DOUBLE), 0.0) AS TotalCharges"
       if c == "TotalCharges" else
       ("CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INT) AS Churn" if c == "Churn" else c)))
     for c in K.RAW_COLUMNS]) + " FROM raw_subscribers)"

SERVICE_COUNT = "(" + " + ".join(
    [f"CAST(COALESCE({c} = 'Yes', false) AS INT)" for c in K.SERVICE_YESNO_COLUMNS]
    + ["CAST(COALESCE(InternetService <> 'No', true) AS INT)"]) + ")"
RISK_COUNT = ("(CAST(COALESCE(Contract = 'Month-to-month', false) AS INT)"
              " + CAST(COALESCE(PaymentMethod = 'Electronic check', false) AS INT)"
              " + CAST(COALESCE(TechSupport = 'No', false) AS INT)"
              " + CAST(COALESCE(InternetService = 'Fiber optic', false) AS INT))")
COHORT = ("CASE WHEN tenure > -1 AND tenure <= 12 THEN '0-12' WHEN tenure > 12 AND tenure <= 24 THEN '12-24' "
          "WHEN tenure > 24 AND tenure <= 48 THEN '24-48' WHEN tenure > 48 AND tenure <= 72 THEN '48-72' END")
STAGE = (f"CASE WHEN {RISK_COUNT} >= 3 THEN 'At-Risk' WHEN tenure <= 12 THEN 'New' "
         f"WHEN tenure >= 24 AND {SERVICE_COUNT} >= 5 THEN 'Loyal' ELSE 'Engaged' END")
# deterministic model-free score used to check metric / tier / action operators
SYNTH_P = f"(180 * {RISK_COUNT} + (CAST(substr(customerID, 3) AS BIGINT) * 13) % 280) / CAST(1000 AS DOUBLE)"
TIER = ("CASE WHEN p > 0.7 THEN 'Critical' WHEN p >= 0.5 THEN 'High' WHEN p >= 0.3 THEN 'Medium' "
        "ELSE 'Low' END")


def with_clean(body: str, *extra_ctes: str) -> str:
    ctes = [SUBSCRIBER_CTES.strip(), CLEAN_CTE, *extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def values_table(name: str, cols: str, rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (SELECT * FROM (VALUES {body}) t({cols}))"


def _long(cols: list[str], value_expr: str = "{c}", keep: str = "", src: str = "clean") -> str:
    parts = [f"SELECT {keep}'{c}' AS col, {value_expr.format(c=c)} AS value FROM {src}" for c in cols]
    return " UNION ALL ".join(parts)


def sql_catalog() -> dict[str, str]:
    q: dict[str, str] = {}
    raw_cols = ", ".join(K.RAW_COLUMNS)
    q["raw_subscribers"] = with_clean(f"SELECT {raw_cols} FROM raw_subscribers")
    q["clean_subscribers"] = with_clean(f"SELECT {raw_cols} FROM clean")
    q["scoring_input"] = with_clean("SELECT " + ", ".join(c for c in K.RAW_COLUMNS if c != "Churn") + " FROM clean")
    q["missing_total_charges"] = with_clean(
        f"SELECT {raw_cols} FROM raw_subscribers "
        f"WHERE TRY_CAST({_STRIP.format(c='CAST(TotalCharges AS VARCHAR)')} AS DOUBLE) IS NULL")
    q["null_audit"] = with_clean(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM clean"
        for c in K.RAW_COLUMNS))
    kinds = {c: "double" if c in ("MonthlyCharges", "TotalCharges") else "int" if c in ("tenure", K.TARGET_COLUMN) else "string" for c in K.RAW_COLUMNS}
    q["frame_audit"] = with_clean(" UNION ALL ".join(
        f"SELECT {k} AS position, '{c}' AS \"column\", '{kinds[c]}' AS type, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM clean"
        for k, c in enumerate(K.RAW_COLUMNS)))
    q["describe_numeric"] = with_clean(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"round_even(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round_even(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
        f"round_even(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM clean" for c in K.NUMERIC_COLUMNS))
    q["customer_records"] = with_clean("SELECT customerID, TotalCharges FROM clean")
    q["unassigned_cohorts"] = with_clean(f"SELECT CAST(count(*) FILTER (WHERE {COHORT} IS NULL) AS BIGINT) AS unassigned FROM clean")
    q["clean_cache"] = q["clean_subscribers"]
    q["new_customers"] = with_clean(
        "SELECT customerID, tenure, MonthlyCharges, TotalCharges, Contract, Churn FROM clean WHERE tenure = 0")
    q["derived_columns"] = with_clean(
        f"SELECT customerID, {SERVICE_COUNT} AS ServiceCount, {RISK_COUNT} AS RiskSignalCount, "
        f"{COHORT} AS TenureCohort, {STAGE} AS LifecycleStage FROM clean")
    seg_long = " UNION ALL ".join(
        f"SELECT '{c}' AS segment_column, CAST({c} AS VARCHAR) AS value, Churn FROM clean" for c in K.SEGMENT_COLUMNS)
    q["churn_by_segment"] = with_clean(
        "SELECT segment_column, value, round_even(avg(Churn) * 100.0, 2) AS churn_rate, "
        "CAST(count(*) AS BIGINT) AS customers FROM seg GROUP BY segment_column, value", f"seg AS ({seg_long})")
    q["class_balance"] = with_clean(
        "SELECT CASE WHEN Churn = 1 THEN 'Yes' ELSE 'No' END AS class, CAST(count(*) AS BIGINT) AS count, "
        "round_even(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0, 2) AS pct FROM clean GROUP BY Churn")
    q["cohort_summary"] = with_clean(
        "SELECT d.cohort, CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, "
        "round_even(a.r * 100.0, 2) AS churn_rate, round_even(100.0 - round_even(a.r * 100.0, 2), 2) AS retention_rate "
        "FROM dim d LEFT JOIN (SELECT " + COHORT + " AS cohort, count(*) AS customers, avg(Churn) AS r FROM clean "
        "GROUP BY 1) a ON d.cohort = a.cohort",
        values_table("dim", "cohort, ord", [(c, i) for i, c in enumerate(K.TENURE_COHORT_LABELS)]))
    q["kpi_block"] = with_clean(
        "SELECT round_even(avg(Churn) * 100.0, 2) AS churn_rate, round_even(sum(MonthlyCharges), 2) AS total_mrr, "
        "round_even(sum(CASE WHEN Churn = 1 THEN MonthlyCharges ELSE 0.0 END), 2) AS lost_mrr, "
        "round_even(sum(MonthlyCharges) - sum(CASE WHEN Churn = 1 THEN MonthlyCharges ELSE 0.0 END), 2) AS retained_mrr, "
        "round_even(sum(CASE WHEN Churn = 1 THEN MonthlyCharges ELSE 0.0 END) / nullif(sum(MonthlyCharges), 0) * 100.0, 2) AS lost_mrr_pct, "
        "round_even(avg(MonthlyCharges) / avg(Churn), 2) AS clv, round_even(avg(tenure), 2) AS avg_tenure, "
        f"round_even(avg({SERVICE_COUNT}), 2) AS avg_services, "
        f"round_even(avg({SERVICE_COUNT}) / 9 * 100.0, 2) AS pct_of_max FROM clean")
    q["kpi_summary"] = with_clean(
        "SELECT 'Churn Rate' AS kpi, CAST(churn_rate AS DOUBLE) AS value, '%' AS unit FROM kb UNION ALL "
        "SELECT 'MRR Loss', lost_mrr, '$/mo' FROM kb UNION ALL SELECT 'CLV', clv, '$' FROM kb UNION ALL "
        "SELECT 'Avg Tenure', avg_tenure, 'months' FROM kb UNION ALL "
        "SELECT 'Service-Attach Rate', avg_services, 'of 9 services' FROM kb",
        "kb AS (SELECT round_even(avg(Churn) * 100.0, 2) AS churn_rate, "
        "round_even(sum(CASE WHEN Churn = 1 THEN MonthlyCharges ELSE 0.0 END), 2) AS lost_mrr, "
        "round_even(avg(MonthlyCharges) / avg(Churn), 2) AS clv, round_even(avg(tenure), 2) AS avg_tenure, "
        f"round_even(avg({SERVICE_COUNT}), 2) AS avg_services FROM clean)")
    q["mrr_breakdown"] = with_clean(
        "SELECT 'Retained MRR' AS segment, round_even(sum(MonthlyCharges) - sum(CASE WHEN Churn = 1 THEN MonthlyCharges ELSE 0.0 END), 2) AS mrr FROM clean "
        "UNION ALL SELECT 'Lost MRR', round_even(sum(CASE WHEN Churn = 1 THEN MonthlyCharges ELSE 0.0 END), 2) FROM clean")
    q["service_attach_distribution"] = with_clean(
        "SELECT CAST(r.services AS INT) AS services, CAST(coalesce(a.customers, 0) AS BIGINT) AS customers "
        f"FROM range(0, 10) r(services) LEFT JOIN (SELECT {SERVICE_COUNT} AS services, count(*) AS customers "
        "FROM clean GROUP BY 1) a ON r.services = a.services")
    num_long = _long(K.NUMERIC_COLUMNS, "CAST({c} AS DOUBLE)")
    q["outlier_summary"] = with_clean(
        "SELECT f.col AS \"column\", q1, q3, iqr, lower_bound, upper_bound, CAST(n_outliers AS BIGINT) AS n_outliers, "
        "round_even(n_outliers / CAST(n AS DOUBLE) * 100.0, 2) AS pct_outliers FROM f JOIN ("
        "SELECT l.col, count(*) FILTER (WHERE value < lower_bound OR value > upper_bound) AS n_outliers, count(*) AS n "
        "FROM l JOIN f ON l.col = f.col GROUP BY l.col) c ON f.col = c.col",
        f"l AS ({num_long})",
        "q AS (SELECT col, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY col)",
        "f AS (SELECT col, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, "
        "q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)")
    q["distribution_stats"] = with_clean(
        "SELECT col AS \"column\", round_even(avg(value), 6) AS mean, round_even(median(value), 6) AS median, "
        "round_even(stddev_samp(value), 6) AS std, round_even(skewness(value), 6) AS skew, "
        "round_even(kurtosis(value), 6) AS kurtosis, min(value) AS min, max(value) AS max FROM l GROUP BY col",
        f"l AS ({num_long})")
    q["numeric_correlation"] = with_clean(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round_even(corr(CAST({c} AS DOUBLE), CAST(Churn AS DOUBLE)), 4) AS correlation, "
        f"abs(round_even(corr(CAST({c} AS DOUBLE), CAST(Churn AS DOUBLE)), 4)) AS abs_correlation FROM clean"
        for c in K.NUMERIC_COLUMNS))
    cols4 = K.NUMERIC_COLUMNS + ["Churn"]
    q["correlation_matrix"] = with_clean(" UNION ALL ".join(
        f"SELECT '{a}' AS row_column, '{b}' AS col_column, "
        f"round_even(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS correlation FROM clean"
        for a in cols4 for b in cols4))
    q["group_means"] = with_clean(
        "SELECT Churn, " + ", ".join(f"round_even(avg({c}), 6) AS {c}_mean" for c in K.NUMERIC_COLUMNS)
        + " FROM clean GROUP BY Churn")
    q["blank_charge_contract_mix"] = with_clean(
        "SELECT Contract, CAST(count(*) AS BIGINT) AS count FROM raw_subscribers "
        f"WHERE TRY_CAST({_STRIP.format(c='CAST(TotalCharges AS VARCHAR)')} AS DOUBLE) IS NULL GROUP BY Contract")
    q["lifecycle_summary"] = with_clean(
        "SELECT d.stage, CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, round_even(a.t, 2) AS avg_tenure, "
        "round_even(a.s, 2) AS avg_service_count, round_even(a.r * 100.0, 2) AS churn_rate FROM dim d LEFT JOIN ("
        f"SELECT {STAGE} AS stage, count(*) AS customers, avg(tenure) AS t, avg({SERVICE_COUNT}) AS s, "
        "avg(Churn) AS r FROM clean GROUP BY 1) a ON d.stage = a.stage",
        values_table("dim", "stage, ord", [(c, i) for i, c in enumerate(K.LIFECYCLE_STAGE_LABELS)]))
    q["risk_signal_diagnostic"] = with_clean(
        "SELECT CAST(r.risk_count AS INT) AS risk_count, CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, "
        "round_even(a.r * 100.0, 2) AS churn_rate FROM range(0, 5) r(risk_count) LEFT JOIN ("
        f"SELECT {RISK_COUNT} AS risk_count, count(*) AS customers, avg(Churn) AS r FROM clean GROUP BY 1) a "
        "ON r.risk_count = a.risk_count")
    q["retention_curve"] = with_clean(
        "SELECT CAST(m.month AS INT) AS month, "
        "CASE WHEN (SELECT count(*) FROM clean) > 0 THEN CAST(count(c.tenure) AS DOUBLE) / "
        "CAST((SELECT count(*) FROM clean) AS DOUBLE) * 100.0 ELSE 0.0 END AS retention_pct, "
        "CAST(count(c.tenure) AS BIGINT) AS n_at_risk "
        "FROM range(0, 73) m(month) LEFT JOIN clean c ON c.tenure >= m.month GROUP BY m.month")
    q["tenure_histogram"] = with_clean(
        "SELECT bin, round_even(lo + bin * (hi - lo) / 30, 4) AS bin_start, round_even(lo + (bin + 1) * (hi - lo) / 30, 4) "
        "AS bin_end, Churn, CAST(count(*) AS BIGINT) AS count FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE "
        "least(floor((CAST(tenure AS DOUBLE) - lo) * 30 / (hi - lo)), 29) END AS INT) AS bin, lo, hi, Churn "
        "FROM clean, mm WHERE tenure IS NOT NULL) GROUP BY bin, lo, hi, Churn",
        "mm AS (SELECT CAST(min(tenure) AS DOUBLE) AS lo, CAST(max(tenure) AS DOUBLE) AS hi FROM clean)")
    box_long = _long(K.NUMERIC_COLUMNS, "CAST({c} AS DOUBLE)", keep="Churn, ")
    q["boxplot_stats"] = with_clean(
        "SELECT q.col AS \"column\", q.Churn, q1, median, q3, "
        "min(value) FILTER (WHERE value >= lo AND value <= hi) AS whisker_low, "
        "max(value) FILTER (WHERE value >= lo AND value <= hi) AS whisker_high, "
        "CAST(count(*) FILTER (WHERE NOT (value >= lo AND value <= hi)) AS BIGINT) AS n_outliers "
        "FROM l JOIN q ON l.col = q.col AND l.Churn = q.Churn GROUP BY q.col, q.Churn, q1, median, q3",
        f"l AS ({box_long})",
        "q0 AS (SELECT col, Churn, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
        "quantile_cont(value, 0.75) AS q3 FROM l GROUP BY col, Churn)",
        "q AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q0)")
    svc_long = _long(K.CHI_SQUARE_COLUMNS, "{c}", keep="Churn, ")
    q["service_crosstab"] = with_clean(
        "SELECT col AS \"column\", value, Churn, CAST(count(*) AS BIGINT) AS count FROM l GROUP BY col, value, Churn",
        f"l AS ({svc_long})")
    q["chi_square_association"] = with_clean(
        "SELECT col AS \"column\", round_even(chi2, 4) AS chi2, dof, "
        "round_even(CASE WHEN md > 0 THEN sqrt(chi2 / (n * md)) END, 4) AS cramers_v FROM ("
        "SELECT col, CAST(max(r) - 1 AS BIGINT) AS dof, least(max(r), 2) - 1 AS md, max(n) AS n, "
        "sum(CASE WHEN r = 2 THEN "
        "  power(greatest(abs(n1 - e1) - 0.5, 0), 2) / e1 + power(greatest(abs(n0 - e0) - 0.5, 0), 2) / e0 "
        "  ELSE power(n1 - e1, 2) / e1 + power(n0 - e0, 2) / e0 END) AS chi2 FROM e GROUP BY col) z",
        f"l AS ({svc_long})",
        "g AS (SELECT col, value, CAST(sum(Churn) AS DOUBLE) AS n1, CAST(count(*) - sum(Churn) AS DOUBLE) AS n0 "
        "FROM l GROUP BY col, value)",
        "e AS (SELECT col, value, n1, n0, (n1 + n0) * sum(n1) OVER (PARTITION BY col) / sum(n1 + n0) OVER (PARTITION BY col) AS e1, "
        "(n1 + n0) * sum(n0) OVER (PARTITION BY col) / sum(n1 + n0) OVER (PARTITION BY col) AS e0, "
        "sum(n1 + n0) OVER (PARTITION BY col) AS n, count(*) OVER (PARTITION BY col) AS r FROM g)")
    q["implied_lifetime"] = with_clean(
        "SELECT churn_rate, round_even(100.0 / churn_rate, 1) AS implied_lifetime_months FROM "
        "(SELECT round_even(avg(Churn) * 100.0, 2) AS churn_rate FROM clean)")
    q.update(_rule_catalog())
    return q


_FEATS = ["Contract", "tenure", "InternetService", "PaymentMethod", "TechSupport", "OnlineSecurity"]
_PHI = {
    "Contract": "CASE Contract WHEN 'Month-to-month' THEN 0.30 WHEN 'One year' THEN -0.10 WHEN 'Two year' THEN -0.15 ELSE 0.0 END",
    "tenure": "CASE WHEN tenure <= 12 THEN 0.22 WHEN tenure >= 48 THEN -0.14 ELSE 0.0 END",
    "InternetService": "CASE InternetService WHEN 'Fiber optic' THEN 0.14 WHEN 'No' THEN -0.12 ELSE 0.0 END",
    "PaymentMethod": "CASE PaymentMethod WHEN 'Electronic check' THEN 0.10 ELSE -0.02 END",
    "TechSupport": "CASE TechSupport WHEN 'No' THEN 0.08 WHEN 'Yes' THEN -0.04 ELSE 0.0 END",
    "OnlineSecurity": "CASE OnlineSecurity WHEN 'No' THEN 0.08 WHEN 'Yes' THEN -0.04 ELSE 0.0 END",
}
_REASON = ("(CASE feature WHEN 'Contract' THEN customer_value || ' contract' "
           "WHEN 'tenure' THEN customer_value || '-month tenure' "
           "WHEN 'TechSupport' THEN 'tech support: ' || customer_value "
           "WHEN 'PaymentMethod' THEN customer_value || ' payment method' "
           "WHEN 'InternetService' THEN customer_value || ' internet service' "
           "ELSE feature || ' = ' || customer_value END) || ' ' || "
           "(CASE WHEN v > 0 THEN 'increases' WHEN v < 0 THEN 'decreases' ELSE 'has no measurable effect on' END)"
           " || ' this customer''s predicted churn risk.'")


def _rule_catalog() -> dict[str, str]:
    from churnkit.operators.metrics import threshold_grid

    q: dict[str, str] = {}
    scored = ("scored AS (SELECT *, Churn AS y, round_even(p, 4) AS churn_probability, "
              "round_even(least(greatest(p * 100.0, 0.0), 100.0), 1) AS churn_probability_pct, "
              "CASE WHEN round_even(p, 4) > 0.7 THEN 'Critical' WHEN round_even(p, 4) >= 0.5 THEN 'High' "
              "WHEN round_even(p, 4) >= 0.3 THEN 'Medium' ELSE 'Low' END AS risk_tier "
              f"FROM (SELECT *, {SYNTH_P} AS p FROM clean))")
    contrib = "contrib AS (SELECT customerID, risk_tier, " + ", ".join(
        [f"{f}" for f in _FEATS] + [f"CAST({_PHI[f]} AS DOUBLE) AS phi_{f}" for f in _FEATS]) + " FROM scored)"
    long = "dl AS (" + " UNION ALL ".join(
        f"SELECT customerID, risk_tier, '{f}' AS feature, {i} AS ord, CAST({f} AS VARCHAR) AS customer_value, "
        f"phi_{f} AS v FROM contrib" for i, f in enumerate(_FEATS)) + ")"
    drivers = ("drv AS (SELECT customerID, risk_tier, CAST(rank AS INT) AS rank, feature, customer_value, "
               f"round_even(v, 4) AS shap_value, CASE WHEN v > 0 THEN 'increases' WHEN v < 0 THEN 'decreases' "
               f"ELSE 'neutral' END AS direction, {_REASON} AS reason FROM (SELECT *, row_number() OVER "
               "(PARTITION BY customerID ORDER BY abs(v) DESC, ord) AS rank FROM dl) WHERE rank <= 3)")
    from churnkit import constants as KK
    rules = values_table("rules", "rfeature, rvalue, raction, rcategory",
                         [(r["feature"], r["value"], r["action"], r["category"]) for r in KK.DRIVER_ACTION_RULES])
    base = values_table("base", "btier, baction, bcategory",
                        [(t, v["action"], v["category"]) for t, v in KK.TIER_BASE_ACTIONS.items()])
    acts = ("acts AS (SELECT d.customerID, d.risk_tier, d.rank, d.feature, r.raction, r.rcategory FROM drv d "
            "JOIN rules r ON d.feature = r.rfeature AND (CASE WHEN r.rfeature = 'tenure' "
            "THEN TRY_CAST(d.customer_value AS DOUBLE) <= 12 ELSE d.customer_value = r.rvalue END) "
            "WHERE d.direction = 'increases')")
    q["validated_subscribers"] = with_clean("SELECT customerID, true AS is_valid, '' AS errors FROM clean")
    q["charge_outliers"] = with_clean(
        "SELECT customerID, TotalCharges FROM clean, f WHERE TotalCharges < lo OR TotalCharges > hi",
        "f AS (SELECT quantile_cont(TotalCharges, 0.25) - 1.5 * (quantile_cont(TotalCharges, 0.75) - "
        "quantile_cont(TotalCharges, 0.25)) AS lo, quantile_cont(TotalCharges, 0.75) + 1.5 * "
        "(quantile_cont(TotalCharges, 0.75) - quantile_cont(TotalCharges, 0.25)) AS hi FROM clean)")
    q["customer_sample"] = with_clean(
        f"SELECT {', '.join(c for c in K.RAW_COLUMNS if c != K.TARGET_COLUMN)} FROM raw_subscribers "
        "ORDER BY md5(concat('42:', customerID)), customerID LIMIT 5")
    q["head_customers"] = with_clean(
        "SELECT customerID, tenure, Contract, MonthlyCharges, Churn FROM clean ORDER BY customerID LIMIT 10")
    q["rule_scored_tiers"] = with_clean(
        "SELECT customerID, churn_probability, churn_probability_pct, risk_tier FROM scored", scored)
    q["rule_tier_summary"] = with_clean(
        "SELECT d.risk_tier, CAST(coalesce(c.n, 0) AS BIGINT) AS count, "
        "CASE WHEN (SELECT count(*) FROM scored) > 0 THEN round_even(coalesce(c.n, 0) / "
        "CAST((SELECT count(*) FROM scored) AS DOUBLE) * 100.0, 2) ELSE 0.0 END AS pct FROM dim d "
        "LEFT JOIN (SELECT risk_tier, count(*) AS n FROM scored GROUP BY 1) c ON d.risk_tier = c.risk_tier",
        scored, values_table("dim", "risk_tier, ord", [(t, i) for i, t in enumerate(KK.RISK_TIER_ORDER_DESC)]))
    q["rule_observed_rate_by_tier"] = with_clean(
        "SELECT s.risk_tier, CAST(count(*) AS BIGINT) AS customers, round_even(avg(c.Churn) * 100.0, 2) AS churn_rate "
        "FROM scored s JOIN clean c ON s.customerID = c.customerID GROUP BY s.risk_tier", scored)
    g = ("g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg "
         "FROM scored GROUP BY p)")
    r = ("r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos, "
         "sum(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM g)")
    q["rule_metrics"] = with_clean(
        "SELECT round_even(auc_num / (P * N), 6) AS auc, round_even(ap_num / P, 6) AS pr_auc, "
        "round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, "
        "round_even(CASE WHEN P > 0 THEN tp / P ELSE 0.0 END, 6) AS recall, "
        "round_even(CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0.0 END, 6) AS f1, "
        "round_even(sq / (P + N), 6) AS brier FROM (SELECT sum(pos) AS P, sum(neg) AS N, "
        "sum(neg * (cum_pos - pos + pos / 2.0)) AS auc_num, sum(pos * cum_pos / (cum_pos + cum_neg)) AS ap_num, "
        "sum(CASE WHEN p >= 0.5 THEN pos ELSE 0.0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN neg ELSE 0.0 END) AS fp, "
        "sum(pos * power(p - 1.0, 2) + neg * power(p, 2)) AS sq FROM r) t", scored, g, r)
    q["rule_ece"] = with_clean(
        "SELECT round_even(coalesce(sum(c * abs(acc - conf)) / sum(c), 0.0), 6) AS ece FROM ("
        "SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS c, avg(p) AS conf, "
        "avg(CAST(y AS DOUBLE)) AS acc FROM scored GROUP BY 1)", scored)
    grid = threshold_grid()
    grid_sql = "[" + ", ".join(repr(t) for t in grid) + "]"
    gridv = values_table("grid", "slot, threshold", [(i + 1, t) for i, t in enumerate(grid)])
    curve = ("curve AS (SELECT gr.slot, gr.threshold, sum(CASE WHEN s.slot >= gr.slot THEN s.pos ELSE 0.0 END) AS tp, "
             "sum(CASE WHEN s.slot >= gr.slot THEN s.neg ELSE 0.0 END) AS fp, (SELECT sum(pos) FROM sl) AS P "
             "FROM grid gr, sl s GROUP BY gr.slot, gr.threshold)")
    sl = (f"sl AS (SELECT CAST(len(list_filter({grid_sql}, lambda t: t <= p)) AS INT) AS slot, "
          "CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM scored GROUP BY 1)")
    f1 = "CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0.0 END"
    q["rule_threshold_curve"] = with_clean(
        f"SELECT CAST(slot AS INT) AS slot, threshold, round_even({f1}, 6) AS f1 FROM curve", scored, gridv, sl, curve)
    q["rule_tuned_threshold"] = with_clean(
        f"SELECT threshold AS tuned_threshold, round_even({f1}, 6) AS best_f1 FROM curve "
        f"ORDER BY {f1} DESC, threshold ASC LIMIT 1", scored, gridv, sl, curve)
    edges = "[" + ", ".join(repr(x / 10) if False else repr(float(e)) for e in __import__("numpy").linspace(0, 1, 11)[1:-1]) + "]"
    q["rule_reliability_curve"] = with_clean(
        f"SELECT CAST(len(list_filter({edges}, lambda e: e < p)) AS INT) AS bin, round_even(avg(p), 6) AS mean_predicted, "
        "round_even(avg(CAST(y AS DOUBLE)), 6) AS fraction_positive, CAST(count(*) AS BIGINT) AS count "
        "FROM scored GROUP BY 1", scored)
    q["rule_drivers"] = with_clean(
        "SELECT customerID, rank, feature, customer_value, shap_value, direction, reason FROM drv",
        scored, contrib, long, drivers)
    action_rows = ("ar AS (SELECT customerID, risk_tier, CAST(1 AS INT) AS priority, bcategory AS category, "
                   "baction AS action, 'tier' AS source, CAST(NULL AS VARCHAR) AS driver_feature "
                   "FROM scored JOIN base ON risk_tier = btier UNION ALL "
                   "SELECT customerID, risk_tier, CAST(1 + k AS INT), rcategory, raction, 'driver', feature FROM ("
                   "SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY rank) AS k FROM ("
                   "SELECT *, row_number() OVER (PARTITION BY customerID, raction ORDER BY rank) AS dup FROM acts) "
                   "WHERE dup = 1) WHERE k <= 2)")
    q["rule_actions"] = with_clean(
        "SELECT customerID, risk_tier, priority, category, action, source, driver_feature FROM ar",
        scored, contrib, long, drivers, rules, base, acts, action_rows)
    q["rule_tier_action_categories"] = with_clean(
        "SELECT risk_tier, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories "
        "FROM ar GROUP BY risk_tier", scored, contrib, long, drivers, rules, base, acts, action_rows)
    q["rule_global_importance"] = with_clean(
        "SELECT col AS \"column\", round_even(m, 4) AS mean_abs_shap FROM (" + " UNION ALL ".join(
            f"SELECT '{f}' AS col, avg(abs(phi_{f})) AS m FROM contrib" for f in _FEATS)
        + ") ORDER BY round_even(m, 4) DESC, col LIMIT 10",
        scored, contrib)
    q.update(_downstream_catalog(scored, contrib, long, drivers, rules, base, acts, action_rows))
    return q


def _downstream_catalog(scored: str, contrib: str, long: str, drivers: str, rules: str, base: str, acts: str, action_rows: str) -> dict[str, str]:
    from churnkit import constants as KK
    from churnkit.operators.metrics import threshold_grid

    q: dict[str, str] = {}
    key = "CAST(substr(customerID, 3) AS BIGINT)"
    # The score with one column at its counterfactual value
    flips = [(r["feature"], r["counterfactual_value"]) for r in KK.DRIVER_ACTION_RULES if r["counterfactual_value"]]
    values = "fl AS (" + " UNION ALL ".join(
        f"SELECT customerID, '{f}' AS f, CAST({f} AS VARCHAR) AS old, '{v}' AS new, round_even({SYNTH_P.replace(f, repr(v))}, 4) AS p_new FROM clean" for f, v in flips) + ")"
    q["rule_counterfactuals"] = with_clean(
        "SELECT ar.customerID, ar.priority, ar.action, ar.driver_feature, CASE WHEN fl.f IS NOT NULL THEN round_even(greatest(s.churn_probability - fl.p_new, 0.0) * 100.0, 1) END "
        "AS expected_churn_reduction_pct, CASE WHEN fl.f IS NOT NULL THEN fl.f || ': \'\'' || fl.old || '\'\' -> \'\'' || fl.new || '\'\'' END AS counterfactual_basis "
        "FROM ar JOIN scored s ON ar.customerID = s.customerID LEFT JOIN fl ON fl.customerID = ar.customerID AND fl.f = ar.driver_feature".replace("\'", "'"),
        scored, contrib, long, drivers, rules, base, acts, action_rows, values)
    # Three rule scores, folds and test rows by key
    noise = f"({key} * 13) % 280"
    cand = ("cand AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS name, CASE WHEN {key} % 6 < 5 THEN CAST({key} % 6 AS VARCHAR) ELSE 'test' END AS part, y, CAST({p} AS DOUBLE) AS p FROM scored" for n, p in (
            ("AllSignals", "p"), ("ContractOnly", f"(CASE WHEN Contract = 'Month-to-month' THEN 600 ELSE 200 END + {noise}) / CAST(1000 AS DOUBLE)"),
            ("TenureOnly", "(80 - least(tenure, 80)) / CAST(100 AS DOUBLE)"))) + ")")
    g = "g AS (SELECT name, part, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM cand GROUP BY name, part, p)"
    win = "OVER (PARTITION BY name, part ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    r = f"r AS (SELECT *, sum(pos) {win} AS cum_pos, sum(neg) {win} AS cum_neg FROM g)"
    grid = values_table("grid", "threshold", [(t,) for t in threshold_grid()])
    f1 = "CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0.0 END"
    curve = ("curve AS (SELECT g.name, grid.threshold, sum(CASE WHEN g.p >= grid.threshold THEN g.pos ELSE 0.0 END) AS tp, "
             "sum(CASE WHEN g.p >= grid.threshold THEN g.neg ELSE 0.0 END) AS fp, sum(g.pos) AS P FROM g, grid WHERE g.part <> 'test' GROUP BY g.name, grid.threshold)")
    tuned = f"tuned AS (SELECT name, threshold FROM (SELECT name, threshold, row_number() OVER (PARTITION BY name ORDER BY {f1} DESC, threshold) AS k FROM curve) WHERE k = 1)"
    m = ("m AS (SELECT r.name, r.part, sum(pos) AS P, sum(neg) AS N, sum(neg * (cum_pos - pos + pos / 2.0)) AS auc_num, sum(pos * cum_pos / (cum_pos + cum_neg)) AS ap_num, "
         "sum(CASE WHEN p >= 0.5 THEN pos ELSE 0.0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN neg ELSE 0.0 END) AS fp, "
         "sum(CASE WHEN p >= t.threshold THEN pos ELSE 0.0 END) AS tpt, sum(CASE WHEN p >= t.threshold THEN neg ELSE 0.0 END) AS fpt, "
         "sum(pos * power(p - 1.0, 2) + neg * power(p, 2)) AS sq, max(t.threshold) AS threshold FROM r JOIN tuned t ON r.name = t.name GROUP BY r.name, r.part)")
    f1t = f1.replace("tp", "tpt").replace("fp", "fpt")
    comparison = (
        "comparison AS (SELECT t.name, round_even(c.mean, 6) AS cv_auc_mean, round_even(c.std, 6) AS cv_auc_std, round_even(auc_num / (P * N), 6) AS test_auc, "
        "round_even(ap_num / P, 6) AS test_pr_auc, round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS test_precision, "
        f"round_even(CASE WHEN P > 0 THEN tp / P ELSE 0.0 END, 6) AS test_recall, round_even({f1}, 6) AS test_f1, round_even(sq / (P + N), 6) AS test_brier, "
        f"round_even(threshold, 6) AS tuned_threshold, round_even({f1t}, 6) AS test_f1_at_tuned_threshold, auc_num / (P * N) >= {KK.TARGET_AUC} AS meets_target_auc FROM m t "
        "JOIN (SELECT name, avg(auc_num / (P * N)) AS mean, stddev_pop(auc_num / (P * N)) AS std FROM m WHERE part <> 'test' GROUP BY name) c ON t.name = c.name WHERE t.part = 'test')")
    ctes = (scored, cand, g, r, grid, curve, tuned, m, comparison)
    q["rule_comparison"] = with_clean("SELECT * FROM comparison", *ctes)
    q["rule_best_model"] = with_clean("SELECT name, cv_auc_mean, meets_target_auc AS meets_target FROM comparison ORDER BY cv_auc_mean DESC, name LIMIT 1", *ctes)
    shown = ", ".join(f'{c} AS "{label}"' if c == "name" else f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END AS \"{label}\"" if c == "meets_target_auc"
                      else f'round_even({c}, 4) AS "{label}"' for c, label in KK.DISPLAY_COLUMNS.items())
    q["rule_leaderboard_display"] = with_clean(f"SELECT {shown} FROM comparison", *ctes)
    q["rule_leaderboard_chart"] = with_clean(" UNION ALL ".join(f"SELECT name AS model, '{c}' AS metric, {c} AS value FROM comparison" for c in KK.CHART_METRICS), *ctes)
    # M16
    two = "two AS (SELECT 'rule' AS method, y, p FROM scored UNION ALL SELECT 'shrunk', y, p * 0.5 + 0.25 FROM scored)"
    by = "g AS (SELECT method, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM two GROUP BY method, p)"
    run = "r AS (SELECT *, sum(pos) OVER (PARTITION BY method ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos FROM g)"
    bins = ("e AS (SELECT method, sum(c * abs(acc - conf)) / sum(c) AS ece FROM (SELECT method, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS c, avg(p) AS conf, "
            "avg(CAST(y AS DOUBLE)) AS acc FROM two GROUP BY 1, 2) GROUP BY method)")
    q["rule_methods"] = with_clean(
        "SELECT r.method, round_even(sum(pos * power(p - 1.0, 2) + neg * power(p, 2)) / sum(pos + neg), 6) AS brier, "
        "round_even(sum(neg * (cum_pos - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc, round_even(max(e.ece), 6) AS ece FROM r JOIN e ON r.method = e.method GROUP BY r.method",
        scored, two, by, run, bins)
    # J7
    def ranked(label: int) -> str:
        return ("SELECT col, row_number() OVER (ORDER BY round_even(m, 4) DESC, col) AS rank FROM (" + " UNION ALL ".join(
            f"SELECT '{f}' AS col, avg(abs(CAST({_PHI[f]} AS DOUBLE))) AS m FROM clean WHERE Churn = {label}" for f in _FEATS) + ")")

    q["rule_ranking_comparison"] = with_clean(
        f"SELECT CAST(a.rank AS INT) AS rank, a.col AS \"left\", b.col AS stayed FROM ({ranked(1)}) a JOIN ({ranked(0)}) b ON a.rank = b.rank")
    # E8
    from churnkit.plans.downstream import STRETCH

    def top(weight) -> str:
        rows = " UNION ALL ".join(f"SELECT customerID, '{f}' AS feature, {i} AS ord, CAST({_PHI[f]} AS DOUBLE) * {weight(f)} AS v FROM clean" for i, f in enumerate(_FEATS))
        return (f"SELECT customerID, array_to_string(list_sort(list(feature)), ',') AS own FROM (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(v) DESC, ord) AS k "
                f"FROM ({rows})) WHERE k <= 2 GROUP BY customerID")

    q["rule_agreement"] = with_clean(
        f"SELECT a.customerID, a.own AS first_columns, b.own AS second_columns, a.own = b.own AS agree FROM ({top(lambda f: 1.0)}) a JOIN ({top(lambda f: STRETCH[f])}) b "
        "ON a.customerID = b.customerID")
    # A10, H7
    segments = ("seg AS (SELECT d.segment, CAST(coalesce(a.n, 0) AS BIGINT) AS customers, round_even(a.t, 2) AS avg_tenure, round_even(a.m, 2) AS avg_monthly_charges, "
                "round_even(a.s, 2) AS avg_service_count, round_even(a.c * 100.0, 2) AS churn_rate FROM dim d LEFT JOIN (SELECT CASE WHEN MonthlyCharges < 50 THEN 'Low' "
                f"WHEN MonthlyCharges < 75 THEN 'Mid' ELSE 'High' END AS segment, count(*) AS n, avg(tenure) AS t, avg(MonthlyCharges) AS m, avg({SERVICE_COUNT}) AS s, avg(Churn) AS c "
                "FROM clean GROUP BY 1) a ON d.segment = a.segment)")
    dim = values_table("dim", "segment, ord", [(x, i) for i, x in enumerate(KK.VALUE_SEGMENT_LABELS)])
    q["rule_segments"] = with_clean("SELECT * FROM seg", dim, segments)
    q["rule_segment_profile"] = with_clean("SELECT segment, " + ", ".join(
        f"round_even({c} / max({c}) OVER (), 4) AS {c}" for c in ("avg_tenure", "avg_monthly_charges", "avg_service_count", "churn_rate")) + " FROM seg", dim, segments)
    # C11
    number = lambda c, hi: f"{c}: must be a finite number in [0, {hi:g}]"
    reasons = [(f"{key} % 71 = 0", "SeniorCitizen: not in allowed values"), (f"{key} % 97 = 0", "Contract: not in allowed values"),
               (f"{key} % 89 = 0 OR {key} % 83 = 0", number("tenure", KK.MAX_TENURE_MONTHS)), (f"{key} % 67 = 0", number("MonthlyCharges", KK.MAX_MONTHLY_CHARGES)),
               (f"{key} % 79 = 0 OR {key} % 73 = 0", number("TotalCharges", KK.MAX_TOTAL_CHARGES))]
    errors = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in reasons) + "], lambda x: x IS NOT NULL), ';')"
    q["validated_broken"] = with_clean(f"SELECT customerID, {errors} = '' AS is_valid, {errors} AS errors FROM clean")
    return q
