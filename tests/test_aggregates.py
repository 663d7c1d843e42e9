"""Aggregate operators on generated rows against slow counts in Python, and on edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import base_row, frame

from churnkit import constants as K
from churnkit.operators import cohorts, eda, kpi, tiers


def test_iqr_fence_against_numpy(spark):
    r = random.Random(11)
    values = [round(r.gauss(40, 6), 3) for _ in range(241)] + [400.0, -300.0, 90.5]
    row = eda.summarize_outliers(spark.createDataFrame([(v,) for v in values], "value double"), ["value"]).first()
    low, high = np.quantile(values, [0.25, 0.75])
    fences = low - 1.5 * (high - low), high + 1.5 * (high - low)
    outside = sum(not fences[0] <= v <= fences[1] for v in values)
    assert (row.q1, row.q3, row.lower_bound, row.upper_bound) == pytest.approx((low, high, *fences), abs=1e-6)
    assert outside >= 3 and row.n_outliers == outside
    assert row.pct_outliers == pytest.approx(100 * outside / len(values), abs=0.006)


def test_outliers_empty_column_list(spark):
    df = spark.createDataFrame([(1.0,)], "value double")
    out = eda.summarize_outliers(df, [])
    assert out.count() == 0 and "pct_outliers" in out.columns


def test_moments_are_bias_adjusted(spark):
    vals = [1.0, 2.0, 10.0, 3.0, 7.5, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    row = eda.distribution_stats(df, ["x"]).first()
    s = pd.Series(vals)
    assert row.skew == pytest.approx(s.skew(), abs=1e-6)
    assert row.kurtosis == pytest.approx(s.kurt(), abs=1e-6)
    assert row.std == pytest.approx(s.std(), abs=1e-6)
    assert row.median == pytest.approx(s.median())


def test_cohort_rates_against_a_count(spark):
    r = random.Random(12)
    rows = [(r.choice([*range(20), 30, 41]), int(r.random() < 0.4)) for _ in range(160)]
    got = {x.cohort: x for x in cohorts.cohort_summary(
        frame(spark, [base_row(customerID=f"T-{i}", tenure=t, Churn=c) for i, (t, c) in enumerate(rows)])).collect()}
    edges = [tuple(map(int, name.split("-"))) for name in K.TENURE_COHORT_LABELS]
    for name, (low, high) in zip(K.TENURE_COHORT_LABELS, edges):
        labels = [c for t, c in rows if low < t <= high or t == low == 0]
        assert got[name].customers == len(labels)
        if labels:
            share = 100 * sum(labels) / len(labels)
            assert (got[name].churn_rate, got[name].retention_rate) == pytest.approx((share, 100 - share), abs=0.006)
        else:
            assert got[name].churn_rate is None and got[name].retention_rate is None
    assert any(not x.customers for x in got.values())


def test_retention_curve_shape(spark):
    df = frame(spark, [base_row(customerID=f"T-{i}", tenure=t) for i, t in enumerate([0, 5, 5, 30, 70, 75])])
    curve = cohorts.empirical_retention_curve(df, max_month=80).collect()
    pct = [r.retention_pct for r in curve]
    assert pct[0] == 100.0 and all(a >= b for a, b in zip(pct, pct[1:])) and pct[-1] == 0.0
    assert curve[75].n_at_risk == 1 and curve[76].n_at_risk == 0


def test_risk_signal_diagnostic_sparse(spark):
    out = cohorts.risk_signal_diagnostic(frame(spark, [base_row()])).collect()
    assert [r.customers for r in out] == [1, 0, 0, 0, 0]


def test_kpi_clv_requires_churn(spark):
    df = frame(spark, [base_row(customerID=f"T-{i}", Churn=0) for i in range(3)])
    with pytest.raises(Exception, match="CLV"):
        kpi.kpi_row(df).collect()


def test_kpi_zero_revenue_has_undefined_lost_share(spark):
    df = frame(spark, [base_row(customerID="a", MonthlyCharges=0.0, Churn=1),
                       base_row(customerID="b", MonthlyCharges=0.0, Churn=0)])
    row = kpi.kpi_row(df).first()
    assert row.total_mrr == 0.0 and row.lost_mrr_pct is None


def test_tier_summary_counts_every_row(spark):
    r = random.Random(13)
    df = tiers.assign_risk_tiers(spark.createDataFrame([(r.random() ** 2,) for _ in range(333)], "churn_probability double"))
    count = Counter(x.risk_tier for x in df.collect())
    got = tiers.risk_tier_summary(df).collect()
    assert {x.risk_tier: x["count"] for x in got} == count and sum(count.values()) == 333
    assert [x.pct for x in got] == pytest.approx([100 * count[x.risk_tier] / 333 for x in got], abs=0.06)


def test_tier_summary_empty(spark):
    df = spark.createDataFrame([], "churn_probability double")
    out = [(r["count"], r.pct) for r in tiers.risk_tier_summary(tiers.assign_risk_tiers(df)).collect()]
    assert out == [(0, 0.0)] * 4


def test_chi_square_pvalue_matches_closed_forms(spark):
    from churnkit.operators.association import chi_square_service_association
    from churnkit.plans.registry import cleaned

    out = chi_square_service_association(cleaned(spark, "/root/testdata/sf0.001")).collect()
    for r in out:
        if r.dof == 2:
            assert r.p_value == pytest.approx(math.exp(-r.chi2 / 2), rel=1e-3)
        if r.dof == 1:
            assert r.p_value == pytest.approx(math.erfc(math.sqrt(r.chi2 / 2)), rel=1e-3)


def test_class_density_integrates_to_one(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.gauss(50, 10)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "MonthlyCharges double, Churn int")
    out = eda.class_density(df, ["MonthlyCharges"]).orderBy("Churn", "point").collect()
    for cls in (0, 1):
        pts = [r for r in out if r.Churn == cls]
        assert len(pts) == 200
        dx = pts[1].x - pts[0].x
        assert sum(r.density for r in pts) * dx == pytest.approx(1.0, abs=0.01)
