"""Metric operators against brute-force definitions."""

import pytest

from churnkit.operators import metrics


def _frame(spark, ys, ps):
    return spark.createDataFrame(list(zip(ys, ps)), "y int, p double")


def _brute(ys, ps, t=0.5):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    order = sorted(set(ps), reverse=True)
    ap, prev_r = 0.0, 0.0
    for s in order:
        tp = sum(1 for y, p in zip(ys, ps) if p >= s and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= s and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    brier = sum((p - y) ** 2 for y, p in zip(ys, ps)) / len(ys)
    return auc, ap, brier


def test_auc_ap_brier(spark):
    ys = [0, 1, 0, 1, 0, 1, 1, 0]
    ps = [.1, .9, .2, .6, .4, .8, .3, .05]
    row = metrics.classification_metrics(_frame(spark, ys, ps)).first()
    auc, ap, brier = _brute(ys, ps)
    assert row.auc == pytest.approx(auc, abs=1e-6)
    assert row.pr_auc == pytest.approx(ap, abs=1e-6)
    assert row.brier == pytest.approx(brier, abs=1e-6)


def test_auc_with_ties_and_many_buckets(spark):
    import random

    rnd = random.Random(7)
    ys = [rnd.randint(0, 1) for _ in range(400)]
    ps = [round(rnd.random(), 2) for _ in range(400)]
    row = metrics.classification_metrics(_frame(spark, ys, ps)).first()
    auc, ap, brier = _brute(ys, ps)
    assert row.auc == pytest.approx(auc, abs=1e-6) and row.pr_auc == pytest.approx(ap, abs=1e-6)


def test_degenerate_threshold_gives_zero(spark):
    row = metrics.classification_metrics(_frame(spark, [0, 1, 0, 1], [.1, .2, .15, .3]), threshold=0.99).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_threshold_tie_takes_lowest(spark):
    df = _frame(spark, [0, 0, 0, 1, 1, 1], [.1, .2, .3, .7, .8, .9])
    row = metrics.tune_decision_threshold(df, grid=[0.4, 0.45, 0.5]).first()
    assert (row.tuned_threshold, row.best_f1) == (0.4, 1.0)


def test_grid_is_bit_identical_to_linspace():
    import numpy as np

    assert metrics.threshold_grid() == list(np.linspace(0.05, 0.95, 91))


@pytest.mark.parametrize("ys,ps,want", [
    ([1, 0] * 50, [.5] * 100, 0.0),
    ([1, 1, 0, 0], [.1, .1, .9, .9], 0.9),
    ([1], [1.0], 0.0),
])
def test_ece(spark, ys, ps, want):
    assert metrics.expected_calibration_error(_frame(spark, ys, ps)).first().ece == pytest.approx(want)


def test_ece_empty(spark):
    assert metrics.expected_calibration_error(_frame(spark, [], [])).first().ece == 0.0


def test_leakage_guard():
    metrics.check_auc_leakage_guard(0.95)
    with pytest.raises(ValueError):
        metrics.check_auc_leakage_guard(0.9501)


def test_groups_are_measured_as_if_alone(spark):
    import random

    rnd = random.Random(11)
    rows = [(g, rnd.randint(0, 1), rnd.choice([round(rnd.random(), 2), rnd.random(), 0.0, 1.0])) for g in ("a", "b", None) for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    found = {r.g: r for r in metrics.classification_metrics(df, by=["g"]).collect()}
    ece = {r.g: r.ece for r in metrics.expected_calibration_error(df, by=["g"]).collect()}
    tuned = {r.g: r for r in metrics.tune_decision_threshold(df, by=["g"]).collect()}
    for g in ("a", "b", None):
        own = _frame(spark, *zip(*[(y, p) for h, y, p in rows if h == g]))
        alone = metrics.classification_metrics(own).first()
        assert tuple(found[g])[1:] == tuple(alone) and ece[g] == metrics.expected_calibration_error(own).first().ece
        assert tuple(tuned[g])[1:] == tuple(metrics.tune_decision_threshold(own).first())
        ys, ps = zip(*[(y, p) for h, y, p in rows if h == g])
        auc, ap, brier = _brute(ys, ps)
        assert (alone.auc, alone.pr_auc, alone.brier) == pytest.approx((auc, ap, brier), abs=1e-6)


def test_metrics_read_their_input_once(spark, tmp_path):
    from tests.helpers import executed

    _frame(spark, [0, 1, 0, 1], [.1, .9, .2, .6]).write.parquet(str(tmp_path / "scores"))
    plan = executed(metrics.classification_metrics(spark.read.parquet(str(tmp_path / "scores"))))
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_methods_are_compared_from_one_table(spark):
    df = spark.createDataFrame([(1, .9, .8), (0, .2, .1), (1, .4, .6), (0, .6, .3)], "y int, p_raw double, p_cal double")
    found = {r.method: r for r in metrics.method_metrics(df, {"raw": "p_raw", "calibrated": "p_cal"}).collect()}
    report = metrics.calibration_report(df).first()
    for method, c in (("raw", "p_raw"), ("calibrated", "p_cal")):
        alone = metrics.classification_metrics(df, p=c).first()
        assert (found[method].brier, found[method].auc) == (alone.brier, alone.auc) == (report[f"brier_{method}"], report[f"auc_{method}"])
        assert found[method].ece == metrics.expected_calibration_error(df, p=c).first().ece == report[f"ece_{method}"]
