"""CSV reading, the clean cache, the leaderboard's contract, zero-width densities and condition parsing."""

import pytest
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.columns import lime_condition_column
from churnkit.operators import eda
from churnkit.plans.registry import raw
from churnkit.sources import artifacts
from churnkit.sources.subscribers import CORRUPT, current_clean, load_clean, publish_clean, read_raw_csv
from tests.conftest import base_row, frame

SF = "/root/testdata/sf0.001"


def test_corrupt_lines_are_kept_apart_and_counted(spark, tmp_path):
    raw(spark, SF).coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*.csv"))
    (tmp_path / "one.csv").write_text(part.read_text() + "C-bad,Female,notanumber\n" + "C-worse,Male,0,Yes,No,many" + ",x" * 15 + "\n")
    df = read_raw_csv(spark, str(tmp_path / "one.csv"))
    assert {r[CORRUPT].split(",")[0] for r in df.where(F.col(CORRUPT).isNotNull()).collect()} == {"C-bad", "C-worse"}
    clean = load_clean(spark, str(tmp_path / "clean"), lambda: df)
    assert clean.count() == 1500 and CORRUPT not in clean.columns
    assert current_clean(spark, str(tmp_path / "clean"))["notes"] == {"lines": 1502, "corrupt_lines": 2}


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    out, built = str(tmp_path), []

    def build(n):
        built.append(n)
        return raw(spark, SF).orderBy(K.ID_COLUMN).limit(n)

    assert load_clean(spark, out, lambda: build(10)).count() == 10
    assert load_clean(spark, out, lambda: build(20)).count() == 10 and built == [10]
    before = load_clean(spark, out, lambda: build(20))
    with monkeypatch.context() as m:  # stopped before the pointer is swapped
        m.setattr(artifacts, "write_bytes", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            load_clean(spark, out, lambda: build(30), rebuild=True)
    assert load_clean(spark, out, lambda: build(40)).count() == 10
    assert load_clean(spark, out, lambda: build(50), rebuild=True).count() == 50
    assert before.count() == 10  # a reader of the old version goes on
    back = spark.read.option("header", True).csv(f"{out}/{current_clean(spark, out)['version']}/clean.csv")
    assert back.count() == 50 and back.columns == K.RAW_COLUMNS
    publish_clean(spark, load_clean(spark, out, lambda: build(1)), out)
    assert len(list(tmp_path.glob("v-*"))) <= 4


def test_leaderboards_hold_to_their_contract(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="training job"):
        artifacts.load_leaderboard(spark, str(tmp_path / "none"))
    row = {c: "m" if c == "name" else True if c == "meets_target_auc" else 0.5 for c in K.LEADERBOARD_COLUMNS}
    table = spark.createDataFrame([tuple(row.values()), ("a", *list(row.values())[1:])], list(row))
    artifacts.save_comparison(table, str(tmp_path / "ok"))
    assert [r["name"] for r in artifacts.load_leaderboard(spark, str(tmp_path / "ok")).collect()] == ["a", "m"]
    artifacts.save_comparison(table.drop("test_f1"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="test_f1"):
        artifacts.load_leaderboard(spark, str(tmp_path / "short"))


def test_sidecars_hold_numbers_and_columns(spark, tmp_path):
    artifacts.save_sidecar(spark, str(tmp_path), "m", {"auc": 0.5, "n": 3, "flag": True, "name": "x"}, {"data_fingerprint": "f"})
    meta = artifacts.load_metadata(spark, str(tmp_path))
    assert meta["metrics"] == {"auc": 0.5, "n": 3.0} and meta["feature_columns"] == K.FEATURE_COLUMNS and meta["data_fingerprint"] == "f"
    with pytest.raises(FileNotFoundError, match="train"):
        artifacts.load_metadata(spark, str(tmp_path / "none"))


def test_a_class_without_spread_has_a_peak(spark):
    rows = [base_row(customerID=f"T-{k}", MonthlyCharges=50.0 if k < 5 else 20.0 + k, Churn=int(k < 5)) for k in range(12)]
    found = eda.class_density(frame(spark, rows), ["MonthlyCharges"]).collect()
    assert {r["Churn"] for r in found} == {0, 1} and len(found) == 400
    peak = [r for r in found if r["Churn"] == 1]
    assert all(abs(r["x"] - 50.0) < 1e-3 for r in peak)
    step = peak[0].asDict()
    assert max(r["density"] for r in peak) > 1000 and step["density"] >= 0


def test_conditions_name_one_column(spark):
    df = spark.createDataFrame([("0.50 < tenure <= 2.00",), ("Contract=One year",)], "c string")
    cols = ["tenure", "Contract", "TotalCharges"]
    assert [r[0] for r in df.select(lime_condition_column(F.col("c"), cols)).collect()] == ["tenure", "Contract"]
    for bad in ("nothing here", "tenure and Contract"):
        with pytest.raises(Exception, match="exactly one column"):
            spark.createDataFrame([(bad,)], "c string").select(lime_condition_column(F.col("c"), cols)).collect()
