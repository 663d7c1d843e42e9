"""Model-path invariants: exact stratified split, SHAP additivity, unseen levels,
scoring contract, streaming sinks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.ml import blocks as B
from churnkit.ml import boosting, forest, linear
from churnkit.ml.ensemble import Trees, joined_trees
from churnkit.ml.features import fit_encoder
from churnkit.ml.split import split_assign
from churnkit.plans.registry import cleaned, raw
from tests.conftest import base_row, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    return split_assign(cleaned(spark, SF)).cache()


def test_split_is_exactly_stratified(split):
    counts = {(r.Churn, r.is_test): r["count"] for r in split.groupBy("Churn", "is_test").count().collect()}
    for c in (0, 1):
        n = counts[(c, True)] + counts[(c, False)]
        assert counts[(c, True)] == round(0.2 * n)
    assert split.where("is_test AND fold IS NOT NULL").count() == 0
    assert {r.fold for r in split.where("NOT is_test").select("fold").distinct().collect()} == set(range(5))


def test_split_is_partition_independent(spark, split):
    other = split_assign(cleaned(spark, SF).repartition(3))
    a = sorted((r.customerID, r.is_test, r.fold) for r in split.select("customerID", "is_test", "fold").collect())
    b = sorted((r.customerID, r.is_test, r.fold) for r in other.select("customerID", "is_test", "fold").collect())
    assert a == b


@pytest.fixture(scope="module")
def blocks(spark, split, tmp_path_factory):
    train = split.where("NOT is_test")
    encoder, path = fit_encoder(train), str(tmp_path_factory.mktemp("blocks") / "blocks")
    B.pack(train, encoder).write.parquet(path)
    return spark.read.parquet(path), encoder, path


def boosted(spark, blocks, **sizes):
    table, encoder, path = blocks
    job = boosting.Job("x", B.WHOLE, boosting.Boosted(**sizes))
    return boosting.Booster(spark, table, encoder, [job], f"{path}-{boosting.jobs_key([job])}", 1).train()[0]


@pytest.fixture(scope="module")
def gbt(spark, blocks):
    return boosted(spark, blocks, rounds=8, depth=3, rate=0.2)


@pytest.fixture(scope="module")
def lr(blocks):
    return linear.train(blocks[0], blocks[1], [B.WHOLE], 10.0, 100)[0]


@pytest.fixture(scope="module")
def deep(blocks):
    """A forest of two trees grown to pure leaves."""
    table, encoder, _ = blocks
    rows = forest.train(table, encoder, [B.WHOLE], 2, 1).drop("fit").collect()
    return joined_trees(encoder, False, 0.0, [tuple(r) for r in rows])


def depth(trees):
    levels = {r: 0 for r in trees.roots.tolist()}
    for node, f in enumerate(trees.feature.tolist()):
        if f >= 0:
            levels[int(trees.left[node])] = levels[int(trees.left[node]) + 1] = levels[node] + 1
    return max(levels.values())


def additive(spark, model, rows, out, names=None):
    from churnkit.ml.shap import shap_contributions

    c = shap_contributions(spark, model, rows)
    phis = [x for x in c.columns if x.startswith("phi_")]
    assert {p[4:] for p in phis} == set(K.FEATURE_COLUMNS)
    total = {r[0]: r[1] for r in c.select(K.ID_COLUMN, (sum(F.col(x) for x in phis) + F.col("shap_base")).alias("s")).collect()}
    assert all(abs(total[r[K.ID_COLUMN]] - r["m"]) < 1e-9 for r in out.collect()) and len(total) == rows.count()


def test_tree_shap_is_additive(spark, split, gbt, lr):
    from churnkit.ml.score import ModelScorer

    for model in (gbt, lr):
        additive(spark, model, split, ModelScorer(model).transform(split, out="m", margin=True))


def test_deep_forests_are_explained(spark, split, deep):
    from churnkit.ml.score import ModelScorer

    assert depth(deep) > 12
    some = split.orderBy(K.ID_COLUMN).limit(60)
    additive(spark, deep, some, ModelScorer(deep).transform(some, out="m"))


def expectation(t, root, codes, known):
    """What a tree says on average where only the features in ``known`` are known."""
    f = int(t.feature[root])
    if f < 0:
        return float(t.value[root])
    a = int(t.left[root])
    if f in known:
        return expectation(t, a + int(codes[f] > t.cut[root]), codes, known)
    return sum(expectation(t, c, codes, known) * float(t.cover[c]) for c in (a, a + 1)) / float(t.cover[root])


def made_tree(encoder, rng, features, levels=6):
    """A full tree of random tests on a few features."""
    n = 2 ** (levels + 1) - 1
    feature, cut, left, cover = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n)
    cover[0] = 1000.0
    for k in range(2**levels - 1):
        feature[k], cut[k], left[k] = rng.choice(features), rng.integers(0, 5), 2 * k + 1
        share = rng.uniform(0.1, 0.9)
        cover[2 * k + 1], cover[2 * k + 2] = cover[k] * share, cover[k] * (1 - share)
    return Trees(encoder, True, 0.3, np.zeros(1, np.int32), feature, cut, left, rng.normal(size=n), cover)


def test_values_equal_brute_force_on_trees_of_six_levels(blocks, monkeypatch):
    from churnkit.ml import shap

    rng, encoder = np.random.default_rng(3), blocks[1]
    features = [0, 1, 2, 5, 9, 14, 20]
    tree = made_tree(encoder, rng, features)
    codes = rng.integers(0, 6, (4, encoder.width)).astype(np.uint8)
    for table in (0, 4, 7):
        monkeypatch.setattr(shap, "TABLE_FEATURES", table)
        found = shap.PathTables(tree).values(codes, np.arange(encoder.width), encoder.width)
        for i in range(len(codes)):
            for f in features:
                others, want = [g for g in features if g != f], 0.0
                for n in range(len(features)):
                    w = math.factorial(n) * math.factorial(len(features) - n - 1) / math.factorial(len(features))
                    for some in itertools.combinations(others, n):
                        want += w * (expectation(tree, 0, codes[i], {*some, f}) - expectation(tree, 0, codes[i], set(some)))
                assert found[i, f] == pytest.approx(want, abs=1e-9)


def test_trees_walk_as_their_nodes_say(blocks):
    tree = made_tree(blocks[1], np.random.default_rng(4), [0, 3, 7])
    codes = np.random.default_rng(5).integers(0, 6, (50, blocks[1].width)).astype(np.uint8)
    for row, leaf in zip(codes, tree.leaves(codes)[:, 0].tolist()):
        node = 0
        while tree.feature[node] >= 0:
            node = int(tree.left[node]) + int(row[tree.feature[node]] > tree.cut[node])
        assert node == leaf


def test_unseen_level_scores_without_error(spark, gbt, split):
    from churnkit.ml.score import ModelScorer

    odd = split.limit(3).withColumn("PaymentMethod", F.lit("Crypto"))
    assert ModelScorer(gbt).transform(odd).count() == 3


def test_score_contract(spark, gbt):
    from churnkit.ml.score import ModelScorer, classify_scored_customers

    out = classify_scored_customers(raw(spark, SF), ModelScorer(gbt))
    assert out.columns == ["customerID", "churn_probability", "churn_probability_pct", "risk_tier"]
    row = out.agg(F.min("churn_probability"), F.max("churn_probability"), F.count("*")).first()
    assert 0.0 <= row[0] <= row[1] <= 1.0 and row[2] == 1500
    empty = classify_scored_customers(raw(spark, SF).limit(0), ModelScorer(gbt))
    assert empty.count() == 0


def test_missing_feature_column_is_named(spark, gbt):
    from churnkit.ml.score import ModelScorer, score_customers

    with pytest.raises(ValueError, match="Contract.*tenure|tenure.*Contract"):
        score_customers(raw(spark, SF).drop("Contract", "tenure"), ModelScorer(gbt))


def test_validation_rejects_with_reasons(spark):
    from churnkit.operators.clean import validate

    df = raw(spark, SF).orderBy(K.ID_COLUMN).limit(4)  # four rows, chosen independently of partitioning
    target = df.first()[K.ID_COLUMN]
    bad = df.withColumn("Contract", F.when(F.col("customerID") == target, "Lifetime").otherwise(F.col("Contract")))
    out = {r.customerID: r for r in validate(bad.drop("Churn")).collect()}
    assert len(out) == 4
    assert not out[target].is_valid and out[target].errors == ["Contract: not in allowed values"]
    assert all(r.is_valid for k, r in out.items() if k != target)
    leaked = validate(df).collect()  # a Churn column is an extra field: every row rejected
    assert not any(r.is_valid for r in leaked)


def test_stream_scores_valid_and_quarantines_invalid(spark, gbt, tmp_path):
    from churnkit.ml.score import ModelScorer
    from churnkit.streaming import scoring_stream

    land = str(tmp_path / "land")
    src = raw(spark, SF).drop("Churn")
    src = src.withColumn("tenure", F.when(F.col("customerID") == "C-1", F.lit(5000)).otherwise(F.col("tenure")))
    src.repartition(3).write.parquet(land)
    stream = scoring_stream.read_subscriber_stream(spark, land, max_files_per_trigger=1)
    q = scoring_stream.start_scoring_stream(spark, stream, ModelScorer(gbt), str(tmp_path / "out"),
                                            str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1499
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [b.customerID for b in bad] == ["C-1"] and bad[0].errors == ["tenure: must be a finite number in [0, 1200]"]


def test_a_batch_that_fails_and_runs_again_leaves_no_row_twice(spark, gbt, tmp_path):
    from churnkit.ml.score import ModelScorer
    from churnkit.streaming import scoring_stream

    class Failing(ModelScorer):
        def transform(self, *args, **kwargs):
            raise RuntimeError("lost")

    src = raw(spark, SF).drop("Churn").orderBy(K.ID_COLUMN).limit(40)
    src = src.withColumn("tenure", F.when(F.col(K.ID_COLUMN) == src.first()[K.ID_COLUMN], F.lit(5000)).otherwise(F.col("tenure")))
    src.write.parquet(str(tmp_path / "land"))

    def run(scorer):
        stream = scoring_stream.read_subscriber_stream(spark, str(tmp_path / "land"))
        scoring_stream.start_scoring_stream(spark, stream, scorer, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(Failing(gbt))
    run(ModelScorer(gbt))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 39 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    with pytest.raises(ValueError, match="label"):
        scoring_stream.start_scoring_stream(spark, raw(spark, SF), ModelScorer(gbt), "a", "b", "c")


def test_stream_refuses_without_model(spark, tmp_path):
    from churnkit.streaming import scoring_stream

    with pytest.raises(FileNotFoundError, match="train"):
        scoring_stream.require_models(spark, str(tmp_path / "nothing"))


def test_train_and_test_are_disjoint_and_cover_all_rows(spark, split):
    """Anti joins both ways are empty; together the two sides are the table."""
    test, train = split.where("is_test"), split.where("NOT is_test")
    assert test.join(train, K.ID_COLUMN, "left_semi").count() == 0
    assert train.join(test, K.ID_COLUMN, "left_semi").count() == 0
    assert test.count() + train.count() == cleaned(spark, SF).count()


def test_hash_sample_is_deterministic_and_partition_independent(spark):
    """The md5-ordered sample does not depend on partitioning, equals the n
    smallest digests, and drops the label like the original."""
    import hashlib

    from churnkit.operators.clean import hash_sample

    df = raw(spark, SF)
    a = [r.customerID for r in hash_sample(df, 5).collect()]
    b = [r.customerID for r in hash_sample(df.repartition(7), 5).collect()]
    ids = [r.customerID for r in df.select(K.ID_COLUMN).collect()]
    ref = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:5]
    assert a == b == ref


def test_calibration_metrics_round_trip(spark, tmp_path):
    """The one-row report is written as JSON and read back with its schema."""
    from churnkit.sources import artifacts

    row = ("XGBoost", "isotonic", 0.15, 0.14, 0.84, 0.83, 0.08, 0.03)
    path = str(tmp_path / "calibration_metrics")
    artifacts.save_calibration_metrics(spark.createDataFrame([row], artifacts.CALIBRATION_METRICS), path)
    back = artifacts.load_calibration_metrics(spark, path).collect()
    assert [tuple(r) for r in back] == [row]
    with pytest.raises(FileNotFoundError):
        artifacts.load_calibration_metrics(spark, str(tmp_path / "missing"))


def test_folds_are_stratified(split):
    n = {(r.Churn, r.fold): r["count"] for r in split.where("NOT is_test").groupBy("Churn", "fold").count().collect()}
    for label in (0, 1):
        sizes = [n[label, f] for f in range(K.CV_FOLDS)]
        assert max(sizes) - min(sizes) <= 1


def test_linear_contributions_do_not_depend_on_the_rows_explained(spark, split, lr):
    from churnkit.ml.shap import shap_contributions

    some = split.orderBy(K.ID_COLUMN).limit(5)
    phi = {r[K.ID_COLUMN]: r for r in shap_contributions(spark, lr, split, keep=[K.ID_COLUMN]).collect()}
    for r in shap_contributions(spark, lr, some, keep=[K.ID_COLUMN]).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(tuple(r)[1:], tuple(phi[r[K.ID_COLUMN]])[1:]))


def test_queries_train_models_of_the_reference_sizes(spark, monkeypatch):
    from churnkit.ml import train, workflow

    forest_, boosted_ = train.REFERENCE_PROFILE["RandomForest"], train.REFERENCE_PROFILE["XGBoost"]
    assert (forest_["trees"], boosted_["rounds"], boosted_["depth"], train.DIAGNOSTIC_PARAMS["rounds"]) == (300, 200, 4, 200)
    asked = []

    def compare(run):
        asked.append((run.profile, run.oversample))
        raise RuntimeError("seen")

    monkeypatch.setattr(workflow, "compare_models", compare)
    monkeypatch.setattr(workflow, "CACHE_VERSION", "test-sizes")
    small = {"LogisticRegression": {"kind": "linear", "inverse_ridge": 10.0, "steps": 5}}
    for profile in (None, small):
        with pytest.raises(RuntimeError, match="seen"):
            workflow.comparison(spark, SF, profile)
    assert asked == [(train.REFERENCE_PROFILE, True), (small, True)]
    assert workflow.run_dir(spark, SF, "comparison", profile=small) != workflow.run_dir(spark, SF, "comparison")


class Halving:
    """A stand-in scorer: 0.8 for a month-to-month contract, half of it otherwise, less 0.1 with tech support."""

    def column(self, df, changes=None):
        def p(contract, support):
            return F.when(contract == "Month-to-month", 0.8).otherwise(0.4) - F.when(support == "Yes", 0.1).otherwise(0.0)

        own = {c: F.col(c) for c in ("Contract", "TechSupport")}
        out = [p(own["Contract"], own["TechSupport"])]
        for c, v in (changes or {}).items():
            now = own | ({c: F.lit(v)} if c in own else {})
            out.append(p(now["Contract"], now["TechSupport"]))
        return F.array(*out)


def test_impacts_of_known_flips(spark, split, gbt):
    """A flip from month-to-month halves 0.8, tech support takes off 0.1; nothing is below zero, other actions have no impact."""
    from churnkit.ml.actions import FLIPS, recommend_for_customers

    out = recommend_for_customers(spark, split, Halving(), gbt).collect()
    by = {r[K.ID_COLUMN]: r for r in split.collect()}
    seen = set()
    for r in out:
        if r["source"] != "driver" or r["driver_feature"] not in FLIPS:
            assert r["expected_churn_reduction_pct"] is None and r["counterfactual_basis"] is None
            continue
        f = r["driver_feature"]
        old = by[r[K.ID_COLUMN]]
        want = {"Contract": 40.0, "TechSupport": 10.0}.get(f, 0.0)
        assert r["expected_churn_reduction_pct"] == pytest.approx(want if (f != "Contract" or old["Contract"] == "Month-to-month") else 0.0)
        assert r["counterfactual_basis"] == f"{f}: '{old[f]}' -> '{FLIPS[f]}'"
        seen.add(f)
    assert {"Contract", "TechSupport"} <= seen


def test_flips_are_scores_of_the_changed_rows(spark, split, gbt, lr):
    from churnkit.ml.actions import FLIPS
    from churnkit.ml.calibrate import Isotonic, Sigmoid
    from churnkit.ml.score import CalibratedScorer, ModelScorer

    calibrated = CalibratedScorer([(gbt, Isotonic(np.array([0.1, 0.9]), np.array([0.0, 1.0]))), (lr, Sigmoid(1.5, -0.2, True))])
    for scorer in (ModelScorer(gbt), calibrated):
        rows = split.withColumn("_p", scorer.column(split, FLIPS)).select(K.ID_COLUMN, "_p")
        got = {r[K.ID_COLUMN]: r["_p"] for r in rows.collect()}
        for k, (c, v) in enumerate([(None, None), *FLIPS.items()]):
            changed = split if c is None else split.withColumn(c, F.lit(v))
            assert all(got[r[K.ID_COLUMN]][k] == pytest.approx(r["p"], abs=1e-12) for r in scorer.transform(changed).collect())


def test_recommendations_evaluate_every_row_once(spark, split, gbt, tmp_path):
    from churnkit.ml.actions import recommend_for_customers
    from churnkit.ml.score import ModelScorer
    from tests.helpers import executed

    split.write.parquet(str(tmp_path / "split"))
    plan = executed(recommend_for_customers(spark, spark.read.parquet(str(tmp_path / "split")), ModelScorer(gbt), gbt))
    assert plan.count("MapInPandas") == 1 and plan.count("ArrowEvalPython") == 1 and "Union" not in plan and "Join" not in plan


def test_validated_subscribers_reports_raw_values_that_cleaning_would_mend(spark, monkeypatch):
    from churnkit.plans import registry

    rows = raw(spark, SF)
    ids = [r[0] for r in rows.select(K.ID_COLUMN).orderBy(K.ID_COLUMN).limit(2).collect()]
    broken = rows.withColumn("TotalCharges", F.when(F.col(K.ID_COLUMN) == ids[0], "abc").otherwise(F.col("TotalCharges")))
    broken = broken.withColumn("SeniorCitizen", F.when(F.col(K.ID_COLUMN) == ids[1], 7).otherwise(F.col("SeniorCitizen")))
    monkeypatch.setattr(registry, "raw", lambda s, d: broken)
    got = {r[K.ID_COLUMN]: r.errors for r in registry.all_queries()["validated_subscribers"](spark, SF).where("NOT is_valid").collect()}
    assert got == {ids[0]: "TotalCharges: must be a finite number in [0, 1e+07]", ids[1]: "SeniorCitizen: not in allowed values"}


def test_stream_refuses_rows_whose_file_holds_a_label(spark, gbt, tmp_path):
    from churnkit.ml.score import ModelScorer
    from churnkit.streaming import scoring_stream

    src = raw(spark, SF).orderBy(K.ID_COLUMN).limit(40).cache()
    first = src.first()[K.ID_COLUMN]
    src.where(F.col(K.ID_COLUMN) == first).write.parquet(str(tmp_path / "land"))
    src.where(F.col(K.ID_COLUMN) != first).drop(K.TARGET_COLUMN).write.mode("append").parquet(str(tmp_path / "land"))
    stream = scoring_stream.read_subscriber_stream(spark, str(tmp_path / "land"))
    scoring_stream.start_scoring_stream(spark, stream, ModelScorer(gbt), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 39
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [(b[K.ID_COLUMN], b.errors) for b in bad] == [(first, ["Churn: extra field not permitted"])]


def test_segments_scale_their_rows_once_for_all_runs(spark, monkeypatch):
    from churnkit.ml import segment

    fits, plain = [], segment.StandardScaler.fit
    monkeypatch.setattr(segment.StandardScaler, "fit", lambda self, *a: fits.append(1) or plain(self, *a))
    r = np.random.default_rng(1)
    rows = frame(spark, [base_row(customerID=f"T-{i}", tenure=int(r.integers(0, 73)), MonthlyCharges=float(r.integers(20, 110))) for i in range(60)])
    model = segment.fit_segmentation(rows, n_init=3)
    assert len(fits) == 1 and {r.ValueSegment for r in segment.assign_value_segment(rows, model).collect()} == {"Low", "Mid", "High"}
    assert segment.silhouette_diagnostic(rows, ks=(2, 3)).count() == 2 and len(fits) == 2


def test_runs_of_k_means_hold_their_vectors_themselves(spark, monkeypatch):
    from churnkit.ml import segment

    seen, plain = [], segment.KMeans.fit
    monkeypatch.setattr(segment.KMeans, "fit", lambda self, rows, *a: seen.append(rows.storageLevel.useMemory) or plain(self, rows, *a))
    r = np.random.default_rng(2)
    rows = frame(spark, [base_row(customerID=f"T-{i}", tenure=int(r.integers(0, 73)), MonthlyCharges=float(r.integers(20, 110))) for i in range(60)])
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    segment.fit_segmentation(rows, n_init=2)
    segment.silhouette_diagnostic(rows, ks=(2,))
    # of an input that is held already, k-means would decode every row anew in each iteration
    assert seen == [False] * 3
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
