"""Fits against slow ones: boosting, forests, logistic regression, over-sampling, calibrators; the ledger; leases and fingerprints."""

import json
import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.ml import blocks as B
from churnkit.ml import boosting, calibrate, ensemble, forest, linear, smote
from churnkit.ml.features import LEVEL_BINS, NUMERIC_BINS, Rows, fit_encoder
from churnkit.ml.ledger import Ledger
from churnkit.ml.split import hash_cuts, split_assign
from churnkit.ml.train import Training, boosted_sizes
from churnkit.plans.registry import cleaned
from churnkit.sources import artifacts

SF = "/root/testdata/sf0.001"
SMALL = {"LogisticRegression": {"kind": "linear", "inverse_ridge": 10.0, "steps": 100}, "RandomForest": {"kind": "forest", "trees": 6},
         "XGBoost": {"kind": "boosted", "rounds": 7, "depth": 3, "rate": 0.2, "l2": 1.0, "least_hessian": 1.0}}


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split") / "split")
    split_assign(cleaned(spark, SF)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def training(spark, split, tmp_path_factory):
    return Training(spark, split, str(tmp_path_factory.mktemp("training")), SMALL)


def local(table, encoder):
    blocks = [b for rb in table.toArrow().to_batches() for b in B.unpacked(encoder, rb)]
    return blocks


def rows_of(training, fit, oversampled=True):
    """Codes, values and labels that a fit learns from."""
    encoder = training.encoder()
    own = [(b, b.used(fit)) for b in local(training.blocks(oversampled), encoder)]
    return (np.concatenate([b.rows.codes()[u] for b, u in own]), np.concatenate([b.rows.take(u).values() for b, u in own]), np.concatenate([b.y[u] for b, u in own]).astype(float))


# --- boosting --------------------------------------------------------------------------------

def slow_booster(codes, y, sizes, numeric):
    """Second-order boosting by trying every cut of every slot, one node at a time."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    margin = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(sizes.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-16)
        tree = {}

        def best(rows):
            found = (0.0, None, None)
            for slot in range(codes.shape[1]):
                for cut in range((NUMERIC_BINS if slot < numeric else LEVEL_BINS) - 1):
                    left = rows[codes[rows, slot] <= cut]
                    if not len(left) or len(left) == len(rows):
                        continue
                    gl, hl, gt, ht = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()  # noqa: B023
                    if min(hl, ht - hl) < sizes.least_hessian or min(len(left), len(rows) - len(left)) < sizes.least_rows:
                        continue
                    gain = gl**2 / (hl + sizes.l2) + (gt - gl) ** 2 / (ht - hl + sizes.l2) - gt**2 / (ht + sizes.l2)
                    if round(gain, 9) > round(found[0], 9):
                        found = (gain, slot, cut)
            return found

        def build(name, rows, depth):
            tree[name] = (rows, *best(rows)) if depth < sizes.depth else (rows, 0.0, None, None)  # noqa: B023
            _, gain, slot, cut = tree[name]  # noqa: B023
            if gain > 1e-6:
                on = codes[rows, slot] <= cut
                build(name + "l", rows[on], depth + 1)
                build(name + "r", rows[~on], depth + 1)

        build("", np.arange(len(y)), 0)
        # best leaf first, up to the number of leaves
        leaves, split = [""], set()
        while tree and (not sizes.leaves or len(leaves) < sizes.leaves):
            name = max((x for x in leaves if tree[x][1] > 1e-6), key=lambda x: tree[x][1], default=None)  # noqa: B023
            if name is None:
                break
            split.add(name)
            leaves.remove(name)
            leaves += [name + "l", name + "r"]
        for name in leaves:
            rows = tree[name][0]
            margin[rows] += -g[rows].sum() / (h[rows].sum() + sizes.l2) * sizes.rate
    return margin


@pytest.mark.parametrize("sizes", [
    boosting.Boosted(rounds=6, depth=3, rate=0.3),
    boosting.Boosted(rounds=4, depth=4, rate=0.3, l2=0.0, least_hessian=1e-3, least_rows=20, leaves=6)])
def test_boosting_equals_a_slow_booster(spark, split, tmp_path, sizes):
    some = split.where("NOT is_test").orderBy(K.ID_COLUMN).limit(500)
    encoder = fit_encoder(some)
    B.pack(some, encoder).write.parquet(str(tmp_path / "blocks"))
    table = spark.read.parquet(str(tmp_path / "blocks"))
    found = boosting.Booster(spark, table, encoder, [boosting.Job("x", f, sizes) for f in (B.WHOLE, 2)], str(tmp_path / "run"), 1).train()
    for fit, trees in zip((B.WHOLE, 2), found):
        own = [(b, b.used(fit)) for b in local(table, encoder)]
        codes, y = np.concatenate([b.rows.codes()[u] for b, u in own]), np.concatenate([b.y[u] for b, u in own]).astype(float)
        margins = np.concatenate([trees.margin(b.rows.take(u)) for b, u in own])
        assert margins == pytest.approx(slow_booster(codes, y, sizes, 3), abs=1e-9)


def test_boosting_goes_on_where_it_was_stopped(spark, training, tmp_path, monkeypatch):
    table, encoder = training.blocks(True), training.encoder()
    jobs = [boosting.Job("x", f, boosting.Boosted(rounds=12, depth=2)) for f in (0, B.WHOLE)]
    whole = boosting.Booster(spark, table, encoder, jobs, str(tmp_path / "a"), 1).train()
    rounds, plain = [], boosting.Booster._round

    def stopped(self, state, since, round_):
        rounds.append(round_)
        if round_ == 8 and len(rounds) < 10:
            raise RuntimeError("killed")
        return plain(self, state, since, round_)

    monkeypatch.setattr(boosting.Booster, "_round", stopped)
    with pytest.raises(RuntimeError, match="killed"):
        boosting.Booster(spark, table, encoder, jobs, str(tmp_path / "b"), 1).train()
    again = boosting.Booster(spark, table, encoder, jobs, str(tmp_path / "b"), 1).train()
    assert rounds[9:] == list(range(boosting.REFRESH, 12))
    for a, b in zip(whole, again):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value, abs=1e-9)


def test_many_tasks_are_added_in_two_steps(spark, training, tmp_path, monkeypatch):
    table, encoder = training.blocks(True), training.encoder()
    jobs = [boosting.Job("x", B.WHOLE, boosting.Boosted(rounds=2, depth=2))]
    one = boosting.Booster(spark, table, encoder, jobs, str(tmp_path / "a"), 1).train()[0]
    monkeypatch.setattr(boosting, "DIRECT_TASKS", 1)
    two = boosting.Booster(spark, table, encoder, jobs, str(tmp_path / "b"), 1).train()[0]
    assert (one.feature == two.feature).all() and one.value == pytest.approx(two.value, abs=1e-9)


def test_row_sampling_is_drawn_anew_each_round(spark, training, tmp_path):
    table, encoder = training.blocks(False), training.encoder()
    trees = boosting.Booster(spark, table, encoder, [boosting.Job("x", B.WHOLE, boosting.Boosted(rounds=3, depth=2, sampling=0.5))], str(tmp_path), 1).train()[0]
    n, roots = sum(len(b.y) for b in local(table, encoder)), trees.cover[trees.roots]
    assert len(set(roots.tolist())) > 1 and all(0.4 * n < c < 0.6 * n for c in roots)


# --- forests and linear models -----------------------------------------------------------------

def test_forest_grows_to_pure_leaves_and_splits_by_gini(training):
    codes, _, y = rows_of(training, B.WHOLE)
    weight = np.ones(len(y))
    feature, cut, left, value, cover = forest.grow(codes, y, 3, np.random.default_rng(1), weight)
    node = np.zeros(len(y), int)
    while (feature[node] >= 0).any():
        inner = feature[node] >= 0
        node[inner] = left[node[inner]] + (codes[inner, feature[node[inner]]] > cut[node[inner]])
    for leaf in np.unique(node):
        rows = codes[node == leaf]
        assert value[leaf] in (0.0, 1.0) or (rows == rows[0]).all()
        assert cover[leaf] == (node == leaf).sum() and value[leaf] == pytest.approx(y[node == leaf].mean())
    # with all slots tried, the root has the best cut
    best = max(((sum((s.sum() ** 2 + (len(s) - s.sum()) ** 2) / len(s) for s in (y[on], y[~on])), slot, k) for slot in range(codes.shape[1])
                for k in range(NUMERIC_BINS) if 0 < (on := codes[:, slot] <= k).sum() < len(y)), key=lambda x: x[0])
    gain = np.full(1, -1.0), np.full(1, -1), np.zeros(1, np.int64)
    forest._try(codes, np.arange(len(y)), np.zeros(len(y), int), weight, y, np.arange(codes.shape[1])[None], np.ones(1, bool), np.array([float(len(y))]), np.array([y.sum()]), 3, *gain)
    assert gain[0][0] == pytest.approx(best[0] - (y.sum() ** 2 + (len(y) - y.sum()) ** 2) / len(y))


def test_forest_cuts_of_many_small_nodes_take_no_room_for_bins_that_do_not_occur():
    import tracemalloc

    r = np.random.default_rng(4)
    nodes, rows, numeric, slots = 6000, 4, 3, 5
    node = np.repeat(np.arange(nodes), rows)
    codes = np.concatenate([r.integers(0, NUMERIC_BINS, (len(node), numeric)), r.integers(0, LEVEL_BINS, (len(node), slots - numeric))], axis=1).astype(np.uint8)
    y, w = r.integers(0, 2, len(node)).astype(float), r.integers(1, 4, len(node)).astype(float)
    total, pos = np.bincount(node, w), np.bincount(node, w * y)
    some = np.argsort(r.random((nodes, slots)), axis=1)[:, :4]
    gain, slot, cut = np.full(nodes, -1.0), np.full(nodes, -1), np.zeros(nodes, np.int64)
    tracemalloc.start()
    forest._try(codes, np.arange(len(node)), node, w, w * y, some, (pos > 0) & (pos < total), total, pos, numeric, gain, slot, cut)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    score = lambda a, b: (b**2 + (a - b) ** 2) / a
    for k in range(0, nodes, 37):
        own = node == k
        best = -1.0
        if 0 < pos[k] < total[k]:
            for s in some[k]:
                for c in range(NUMERIC_BINS):
                    on = own & (codes[:, s] <= c)
                    if 0 < w[on].sum() < total[k]:
                        best = max(best, score(w[on].sum(), (w * y)[on].sum()) + score(total[k] - w[on].sum(), pos[k] - (w * y)[on].sum()) - score(total[k], pos[k]))
        assert gain[k] == pytest.approx(best)


def test_forest_does_not_depend_on_partitions_and_bounds_its_bags(spark, training, monkeypatch):
    encoder, table = training.encoder(), training.blocks(True)
    trees = [sorted(map(tuple, forest.train(t, encoder, [0, 5], 4, 1).collect())) for t in (table, table.repartition(5))]
    assert trees[0] == trees[1] and len(trees[0]) == 8
    monkeypatch.setattr(forest, "BAG_ROWS", 200)
    small = forest.train(table, encoder, [5], 4, 1).collect()
    assert all(np.frombuffer(r["cover"], "<f8")[0] < 400 for r in small)


def test_newton_reaches_the_optimum(training):
    encoder, table = training.encoder(), training.blocks(True)
    for fit, model in zip((1, B.WHOLE), linear.train(table, encoder, [1, B.WHOLE], 10.0, 100)):
        own = [(b, b.used(fit)) for b in local(table, encoder)]
        x, y = np.concatenate([Rows(model.encoder, (r := b.rows.take(u)).num, r.level, r.other, r.gap).values() for b, u in own]), np.concatenate([b.y[u] for b, u in own])
        p = 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))
        assert np.abs(np.r_[x.T @ (p - y) + model.weights / 10.0, (p - y).sum()]).max() < 1e-6 * len(y)
        assert model.center == pytest.approx(x.mean(axis=0))
        given = np.concatenate([b.rows.num[b.used(fit)] for b, _ in own if b.fit[0] == B.EVERY])
        assert model.encoder.means == pytest.approx(given.mean(axis=0)) and model.encoder.scales == pytest.approx(given.std(axis=0))


# --- over-sampling -----------------------------------------------------------------------------

@pytest.mark.parametrize("pivots,opened,block", [(0, 8, 2048), (40, 2, 2048), (3, 1, 50)])
def test_neighbours_equal_all_pairs(spark, training, tmp_path, monkeypatch, pivots, opened, block):
    monkeypatch.setattr(smote, "BLOCK", block)
    encoder, table = training.encoder(), training.blocks(False)
    scaled = {f: encoder.scaled_by(m, s) for f, (m, s, _) in zip((0, 5), linear.moments(table, encoder, [0, 5]))}
    rows = smote.distinct_rows(table, encoder, {0: 1, 5: 1})
    copied = rows.withColumn("copies", F.when(F.pmod(F.xxhash64("row"), F.lit(10)) == 0, 4).otherwise(F.col("copies")).cast("long"))
    found = smote.neighbours(copied, encoder, scaled, str(tmp_path / "n"), pivots=pivots, opened=opened).collect()
    assert len(found) == copied.count() and {r["fit"] for r in found} == {0, 5}
    for fit in (0, 5):
        own = sorted((r for r in found if r["fit"] == fit), key=lambda r: r["row"])
        at = smote.unpack(encoder, [bytes(r["row"]) for r in own])
        at.encoder = scaled[fit]
        x = at.values()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for i, r in enumerate(own):
            left, want = smote.K_NEAR, []
            for j in np.lexsort((np.arange(len(own)), np.round(d[i], 9))):
                n = own[j]["copies"] - (i == j)
                if left > 0 and n > 0:
                    want.append((d[i, j], n))
                    left -= n
            assert [o["distance"] for o in r["near"]] == pytest.approx([v for v, _ in want], abs=1e-6)


def test_made_rows_level_the_classes_of_each_fit_and_use_no_other_fold(training):
    encoder = training.encoder()
    training.blocks(True)
    given, made = local(training.blocks(False), encoder), local(training.spark.read.schema(B.BLOCKS).parquet(f"{training.folder}/made"), encoder)
    for fit in range(K.CV_FOLDS + 1):
        n = sum(np.bincount(b.y[b.used(fit)], minlength=2) for b in given + made)
        assert n[0] == n[1]
        parents = {(tuple(a), tuple(v)) for b in given for a, v, on, y in zip(b.rows.num, b.rows.level, b.used(fit), b.y) if on and y == 1}
        levels = {v for _, v in parents}
        for b in (b for b in made if b.fit[0] == fit):
            assert (b.fit == fit).all() and (b.y == 1).all() and ((b.rows.gap >= 0) & (b.rows.gap < 1)).all()
            assert all(tuple(a) in levels and tuple(o) in levels for a, o in zip(b.rows.level, b.rows.other))


def test_made_rows_lie_between_their_parents():
    from churnkit.ml.features import Encoder

    e = Encoder(("x",), {"c": ("a", "b", "d")}, ((1.0, 2.0),), (0.0,), (1.0,))
    rows = Rows(e, np.array([[1.5], [0.5]]), np.array([[0], [2]], np.int16), np.array([[1], [2]], np.int16), np.array([0.25, 0.5]))
    assert rows.values().tolist() == [[1.5, 0.75, 0.25, 0.0], [0.5, 0.0, 0.0, 1.0]]
    assert rows.codes().tolist() == [[1, 4, 2, 0], [0, 0, 0, LEVEL_BINS - 1]]


def test_scoring_never_oversamples(training, split):
    from churnkit.ml.score import ModelScorer

    training.ensure(["XGBoost"], [B.WHOLE])
    assert ModelScorer(training.model("XGBoost")).transform(split).count() == split.count()


# --- calibration -------------------------------------------------------------------------------

def scored(spark, n=3000, ties=True):
    r = np.random.default_rng(3)
    p = np.round(r.random(n), 2 if ties else 6)
    return spark.createDataFrame([(int(f), float(a), int(y)) for f, a, y in zip(r.integers(0, 2, n), p, r.random(n) < p**2)], "fold int, p double, y int")


@pytest.mark.parametrize("ties", [True, False])
def test_isotonic_equals_sparks(spark, ties):
    from pyspark.ml.regression import IsotonicRegression

    held = scored(spark, ties=ties)
    found = calibrate.fit_isotonic(held.repartition(6))
    for fold in (0, 1):
        own = held.where(F.col("fold") == fold)
        model = IsotonicRegression(featuresCol="p", labelCol="y", isotonic=True).fit(own)
        at = spark.createDataFrame([(k / 997,) for k in range(-20, 1100)], "p double")
        want = [r["prediction"] for r in model.transform(at).collect()]
        assert found[fold].apply(np.array([r["p"] for r in at.collect()])) == pytest.approx(want, abs=1e-9)
        assert json.loads(json.dumps(found[fold].to_dict())) == calibrate.calibrator(found[fold].to_dict()).to_dict()


def test_pooling_in_parts_changes_nothing():
    r = np.random.default_rng(5)
    x, y = np.sort(r.random(400)), (r.random(400) < 0.4).astype(float)
    whole = calibrate.pooled(x, x, np.ones(400), y)
    parts = [b for k in range(0, 400, 37) for b in calibrate.pooled(x[k:k + 37], x[k:k + 37], np.ones(len(x[k:k + 37])), y[k:k + 37])]
    a = np.array(parts)
    assert calibrate.pooled(*a.T) == whole


def test_sigmoid_is_at_its_least(spark):
    for fold, s in calibrate.fit_sigmoid(scored(spark).withColumnRenamed("p", "f"), False).items():
        own = [(r["p"], r["y"]) for r in scored(spark).where(F.col("fold") == fold).collect()]
        f, y = np.array(own).T
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        p = s.apply(f)
        assert abs(((p - t) * f).sum()) < 1e-6 and abs((p - t).sum()) < 1e-6


# --- the ledger and the whole training -----------------------------------------------------------

def test_a_run_that_is_killed_fits_only_what_is_missing(spark, split, tmp_path, monkeypatch):
    run = Training(spark, split, str(tmp_path), {"XGBoost": SMALL["XGBoost"]}, oversample=False)
    trained, plain, commit = [], boosting.Booster.train, Ledger.commit

    def watched(self):
        trained.append([j.fit for j in self.jobs])
        return plain(self)

    def killed(self, name, fit, model, params):
        if fit == 3 and len(trained) == 1:
            raise RuntimeError("killed")
        commit(self, name, fit, model, params)

    monkeypatch.setattr(boosting.Booster, "train", watched)
    monkeypatch.setattr(Ledger, "commit", killed)
    with pytest.raises(RuntimeError, match="killed"):
        run.ensure(["XGBoost"], [0, 1, 2, 3, 4])
    assert [run.ledger.has("XGBoost", f) for f in range(5)] == [True, True, True, False, False]
    Training(spark, split, str(tmp_path), {"XGBoost": SMALL["XGBoost"]}, oversample=False).ensure(["XGBoost"], [0, 1, 2, 3, 4])
    assert trained == [[0, 1, 2, 3, 4], [3, 4]]
    run.ensure(["XGBoost"], [0, 1, 2, 3, 4])
    assert len(trained) == 2


def test_runs_are_their_latest_events(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.event("a", "fitted", {"x": 1}, {"auc": 0.5, "flag": True, "name": "n"})
    ledger.event("b", "fitted")
    ledger.event("a", "selected", metrics={"auc": 0.7})
    assert {(r["run_name"], r["event"]): r["metrics"].get("auc") for r in ledger.runs().collect()} == {("a", "selected"): 0.7, ("b", "fitted"): None}
    first = ledger.events().where("run_name = 'a' AND event = 'fitted'").first()
    assert first["metrics"] == {"auc": 0.5} and first["params"] == {"x": "1"}
    with pytest.raises(FileNotFoundError, match="training job"):
        ledger.load("a", 0)


def test_candidates_are_scored_by_models_that_have_not_seen_the_row(spark, training):
    rows = training.evaluate(list(SMALL))
    assert [r["name"] for r in rows] == list(SMALL) and all(0.5 < r["test_auc"] < 0.95 and r["cv_auc_std"] < 0.1 for r in rows)
    scored = training.scores(list(SMALL))
    some = training.split.orderBy(K.ID_COLUMN).limit(40).collect()
    by = {(r[K.ID_COLUMN], r["name"]): r for r in scored.collect()}
    assert len(by) == training.split.count() * 3
    for r in some:
        encoder = training.encoder()
        import pyarrow as pa

        rows_ = encoder.read({c: pa.array([r[c]]) for c in encoder.columns})
        for name in SMALL:
            fit = B.WHOLE if r["is_test"] else r["fold"]
            assert by[r[K.ID_COLUMN], name]["p"] == pytest.approx(float(training.model(name, fit).probability(rows_)[0]))
            assert by[r[K.ID_COLUMN], name]["fold"] == r["fold"]


def test_models_come_back_as_they_were_written(spark, training, tmp_path):
    training.ensure(list(SMALL), [B.WHOLE])
    for name in SMALL:
        model = training.model(name)
        ensemble.save(spark, model, str(tmp_path / name))
        back = ensemble.load(spark, str(tmp_path / name))
        for block in local(training.blocks(False), training.encoder()):
            assert (back.probability(block.rows) == model.probability(block.rows)).all()


def test_a_copied_label_is_refused(spark, split, tmp_path):
    leaked = split.withColumn("MonthlyCharges", F.col("Churn") * 1.0 + 20)
    with pytest.raises(ValueError, match="too good"):
        Training(spark, leaked, str(tmp_path), {"LogisticRegression": SMALL["LogisticRegression"]}, oversample=False).evaluate(["LogisticRegression"])


def test_class_weights_raise_recall(spark, split, tmp_path):
    from churnkit.ml.score import ModelScorer

    found = []
    for weight in (1.0, 3.0):
        table = Training(spark, split, str(tmp_path / str(weight)), SMALL, oversample=False)
        sizes = boosted_sizes(SMALL["XGBoost"], weight)
        model = boosting.Booster(spark, table.blocks(False), table.encoder(), [boosting.Job("x", B.WHOLE, sizes)], str(tmp_path / f"b{weight}"), 1).train()[0]
        found.append(ModelScorer(model).transform(split).where("Churn = 1 AND p >= 0.5").count())
    assert found[1] > found[0]


# --- splits --------------------------------------------------------------------------------------

def test_hash_cuts_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(int(c), int(h)) for c, h in zip(r.integers(0, 2, 2000), r.integers(0, 2**63, 2000, dtype=np.int64))] + [(0, 5)] * 7
    ranks = {0: [0, 1, 300, 400], 1: [0, 17, 10**6]}
    for c, own in hash_cuts(spark.createDataFrame(rows, "c int, h long"), "c", "h", ranks).items():
        h = np.array([x for k, x in rows if k == c])
        for rank, cut in zip(ranks[c], own):
            tied = 7 if c == 0 and 0 < rank <= 7 else min(rank, len(h))
            assert (h <= cut).sum() == tied


def test_the_split_reads_its_input_as_it_is(split, spark):
    from tests.helpers import executed

    plan = executed(split_assign(spark.read.parquet(split.inputFiles()[0].rsplit("/", 1)[0]).drop("is_test", "fold")))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


# --- leases and fingerprints -----------------------------------------------------------------------

def test_one_holder_at_a_time(spark, tmp_path, monkeypatch):
    path, inside, order = str(tmp_path / "lease"), [0], []

    def work(k):
        with artifacts.lease(spark, path), artifacts.lease(spark, path):
            inside[0] += 1
            assert inside[0] == 1
            time.sleep(0.1)
            order.append(k)
            inside[0] -= 1

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(order) == [0, 1, 2, 3] and not artifacts.path_exists(spark, path)
    # a holder that died leaves its file behind
    monkeypatch.setattr(artifacts, "LEASE_STALE", 1.0)
    (tmp_path / "lease").write_bytes(b"")
    begun = time.monotonic()
    work(9)
    assert 1.0 <= time.monotonic() - begun < 10


def test_fingerprints_follow_rows_and_schema_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    own = artifacts.fingerprint(df)
    assert own == artifacts.fingerprint(df.orderBy(F.desc("x")).repartition(3))
    others = [df.limit(2), df.withColumnRenamed("y", "z"), df.withColumn("x", F.col("x").cast("long")), df.withColumn("y", F.upper("y"))]
    assert len({own, *map(artifacts.fingerprint, others)}) == 5


def test_stale_models_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    artifacts.check_fresh({"model_name": "m", "feature_columns": ["x"], "data_fingerprint": "f"}, df, "f")
    with pytest.raises(ValueError, match="gone"):
        artifacts.check_fresh({"model_name": "m", "feature_columns": ["x", "w"], "data_fingerprint": "f"}, df, "f")
    with pytest.raises(ValueError, match="other data"):
        artifacts.check_fresh({"model_name": "m", "feature_columns": ["x"], "data_fingerprint": "f"}, df, "g")


def test_a_file_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "f.json")
    artifacts.write_bytes(spark, path, b"one")
    artifacts.write_bytes(spark, path, b"\x00two\xff")
    assert artifacts.read_bytes(spark, path) == b"\x00two\xff"
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]


def test_replaced_data_get_artifacts_of_their_own(spark, tmp_path):
    from churnkit.ml import workflow

    for t in ("orders", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    first = workflow.run_dir(spark, str(tmp_path))
    assert workflow.run_dir(spark, str(tmp_path)) == first
    fewer = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 3 != 0")
    fewer.write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert workflow.run_dir(spark, str(tmp_path)) != first


# --- work that grows with the rows -------------------------------------------------------------

def test_the_neighbour_search_writes_no_row_for_each_pair_of_row_and_cell(spark, training, tmp_path):
    encoder, table = training.encoder(), training.blocks(False)
    scaled = {5: encoder.scaled_by(*linear.moments(table, encoder, [5])[0][:2])}
    rows = smote.distinct_rows(table, encoder, {5: 1})
    n = smote.neighbours(rows, encoder, scaled, str(tmp_path / "n"), pivots=20, opened=2).count()
    assert n > 100
    assert all(spark.read.parquet(str(p)).count() <= n for p in (tmp_path / "n").iterdir())


def test_margins_take_each_tree_once(spark, training, tmp_path, monkeypatch):
    level, seen = boosting.Booster._level, []

    def watched(self, state, since, *rest):
        seen.append([len(own) for own in since])
        return level(self, state, since, *rest)

    monkeypatch.setattr(boosting.Booster, "_level", watched)
    boosting.Booster(spark, training.blocks(False), training.encoder(), [boosting.Job("x", B.WHOLE, boosting.Boosted(rounds=4, depth=2))], str(tmp_path), 1).train()
    assert seen and all(own == [0] for own in seen)


@pytest.mark.parametrize("nodes", [31, 601])
def test_rows_stop_where_following_them_ends(nodes):
    r = np.random.default_rng(nodes)
    feature, cut, left = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes, np.int32)
    leaves, free = [0], 1
    while free < nodes:
        node = leaves.pop(int(r.integers(len(leaves))))
        feature[node], cut[node], left[node] = r.integers(5), r.integers(6), free
        leaves += [free, free + 1]
        free += 2
    codes = r.integers(0, 7, (5, 300)).astype(np.uint8)
    want = np.zeros(300, np.int64)
    for i in range(300):
        while feature[want[i]] >= 0:
            want[i] = left[want[i]] + (codes[feature[want[i]], i] > cut[want[i]])
    assert (boosting.reached(codes, feature, cut, left, np.arange(nodes)) == want).all()


def test_forest_compares_slots_of_few_rows_together(monkeypatch):
    r = np.random.default_rng(4)
    codes = np.c_[r.integers(0, NUMERIC_BINS, (1500, 2)), r.integers(0, LEVEL_BINS, (1500, 1)), r.integers(0, 2, (1500, 33)) * (LEVEL_BINS - 1)].astype(np.uint8)
    y, calls, plain = (r.random(1500) < 0.4).astype(float), [], forest._purity
    monkeypatch.setattr(forest, "_purity", lambda *a: calls.append(len(a[0])) or plain(*a))
    trees, passes = [], []
    for together in (1, 500, forest.TOGETHER):
        monkeypatch.setattr(forest, "TOGETHER", together)
        calls.clear()
        trees.append(forest.grow(codes, y, 2, np.random.default_rng(2)))
        passes.append(len(calls))
    for other in trees[1:]:
        assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(trees[0], other, strict=True))
    assert passes[2] < passes[1] < passes[0] and passes[2] < passes[0] / 4


def test_every_group_of_trees_has_a_task_of_its_own(spark, training):
    fits = list(range(6))
    found = forest.train(training.blocks(True), training.encoder(), fits, forest.GROUP_TREES + 1, 1).select("fit", "tree", F.spark_partition_id().alias("task")).collect()
    groups = {(r["fit"], r["tree"] // forest.GROUP_TREES): r["task"] for r in found}
    assert len(found) == len(fits) * (forest.GROUP_TREES + 1) and len(set(groups.values())) == len(groups) == 2 * len(fits)


def test_few_blocks_are_dealt_out_evenly(spark, training, tmp_path):
    given, slots = training.blocks(False).coalesce(1), spark.sparkContext.defaultParallelism
    table = given.crossJoin(F.broadcast(spark.range(10 * slots))).drop("id")
    for _ in range(slots - 1):
        table = table.union(given)
    booster = boosting.Booster(spark, table, training.encoder(), [boosting.Job("x", B.WHOLE, boosting.Boosted())], str(tmp_path), 1)
    booster.tasks = table.rdd.getNumPartitions()
    booster._begun(np.zeros(1)).unpersist()
    dealt = [r["count"] for r in spark.read.parquet(f"{tmp_path}/margins-0").groupBy(F.input_file_name()).count().collect()]
    n = given.count()
    assert sum(dealt) == n * (11 * slots - 1) and max(dealt) <= n * (10 + slots)


def test_forest_learns_from_all_rows_of_its_fit(spark, training):
    encoder, given = training.encoder(), training.blocks(False)
    n = sum(int(b.used(0).sum()) for b in local(given, encoder))
    table = given.crossJoin(F.broadcast(spark.range(230_000 // n))).drop("id")
    roots = [np.frombuffer(r["cover"], "<f8")[0] for r in forest.train(table, encoder, [0], 2, 1).collect()]
    assert roots == [n * (230_000 // n)] * 2  # every tree draws as many rows as there are, and n is over 200,000


def test_forest_of_a_fit_that_no_task_can_hold(spark, training, tmp_path, monkeypatch):
    encoder, table = training.encoder(), training.blocks(True)
    codes, _, y = rows_of(training, 5)
    monkeypatch.setattr(forest, "TASK_ROWS", 150)
    monkeypatch.setattr(forest, "GROUP_TREES", 2)
    found = [sorted(map(tuple, forest.train(t, encoder, [5], 4, 1).collect())) for t in (table, table.repartition(5))]
    assert found[0] == found[1]
    pieces = [r for r in found[0] if r[7]]
    assert len(pieces) > 40 and max(np.frombuffer(r[6], "<f8")[0] for r in pieces) <= 150 and {r[1] for r in found[0] if not r[7]} == set(range(4))
    trees = ensemble.joined_trees(encoder, False, 0.0, [r[1:] for r in found[0]])
    # children share out their parent's rows, leaves are pure or of equal rows, and all rows are drawn about once
    inner = np.flatnonzero(trees.feature >= 0)
    assert np.allclose(trees.cover[inner], trees.cover[trees.left[inner]] + trees.cover[trees.left[inner] + 1]) and len(trees.roots) == 4
    assert abs(trees.cover[trees.roots].mean() / len(y) - 1) < 0.06
    leaves = trees.leaves(codes)
    for leaf in np.unique(leaves[:, 0]):
        rows = codes[leaves[:, 0] == leaf]
        assert trees.cover[leaf] > 0 and (trees.value[leaf] in (0.0, 1.0) or len(np.unique(rows, axis=0)) < len(rows) + (len(rows) == 1))
    p = trees.value[leaves].mean(axis=1)
    assert (p[y == 1][:, None] > p[y == 0][None, :]).mean() > 0.9
    # in slices it says the same, and the leaves of every node count once
    monkeypatch.undo()
    monkeypatch.setattr(ensemble, "MODEL_NODES", 200)
    rows = [tuple(r) for r in found[0]]
    spark.createDataFrame(rows, forest.TREES).write.parquet(f"{tmp_path}/trees")
    ensemble.describe(spark, encoder, f"{tmp_path}/model", boosted=False, base=0.0, table=f"{tmp_path}/trees", fit=5)
    parts = list(ensemble.slices(spark, f"{tmp_path}/model"))
    assert len(parts) > 10 and {n for _, n in parts} == {4}
    assert np.allclose(sum(t.value[t.leaves(codes)].sum(axis=1) for t, _ in parts) / 4, p, atol=1e-12)
    back = ensemble.load(spark, f"{tmp_path}/model")
    assert np.allclose(back.value[back.leaves(codes)].mean(axis=1), p, atol=1e-12)


def test_forest_scores_do_not_depend_on_slices(spark, training, tmp_path, monkeypatch):
    from churnkit.ml.score import ModelScorer, write_forest_scores

    training.ensure(["RandomForest"])
    rows = training.split.withColumn("y", F.col(K.TARGET_COLUMN).cast("int"))
    want = {r[0]: r[1] for r in ModelScorer(training.model("RandomForest", 0)).transform(rows).select(K.ID_COLUMN, "p").collect()}
    monkeypatch.setattr(ensemble, "MODEL_NODES", 1000)
    assert len(list(ensemble.slices(spark, training.ledger.path("RandomForest", 0)))) > 2
    write_forest_scores(rows, f"{tmp_path}/scores", training.ledger.path("RandomForest", 0), "x", [K.ID_COLUMN, "y", "fold"])
    found = spark.read.parquet(f"{tmp_path}/scores").collect()
    assert len(found) == len(want) and all(abs(r["p"] - want[r[K.ID_COLUMN]]) < 1e-12 and r["name"] == "x" for r in found)
    assert [p.name for p in tmp_path.iterdir()] == ["scores"]
