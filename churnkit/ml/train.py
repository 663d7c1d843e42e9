"""Candidate models, cross-validated evaluation, comparison and selection.

Every candidate is fitted six times, without each fold and on all training rows.  Fits of one kind are trained together: a
pass over the blocks serves all of them.  The fold fits give the CV AUCs, the out-of-fold probabilities and, later, the base models
of the calibrators.  One pass scores all rows with all candidates, and one measures all folds and candidates.
"""

from __future__ import annotations

import logging
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.ml import blocks as B
from churnkit.ml import boosting, ensemble, forest, linear, smote
from churnkit.ml.ensemble import Model
from churnkit.ml.features import Encoder, fit_encoder
from churnkit.ml.ledger import Ledger
from churnkit.ml.score import candidate_scores, write_forest_scores
from churnkit.operators import metrics
from churnkit.sources.artifacts import path_exists, write_bytes

logger = logging.getLogger(__name__)

# Hyper-parameters of the original comparison (fixed values).  ``inverse_ridge`` is its C; the regularisation of
# the two boosters are the defaults of the libraries that the original names.
REFERENCE_PROFILE = {
    "LogisticRegression": {"kind": "linear", "inverse_ridge": 10.0, "steps": 2000},
    "RandomForest": {"kind": "forest", "trees": 300},
    "XGBoost": {"kind": "boosted", "rounds": 200, "depth": 4, "rate": 0.03, "l2": 1.0, "least_hessian": 1.0},
    "LightGBM": {"kind": "boosted", "rounds": 200, "depth": 4, "rate": 0.03, "l2": 0.0, "least_hessian": 1e-3, "least_rows": 20, "leaves": 31},
}
# The original's throwaway driver model (M10), weighted n_neg / n_pos instead of over-sampled.
DIAGNOSTIC = "Diagnostic"
DIAGNOSTIC_PARAMS = {"kind": "boosted", "rounds": 200, "depth": 4, "rate": 0.1, "l2": 1.0, "least_hessian": 1.0}
FITS = list(range(K.CV_FOLDS + 1))


def boosted_sizes(params: dict, positive_weight: float = 1.0) -> boosting.Boosted:
    return boosting.Boosted(**{k: v for k, v in params.items() if k != "kind"}, positive_weight=positive_weight)


class Training:
    """Fits candidates on a split table; everything it writes lies under ``folder``.  ``oversample`` adds rows of the rarer class inside
    each fit's training rows (M4)."""

    def __init__(self, spark: SparkSession, split: DataFrame, folder: str, profile: dict | None = None, oversample: bool = True, seed: int = K.RANDOM_STATE) -> None:
        self.spark, self.split, self.folder, self.seed, self.oversample = spark, split, folder, seed, oversample
        self.profile = profile or REFERENCE_PROFILE
        self.ledger = Ledger(spark, folder)
        self.train = split.where(~F.col("is_test"))

    def encoder(self) -> Encoder:
        known = self.ledger.noted("encoder")
        if known is None:
            self.ledger.note("encoder", {"encoder": fit_encoder(self.train).to_json()})
            known = self.ledger.noted("encoder")
        return Encoder.from_json(known["encoder"])

    def blocks(self, oversampled: bool) -> DataFrame:
        """Training rows as blocks, written once; with the made rows of every fit if asked for."""
        given = self._written("blocks", lambda: B.pack(self.train, self.encoder()))
        if not oversampled:
            return given
        made = self._written("made", lambda: smote.oversampled(given, self.encoder(), FITS, f"{self.folder}/neighbours", self.seed))
        return given.unionByName(made)

    def _written(self, name: str, make) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.schema(B.BLOCKS).parquet(path)

    def params(self, name: str) -> dict:
        return DIAGNOSTIC_PARAMS if name == DIAGNOSTIC else self.profile[name]

    def positive_weight(self) -> float:
        """n_neg / n_pos of the training rows."""
        n = {r[K.TARGET_COLUMN]: r["count"] for r in self.train.groupBy(K.TARGET_COLUMN).count().collect()}
        return n.get(0, 0) / max(n.get(1, 0), 1) or 1.0

    def ensure(self, names: list[str], fits: list[int] = FITS) -> None:
        """Train and commit the fits that are missing, those of a kind together."""
        todo = self.ledger.missing([(n, f) for n in names for f in fits])
        if not todo:
            return
        encoder = self.encoder()
        for weighted in (False, True):
            own = [(n, f) for n, f in todo if (n == DIAGNOSTIC) == weighted]
            if not own:
                continue
            table = self.blocks(self.oversample and not weighted)
            weight = self.positive_weight() if weighted or not self.oversample else 1.0
            jobs = [boosting.Job(n, f, boosted_sizes(self.params(n), weight)) for n, f in own if self.params(n)["kind"] == "boosted"]
            # boosting is a long row of short jobs; the other kinds fill the slots it leaves
            work = [lambda jobs=jobs, table=table: self._boosted(jobs, table, encoder)] if jobs else []
            for name in dict.fromkeys(n for n, _ in own):
                its = [f for n, f in own if n == name]
                kind = self.params(name)["kind"]
                if kind in ("linear", "forest"):
                    step = self._linear if kind == "linear" else self._forest
                    work.append(lambda step=step, name=name, its=its, table=table, weight=weight: step(name, its, table, encoder, weight))
            with ThreadPoolExecutor(max_workers=max(len(work), 1)) as pool:
                for done in [pool.submit(w) for w in work]:
                    done.result()

    def _boosted(self, jobs: list[boosting.Job], table: DataFrame, encoder: Encoder) -> None:
        folder = f"{self.folder}/boosting/{boosting.jobs_key(jobs)}"
        for job, m in zip(jobs, boosting.Booster(self.spark, table, encoder, jobs, folder, self.seed).train(), strict=True):
            self.commit(job.name, job.fit, m)

    def _linear(self, name: str, fits: list[int], table: DataFrame, encoder: Encoder, weight: float) -> None:
        p = self.params(name)
        for f, m in zip(fits, linear.train(table, encoder, fits, p["inverse_ridge"], p["steps"], weight), strict=True):
            self.commit(name, f, m)

    def _forest(self, name: str, fits: list[int], table: DataFrame, encoder: Encoder, weight: float) -> None:
        path = f"{self.folder}/forest/{name}-{'-'.join(map(str, fits))}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            for k, job in enumerate(forest.jobs(table, encoder, fits, self.params(name)["trees"], self.seed)):
                if not path_exists(self.spark, f"{path}/job={k}/_SUCCESS"):
                    job().write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/job={k}")
            write_bytes(self.spark, f"{path}/_SUCCESS", b"")
        for f in fits:  # a forest stays in the table its tasks wrote; the driver does not see it
            ensemble.describe(self.spark, encoder, self.ledger.path(name, f), boosted=False, base=0.0, table=path, fit=f)
            self.ledger.event(name, "fitted", self.params(name), {}, {"fit": str(f)})

    def commit(self, name: str, fit: int, model: Model) -> None:
        self.ledger.commit(name, fit, model, self.params(name))

    def model(self, name: str, fit: int = B.WHOLE) -> Model:
        return self.ledger.load(name, fit)

    def scores(self, names: list[str]) -> DataFrame:
        """``(customerID, y, fold, name, p)`` for every row of the split: training rows by the model that has not seen their fold, test rows
        by that of all training rows.  One pass serves all small models; forests follow one fit at a time, in slices.  Every part is written once."""
        rows = self.split.withColumn("y", F.col(K.TARGET_COLUMN).cast("int"))
        small = [n for n in names if self.params(n)["kind"] != "forest"]
        self.ensure(names)
        parts = []
        if small:
            path = f"{self.folder}/scores/{'-'.join(sorted(small))}"
            if not path_exists(self.spark, f"{path}/_SUCCESS"):
                models = {n: [self.model(n, f) for f in FITS] for n in small}
                candidate_scores(rows, models, [K.ID_COLUMN, "y"]).write.mode("overwrite").parquet(path)
            parts.append(path)
        for n in (n for n in names if n not in small):
            for f in FITS:  # one forest at a time, each over its own rows
                path = f"{self.folder}/scores/{n}-{f}"
                if not path_exists(self.spark, f"{path}/_SUCCESS"):
                    own = rows.where(F.col("is_test") if f == B.WHOLE else F.col("fold") == f)
                    write_forest_scores(own, path, self.ledger.path(n, f), n, [K.ID_COLUMN, "y", "fold"])
                parts.append(path)
        return self.spark.read.parquet(*parts)

    def evaluate(self, names: list[str]) -> list[dict]:
        """M6 for all candidates: CV AUC mean / population std, out-of-fold tuned threshold, test metrics at 0.5 and at the tuned
        threshold, leakage guard on both AUCs."""
        return comparison_rows(self.scores(names), names)


def comparison_rows(scored: DataFrame, names: list[str], guard: bool = True) -> list[dict]:
    """The comparison of candidates from their scores ``(name, fold, y, p)``; rows without a fold are test rows."""
    by = ["name", "part"]
    parts = scored.withColumn("part", F.coalesce(F.col("fold").cast("string"), F.lit("test")))

    def at_tuned() -> tuple[dict, dict]:
        tuned = {r["name"]: r["tuned_threshold"] for r in metrics.tune_decision_threshold(scored.where("fold IS NOT NULL"), digits=12, by=["name"]).collect()}
        at = F.lit(None).cast("double")
        for n, t in tuned.items():
            at = F.when(F.col("name") == n, F.lit(float(t))).otherwise(at)
        return tuned, {r["name"]: r["f1"] for r in metrics.classification_metrics(scored.where("fold IS NULL"), threshold=at, digits=12, by=["name"]).collect()}

    with ThreadPoolExecutor(max_workers=2) as pool:
        measured = pool.submit(lambda: {(r["name"], r["part"]): r for r in metrics.classification_metrics(parts, digits=12, by=by).collect()})
        tuned, f1 = at_tuned()
        found = measured.result()
    out = []
    for n in names:
        aucs = [found[n, str(f)]["auc"] for f in range(K.CV_FOLDS)]
        mean = sum(aucs) / len(aucs)
        test = found[n, "test"]
        if guard:
            metrics.check_auc_leakage_guard(mean)
            metrics.check_auc_leakage_guard(test["auc"])
        out.append({"name": n, "cv_auc_mean": mean, "cv_auc_std": math.sqrt(sum((a - mean) ** 2 for a in aucs) / len(aucs)),
                    "test_auc": test["auc"], "test_pr_auc": test["pr_auc"], "test_precision": test["precision"], "test_recall": test["recall"],
                    "test_f1": test["f1"], "test_brier": test["brier"], "tuned_threshold": float(tuned[n]), "test_f1_at_tuned_threshold": f1[n],
                    "meets_target_auc": bool(test["auc"] >= K.TARGET_AUC)})
    return out


COMPARISON_SCHEMA = ("name string, cv_auc_mean double, cv_auc_std double, test_auc double, test_pr_auc double, "
                     "test_precision double, test_recall double, test_f1 double, test_brier double, "
                     "tuned_threshold double, test_f1_at_tuned_threshold double, meets_target_auc boolean")


def compare_models(training: Training, names: list[str] | None = None) -> DataFrame:
    """Evaluate every candidate; the table is sorted by cv_auc_mean (never by
    test AUC), ties broken by name."""
    return comparison_table(training.spark, training.evaluate(names or list(training.profile)))


def comparison_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    table = spark.createDataFrame([tuple(r[c] for c in K.LEADERBOARD_COLUMNS) for r in rows], COMPARISON_SCHEMA)
    return table.orderBy(F.desc("cv_auc_mean"), "name")


def select_best(comparison: DataFrame) -> dict:
    """Best row by cv_auc_mean (first on ties); error when empty; a warning when it misses the target AUC."""
    best = comparison.orderBy(F.desc("cv_auc_mean"), "name").first()
    if best is None:
        raise ValueError("no candidate models to select from")
    if not best["test_auc"] >= K.TARGET_AUC:
        logger.warning("%s is the best candidate, but its test AUC of %.4f misses the target of %.2f", best["name"], best["test_auc"], K.TARGET_AUC)
    return best.asDict()
