"""Split -> train -> compare -> calibrate -> segment, once per data set.

Artifacts live under the shared checkpoint folder (``spark.checkpoint.dir``), keyed by code version, model sizes and a fingerprint
of the data; every later query loads them instead of refitting.  Replaced data under the same path have another fingerprint and
train anew.  The keyed split is written as a table once, so training and calibration read the same rows (and lineage is cut there).
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import pathlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.ml import segment as seg
from churnkit.ml.blocks import WHOLE
from churnkit.ml.calibrate import calibrator, fit_isotonic, fit_sigmoid
from churnkit.ml.ensemble import Model
from churnkit.ml.score import CalibratedScorer, ModelScorer, candidate_scores
from churnkit.ml.split import split_assign
from churnkit.ml.train import DIAGNOSTIC, REFERENCE_PROFILE, Training, compare_models, select_best
from churnkit.operators import metrics
from churnkit.session import work_dir
from churnkit.sources import artifacts


def _code_version() -> str:
    """Digest of the library's code but for the training-data operators, so a changed step never reuses what was made before it."""
    root = pathlib.Path(__file__).resolve().parent.parent
    digest = hashlib.sha1()
    for f in sorted(p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts):
        digest.update(str(f.relative_to(root)).encode())
        digest.update(f.read_bytes())
    return "v" + digest.hexdigest()[:12]


CACHE_VERSION = _code_version()
#: Rows of an arriving file.
LANDED_ROWS = 1_000_000
# What was loaded or measured before in this process, by path.
_LOADED: dict[str, object] = {}


def _once(key: str, make):
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def _profile_key(profile: dict | None) -> str:
    return hashlib.sha1(json.dumps(profile or REFERENCE_PROFILE, sort_keys=True).encode()).hexdigest()[:8]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.plans.registry import cleaned as _cleaned

    return _cleaned(spark, sf_dir)


def data_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Fingerprint of the cleaned subscribers; measured again when the files of the source tables have changed."""
    stamp = artifacts.file_stamp(spark, *(f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer")))
    return _once(f"fingerprint {sf_dir} {stamp}", lambda: artifacts.fingerprint(cleaned(spark, sf_dir)))


def run_dir(spark: SparkSession, sf_dir: str, *parts: str, profile: dict | None = None) -> str:
    """Folder of a data set's artifacts; models of other sizes than the reference's, and other data, have one of their own."""
    slug = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.strip("/"))
    return work_dir(spark, "runs", f"{CACHE_VERSION}_{_profile_key(profile)}_{slug}_{data_fingerprint(spark, sf_dir)}", *parts)


def _made(spark: SparkSession, sf_dir: str, mark: str, make) -> None:
    """Run ``make`` unless ``mark`` exists.  Several processes may ask at once: one makes, the others wait and find it made."""
    if not artifacts.path_exists(spark, mark):
        with artifacts.lease(spark, run_dir(spark, sf_dir, "lease")):
            if not artifacts.path_exists(spark, mark):
                make()


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M2 written once: clean subscribers + is_test + fold.  The clean rows are written first, so counting for the cuts reads two
    columns of a table and derives nothing twice."""
    path, clean = run_dir(spark, sf_dir, "split"), run_dir(spark, sf_dir, "clean")

    def make() -> None:
        cleaned(spark, sf_dir).write.mode("overwrite").parquet(clean)
        split_assign(spark.read.parquet(clean)).write.mode("overwrite").parquet(path)

    _made(spark, sf_dir, f"{path}/_SUCCESS", make)
    return spark.read.parquet(path)


def training(spark: SparkSession, sf_dir: str, profile: dict | None = None) -> Training:
    return Training(spark, split_table(spark, sf_dir), run_dir(spark, sf_dir, "training", profile=profile), profile)


def comparison(spark: SparkSession, sf_dir: str, profile: dict | None = None) -> DataFrame:
    """Compare candidates, mark the best as production, write the comparison CSV, the model's sidecar and run events."""
    path = run_dir(spark, sf_dir, "comparison", profile=profile)

    def make() -> None:
        run = training(spark, sf_dir, profile)
        table = compare_models(run)
        rows = {r["name"]: r.asDict() for r in table.collect()}
        best = select_best(table)["name"]
        for name, row in rows.items():
            run.ledger.event(name, "selected" if name == best else "compared", {**run.params(name), "seed": K.RANDOM_STATE, "test_size": K.TEST_SIZE, "cv_folds": K.CV_FOLDS},
                             row, {"best_model": str(name == best)})
        artifacts.save_sidecar(spark, run_dir(spark, sf_dir, "production", profile=profile), best, rows[best], {"data_fingerprint": data_fingerprint(spark, sf_dir)})
        artifacts.save_comparison(table, path)

    _made(spark, sf_dir, f"{path}/_SUCCESS", make)
    return artifacts.load_leaderboard(spark, path)


def best_name(spark: SparkSession, sf_dir: str) -> str:
    return _once(run_dir(spark, sf_dir, "best"), lambda: select_best(comparison(spark, sf_dir))["name"])


def production_model(spark: SparkSession, sf_dir: str) -> Model:
    """The best candidate, of whatever family; its sidecar must describe the data at hand."""
    def load() -> Model:
        name = best_name(spark, sf_dir)
        artifacts.check_fresh(artifacts.load_metadata(spark, run_dir(spark, sf_dir, "production")), cleaned(spark, sf_dir), data_fingerprint(spark, sf_dir))
        return training(spark, sf_dir).model(name)

    return _once(run_dir(spark, sf_dir, "production"), load)


def diagnostic_model(spark: SparkSession, sf_dir: str) -> tuple[Model, float]:
    """Throwaway boosted-tree driver model weighted n_neg/n_pos (from the training rows only)."""
    def load() -> tuple[Model, float]:
        run = training(spark, sf_dir)
        _made(spark, sf_dir, f"{run.ledger.path(DIAGNOSTIC, WHOLE)}/model.json", lambda: run.ensure([DIAGNOSTIC], [WHOLE]))
        return run.model(DIAGNOSTIC), run.positive_weight()

    return _once(run_dir(spark, sf_dir, "diagnostic"), load)


def held_out_scores(spark: SparkSession, sf_dir: str, margin: bool) -> DataFrame:
    """``(fold, y, p, f)``: what the base model of each fold says of the rows it has not seen; ``f`` is its log-odds with ``margin``."""
    run, name = training(spark, sf_dir), best_name(spark, sf_dir)
    scored = run.scores(list(run.profile)).where((F.col("name") == name) & F.col("fold").isNotNull())
    f = F.log(F.col("p") / (1 - F.col("p"))) if margin else F.col("p")
    return scored.select("fold", "y", "p", f.alias("f"))


def calibrated_scorer(spark: SparkSession, sf_dir: str, method: str = "isotonic") -> CalibratedScorer:
    """5-fold calibration of the production model family, stored next to (never over) the raw model.  The base model of a fold
    is the fit that left that fold out, so nothing is trained again."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"calibration method must be 'isotonic' or 'sigmoid', got {method!r}")

    def load() -> CalibratedScorer:
        name, run = best_name(spark, sf_dir), training(spark, sf_dir)

        def make() -> None:
            linear = run.model(name, 0).linear
            held = held_out_scores(spark, sf_dir, linear and method == "sigmoid")
            found = fit_isotonic(held) if method == "isotonic" else fit_sigmoid(held, linear)
            run.ledger.note(f"calibrated-{method}", {
                "model_name": f"{name}_calibrated", "base_model_name": name, "calibration_method": method, "cv_folds": K.CV_FOLDS,
                "trained_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "feature_columns": list(K.FEATURE_COLUMNS), "target_column": K.TARGET_COLUMN,
                "data_fingerprint": data_fingerprint(spark, sf_dir), "calibrators": {str(k): v.to_dict() for k, v in found.items()}})
            run.ledger.event(f"{name}_calibrated_{method}", "calibrated", {"base_model_name": name, "calibration_method": method})

        _made(spark, sf_dir, f"{run.folder}/calibrated-{method}.json", make)
        known = run.ledger.noted(f"calibrated-{method}")
        artifacts.check_fresh(known, cleaned(spark, sf_dir), data_fingerprint(spark, sf_dir))
        return CalibratedScorer([(run.model(name, f), calibrator(known["calibrators"][str(f)])) for f in range(K.CV_FOLDS)])

    return _once(run_dir(spark, sf_dir, f"calibrated-{method}"), load)


def raw_scorer(spark: SparkSession, sf_dir: str) -> ModelScorer:
    return _once(run_dir(spark, sf_dir, "raw-scorer"), lambda: ModelScorer(production_model(spark, sf_dir)))


def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(customerID, y, p_raw, p_cal, p_sig)`` of the test rows, written once: every report on calibration reads this table."""
    path = run_dir(spark, sf_dir, "method-scores")

    def make() -> None:
        frame = split_table(spark, sf_dir).where("is_test").withColumn("y", F.col(K.TARGET_COLUMN).cast("int"))
        for out, scorer in (("p_raw", raw_scorer(spark, sf_dir)), ("p_cal", calibrated_scorer(spark, sf_dir)), ("p_sig", calibrated_scorer(spark, sf_dir, "sigmoid"))):
            frame = scorer.transform(frame, out=out)
        frame.select(K.ID_COLUMN, "y", "p_raw", "p_cal", "p_sig").write.mode("overwrite").parquet(path)

    _made(spark, sf_dir, f"{path}/_SUCCESS", make)
    return spark.read.parquet(path)


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against calibrated on the test rows; the run's event holds the numbers, the JSON file the names as well."""
    path = run_dir(spark, sf_dir, "calibration_metrics")

    def make() -> None:
        name = best_name(spark, sf_dir)
        report = metrics.calibration_report(method_scores(spark, sf_dir))
        row = report.first().asDict()
        training(spark, sf_dir).ledger.event(f"{name}_calibrated_isotonic", "measured", {"base_model_name": name, "calibration_method": "isotonic"}, row)
        artifacts.save_calibration_metrics(spark.createDataFrame([(name, "isotonic", *row.values())], artifacts.CALIBRATION_METRICS), path)

    _made(spark, sf_dir, f"{path}/_SUCCESS", make)
    return artifacts.load_calibration_metrics(spark, path)


def segmentation_model(spark: SparkSession, sf_dir: str):
    from pyspark.ml import PipelineModel

    path = run_dir(spark, sf_dir, "segmentation")

    def make() -> None:
        seg.fit_segmentation(cleaned(spark, sf_dir)).write().overwrite().save(path)
        artifacts.write_bytes(spark, f"{path}.done", b"")

    _made(spark, sf_dir, f"{path}.done", make)
    return _once(path, lambda: PipelineModel.load(path))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the raw subscribers without their label, as arriving files of at most ``LANDED_ROWS`` rows."""
    from churnkit.plans.registry import raw

    path = run_dir(spark, sf_dir, "landing")
    rows = raw(spark, sf_dir).drop(K.TARGET_COLUMN)
    _made(spark, sf_dir, f"{path}/_SUCCESS", lambda: rows.write.mode("overwrite").option("maxRecordsPerFile", LANDED_ROWS).parquet(path))
    return path


def lime_pool(spark: SparkSession, sf_dir: str):
    """E5 context: training marginals of the split's training rows and the shared,
    scored perturbation pool for the production model, built once per process."""
    from churnkit.ml.lime import build_pool, training_marginals

    def make():
        train = split_table(spark, sf_dir).where(~F.col("is_test"))
        return build_pool(spark, training_marginals(train), raw_scorer(spark, sf_dir), train.schema)

    return _once(run_dir(spark, sf_dir, "lime-pool"), make)


__all__ = ["calibrated_scorer", "calibration_report", "candidate_scores", "comparison", "diagnostic_model", "method_scores", "production_model", "raw_scorer", "run_dir",
           "segmentation_model", "split_table", "training"]
